"""Batched upserts into a store outside Spark: calls of at most `size` rows, made by the executors, with failures as rows."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

from corpusmill.sources.store import last_wins

#: Rows of one call.
CALL_ROWS = 200


class Upserter(Protocol):
    """Writes rows by their `id`; sent to executors, so it has to pickle. A call may come twice, as tasks are run again."""

    def upsert(self, rows: list[dict]) -> None: ...


def upsert_batches(rows: DataFrame, upserter: Upserter, size: int = CALL_ROWS, ordinal: str | None = None) -> DataFrame:
    """(call, rows, error) of every call, lazily: the rows are written when this is. Of rows with one id the last wins; it goes in one call."""
    if size <= 0:
        raise ValueError("size must be over 0")
    final = last_wins(rows, "id", ordinal)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, held = 0, []

        def send(part: list[dict]) -> pa.RecordBatch:
            error = None
            try:
                upserter.upsert(part)
            except Exception as e:  # the other calls go on
                error = f"{type(e).__name__}: {e}"
            return pa.RecordBatch.from_pydict({"call": pa.array([call], pa.int32()), "rows": pa.array([len(part)], pa.int32()), "error": pa.array([error], pa.string())})

        for batch in batches:
            held.extend(batch.to_pylist())
            while len(held) >= size:
                yield send(held[:size])
                held, call = held[size:], call + 1
        if held:
            yield send(held)

    return final.mapInArrow(run, "call int, rows int, error string")
