"""Byte-level BPE encoding and decoding with a local rank file.

Every text is split by the pattern and each match is merged by rank; long
texts are first cut at safe boundaries so that no call sees an unbounded text.
Decoding joins raw token bytes, so ids of any cut through a character decode too.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated
rows are encoded each; other columns pass through untouched; an empty table
gives an empty table. The added column replaces one of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.textbatch import STEP_BYTES, tidy
from corpusmill.llm.tokenizing import rank_encoder, safe_pieces


def encode(df: DataFrame, rank_file: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add `ids_col`, the BPE ids of `text_col`, as array<int>. One narrow pass: no shuffle, any partitioning stays."""
    keep = [c for c in df.columns if c != ids_col]
    src = df.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    schema = T.StructType([*[df.schema[c] for c in keep], T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = rank_encoder(rank_file, pattern)
        for batch in batches:
            for part in slices(batch, "__text"):
                out = []
                for text in part.column("__text"):
                    ids: list[int] = []
                    for piece in safe_pieces(text.as_py()):
                        ids += enc.encode_ordinary(piece)
                    out.append(np.asarray(ids, np.int32))
                off = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                coded = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(out)))
                cols = [part.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, coded], names=[*keep, ids_col])

    return src.mapInArrow(tidy(run), schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add `out_col`, the raw bytes of the ids, as binary. Ids outside the vocabulary raise; null ids decode to no bytes."""

    @F.arrow_udf(T.BinaryType())
    def raw(ids: pa.Array) -> pa.Array:
        enc = rank_encoder(rank_file, pattern)
        # One row's ids at a time become Python numbers; a whole batch of them would take ten times its Arrow size.
        off, flat = ids.offsets.to_numpy(), ids.values
        none = ids.is_null().to_numpy(zero_copy_only=False)
        return pa.array((b"" if none[i] else enc.decode_bytes(flat.slice(off[i], off[i + 1] - off[i]).to_numpy(zero_copy_only=False).tolist()) for i in range(len(ids))), pa.binary())

    return df.withColumn(out_col, raw(F.col(f"`{ids_col}`")))


def slices(batch: pa.RecordBatch, col: str, most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each."""
    import pyarrow.compute as pc

    from corpusmill.llm.textbatch import steps

    for a, b in steps(pc.binary_length(batch.column(col)).to_numpy(zero_copy_only=False), most):
        yield batch.slice(a, b - a)
