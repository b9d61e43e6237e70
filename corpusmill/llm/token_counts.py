"""Token counts by a tokenizer file, without keeping the ids.

An Arrow function cuts long texts at safe boundaries (sentencepiece gets whole texts), deals the pieces of a
batch into groups of about equal bytes, has the library encode group after group, and returns lengths
only. So a text of any length costs one group's encodings at a time.

Defined results: null or empty text counts 0; special strings inside texts count as the
library's default has it; no truncation or padding; repeated rows count each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.tokenizing import safe_pieces, tokenizer

#: Characters of pieces that the library encodes in one call; a longer piece is a call of its own.
GROUP_CHARS = 1 << 19


def groups(texts: pa.Array, cut: bool, most: int = GROUP_CHARS) -> Iterator[tuple[list[int], list[str]]]:
    """Pieces of the texts and the row of each, in groups of about `most` characters; cut: long texts may be cut."""
    rows: list[int] = []
    pieces: list[str] = []
    total = 0
    for i, text in enumerate(texts):
        whole = text.as_py()
        for piece in safe_pieces(whole) if cut else [whole]:
            if rows and total + len(piece) > most:
                yield rows, pieces
                rows, pieces, total = [], [], 0
            rows.append(i)
            pieces.append(piece)
            total += len(piece)
    if rows:
        yield rows, pieces


def token_count(text: Column, path: str) -> Column:
    """Number of tokens of a string column, as long."""

    @F.arrow_udf(T.LongType())
    def count(texts: pa.Array) -> pa.Array:
        tok = tokenizer(path)
        out = np.zeros(len(texts), np.int64)
        for rows, pieces in groups(texts, cut=not path.endswith(".model")):
            np.add.at(out, rows, tok.counts(pieces))
        return pa.array(out)

    return count(F.coalesce(text, F.lit("")))


def count_tokens(df: DataFrame, path: str, text_col: str = "text", limit: int = 2048) -> DataFrame:
    """Add n_bytes, n_tokens and over_limit (more than `limit` tokens) to the table; columns of these names are replaced."""
    text = F.col(f"`{text_col}`")
    counted = df.withColumns({"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": token_count(text, path)})
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
