"""Overlapping chunks of a text, cut at the best boundary in the overlap zone.

The default keeps the redundant suffix chunks that the algorithm emits after a window has
reached the end; drop_suffix_chunks leaves them out. Offsets are code points and untrimmed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import WHITE
from corpusmill.schema import ChunkConfig
from corpusmill.session import bounded_batches

_SENTENCE_END = re.compile(rf"[.!?](?=[{re.escape(WHITE)}]|\Z)")


def cut_point(zone: str) -> int:
    """Where to cut in the overlap zone: after the last blank line, line, sentence or space, in this order; -1 without any."""
    at = zone.rfind("\n\n")
    if at >= 0:
        return at + 2
    at = zone.rfind("\n")
    if at >= 0:
        return at + 1
    last = None
    for last in _SENTENCE_END.finditer(zone):  # noqa: B007
        pass
    if last:
        return last.end()
    return zone.rfind(" ") + 1 or -1


def windows(text: str, size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(start, end, trimmed text) of every non-blank window."""
    n, start = len(text), 0
    if not text.strip(WHITE):
        return
    while start < n:
        end = min(start + size, n)
        if end < n and overlap:
            zone = max(start, end - overlap)
            cut = cut_point(text[zone:end])
            end = zone + cut if cut > 0 else end
        piece = text[start:end].strip(WHITE)
        if piece:
            yield start, end, piece
        following = end - overlap
        if start < following < n:
            space = text.rfind(" ", start + 1, following + 1)
            following = space + 1 if space >= 0 else following
        start = following if following > start else end


def _wide(text: str) -> list[int]:
    """Places of characters that take two UTF-16 units; an offset has moved by as many as come before it."""
    return [] if text.isascii() else [m.start() for m in _ASTRAL.finditer(text)]


_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def chunks(df: DataFrame, config: ChunkConfig | None = None, text_col: str = "content", key_cols: tuple[str, ...] = ("url", "title"), id_from: str = "url", drop_suffix_chunks: bool = False, units: str = "code_points") -> DataFrame:
    """One row a chunk: id, the key columns, content, chunkIndex, totalChunks, startOffset, endOffset.

    The id is a hash of key, position and content, so indexing the same text again gives the same ids. units: what offsets count,
    code points, or utf16 code units as other platforms count them; windows are cut the same way in either.
    """
    if units not in ("code_points", "utf16"):
        raise ValueError(f"unknown units {units!r}")
    c = config or ChunkConfig()
    bounded_batches(df.sparkSession)

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()), T.StructField("t", T.StringType())])))
    def cut(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text = t.as_py() or ""
            rows = []
            wide = _wide(text) if units == "utf16" else None
            for s, e, piece in windows(text, c.size, c.overlap):
                extra = (bisect_left(wide, s), bisect_left(wide, e)) if wide else (0, 0)
                rows.append({"s": s + extra[0], "e": e + extra[1], "t": piece})
                if drop_suffix_chunks and e == len(text):
                    break
            out.append(rows)
        return pa.array(out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("t", pa.string())])))

    # Not deterministic as far as the optimizer knows, or it cuts every text a second time to drop those without a chunk.
    keys, cut = [F.col(k) for k in key_cols], cut.asNondeterministic()
    # The number of chunks is taken before rows are made, or every row would carry all the chunks of its text.
    cut_rows = df.select(*keys, cut(F.col(text_col)).alias("w")).select(*keys, F.size("w").alias("totalChunks"), "w").select(*keys, "totalChunks", F.posexplode("w").alias("chunkIndex", "c"))
    ident = F.sha2(F.concat_ws("|", F.col(id_from).cast("string"), F.col("chunkIndex").cast("string"), F.col("c.t")).cast("binary"), 256)
    return cut_rows.select(ident.alias("id"), *keys, F.col("c.t").alias("content"), "chunkIndex", "totalChunks", F.col("c.s").alias("startOffset"), F.col("c.e").alias("endOffset"))
