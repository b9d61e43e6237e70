"""Token ids as compressed bit-plane or byte-plane segments.

A segment is a self-describing byte string: header, one entry per block (the chunk
index), then the blocks. A block is a fixed number of ids, transposed into
planes (byte k of every id, or bit k of every id) and compressed plane by plane
with zstandard; high planes of small ids are all zero and vanish.

    header   magic 4s | plane kind u8 | id bytes u8 | pad u16 | block ids u32 | n_ids u64 | n_blocks u32
    index    per block: ids u32 | offset u64 | length of each plane u32 * planes
    payload  planes, one zstandard frame each

`write_tokens` range-partitions the documents by id, encodes them, and writes
segments of whole documents as rows of a Parquet dataset, through Spark's committer:
a lost executor's segments are written again, and any filesystem Spark knows will do.
`read_tokens` reads only segments and derives everything from them.

Defined results: null or empty text is a document of the end id alone; rows with a repeated id
follow one another by text hash; null ids come first; an empty table is an empty dataset.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.bpe import slices
from corpusmill.llm.textbatch import tidy
from corpusmill.llm.tokenizing import tokenizer

MAGIC = b"CMTP"
_HEAD = struct.Struct("<4sBBHIQI")
#: Ids of a block.
BLOCK_IDS = 1 << 16
#: A segment is closed once it has so many ids.
SEGMENT_IDS = 1 << 20


def pack(ids: np.ndarray, planes: str = "byte", block_ids: int = BLOCK_IDS, level: int = 3) -> bytes:
    """One segment from unsigned 32-bit ids."""
    if planes not in ("byte", "bit"):
        raise ValueError("planes must be 'byte' or 'bit'")
    ids = np.ascontiguousarray(ids, "<u4")
    comp = zstandard.ZstdCompressor(level=level)
    n_planes = 4 if planes == "byte" else 32
    index, payload, offset = [], [], 0
    for a in range(0, len(ids), block_ids):
        block = ids[a : a + block_ids]
        octets = block.view(np.uint8).reshape(-1, 4).T
        rows = octets if planes == "byte" else np.packbits((octets[:, None, :] >> np.arange(8, dtype=np.uint8)[None, :, None]) & 1, axis=-1).reshape(32, -1)
        frames = [comp.compress(np.ascontiguousarray(x).tobytes()) for x in rows]
        index.append(struct.pack(f"<IQ{n_planes}I", len(block), offset, *map(len, frames)))
        payload += frames
        offset += sum(map(len, frames))
    return b"".join([_HEAD.pack(MAGIC, n_planes, 4, 0, block_ids, len(ids), len(index)), *index, *payload])


def blocks(segment: bytes | pa.Buffer) -> list[tuple[int, int, tuple[int, ...]]]:
    """The chunk index: ids, offset in the segment, and plane lengths of each block."""
    magic, n_planes, _, _, _, _, n = _HEAD.unpack_from(segment)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    entry = struct.Struct(f"<IQ{n_planes}I")
    base = _HEAD.size + n * entry.size
    return [(x[0], base + x[1], x[2:]) for x in (entry.unpack_from(segment, _HEAD.size + i * entry.size) for i in range(n))]


def unpack(segment: bytes | pa.Buffer, only: range | None = None) -> np.ndarray:
    """The ids of a segment, or of the blocks in `only`."""
    decomp, view = zstandard.ZstdDecompressor(), memoryview(segment)
    out = []
    for n, at, lengths in (x for i, x in enumerate(blocks(segment)) if only is None or i in only):
        rows = []
        for length in lengths:
            rows.append(np.frombuffer(decomp.decompress(segment[at : at + length]), np.uint8))
            at += length
        if len(lengths) == 4:
            octets = np.stack(rows)
        else:
            bits = np.unpackbits(np.stack(rows), axis=-1)[:, :n].reshape(4, 8, n)
            octets = np.bitwise_or.reduce(bits << np.arange(8, dtype=np.uint8)[None, :, None], axis=1)
        out.append(np.ascontiguousarray(octets.T).view("<u4").ravel())
    return np.concatenate(out) if out else np.zeros(0, "<u4")


_SEGMENT_SCHEMA = "shard int, segment int, n_ids long, doc_ids array<bigint>, doc_tokens array<bigint>, data binary"


def write_tokens(df: DataFrame, tokenizer_path: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, planes: str = "byte", partitions: int | None = None) -> None:
    """Encode and write all documents in ascending id order. Shard k holds the k-th range of ids."""
    n = partitions or max(df.rdd.getNumPartitions(), 1)
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    tie = F.xxhash64("text")
    # The tie lets the range partitioner cut inside a repeated id.
    ordered = src.repartitionByRange(n, F.col("id"), tie).sortWithinPartitions("id", tie, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, shard, number = tokenizer(tokenizer_path), TaskContext.get().partitionId(), 0
        end = np.asarray([end_id], "<u4").tobytes()
        docs: list = []
        held: list[bytes] = []
        size = 0

        def segment() -> pa.RecordBatch:
            raw = b"".join(held)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([len(raw) // 4], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([[len(x) // 4 for x in held]], pa.list_(pa.int64())), pa.array([pack(np.frombuffer(raw, "<u4"), planes)], pa.binary())],
                names=["shard", "segment", "n_ids", "doc_ids", "doc_tokens", "data"],
            )

        for batch in batches:
            for part in slices(batch, "text"):
                for doc, ids in zip(part.column("id").to_pylist(), tok.ids(part.column("text").to_pylist()), strict=True):
                    docs.append(doc)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= SEGMENT_IDS:
                        yield segment()
                        docs, held, size, number = [], [], 0, number + 1
        if docs:
            yield segment()

    ordered.mapInArrow(tidy(run), _SEGMENT_SCHEMA).write.mode("errorifexists").parquet(out)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a written dataset: doc_id, start, n_tokens, ids_crc32, read from the segments.

    Only the index columns feed the prefix sum over segments, whose rows
    number one per SEGMENT_IDS ids.
    """
    files = spark.read.schema(_SEGMENT_SCHEMA).parquet(path)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = totals.select("shard", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shard_start"))
    inside = files.select("shard", "segment", F.coalesce(F.sum("n_ids").over(Window.partitionBy("shard").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("seg_start"))
    base = inside.join(shards, "shard").select("shard", "segment", (F.col("seg_start") + F.col("shard_start")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One segment at a time, its index columns and ids as arrays: the batch's other segments stay as Arrow has them.
            shards, segments, doc_ids, tokens, data = (batch.column(c) for c in ("shard", "segment", "doc_ids", "doc_tokens", "data"))
            for i in range(len(batch)):
                counts = tokens[i].values.to_numpy()
                ends = np.cumsum(counts)
                starts = ends - counts
                raw = memoryview(unpack(data[i].as_buffer()).view(np.uint8))
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                k = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(shards[i], k), pa.repeat(segments[i], k), doc_ids[i].values, pa.array(starts), tokens[i].values, pa.array(crc, pa.int64())],
                    names=["shard", "segment", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    docs = files.select("shard", "segment", "doc_ids", "doc_tokens", "data").mapInArrow(tidy(run), "shard int, segment int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return docs.join(base, ["shard", "segment"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
