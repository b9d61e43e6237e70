"""Document fingerprints by MinHash, and near-duplicate groups by banded signatures.

A signature has `perms` components: the least value of a universal hash a * x + b (mod 2^64, upper
half) over the word shingles, one (a, b) each. The share of equal components of two
signatures estimates the Jaccard similarity of the shingle sets. All of it is vectorised numpy over Arrow
batches; a batch's shingles are hashed once and each permutation is one pass over them.

Near duplicates: bands of rows of the signature are join keys in Spark. Equal sets collapse to one class first, members
of a key are paired as in the n-gram join, and candidates are verified on the shingle sets. A pair without a band in
common is not found; at the threshold that has the probability that `banding` bounds, and less above it.

Defined results: texts with fewer words than a shingle are one shingle; a text without words has the signature of
the empty set (all components at their top value), equal to that of every such text and to
no other; null is empty; repeated rows have equal fingerprints; an empty table gives an empty table. A text longer than a step of about 2 MB
is a step of its own and takes some 23 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm import ngram_join
from corpusmill.llm.bpe import slices
from corpusmill.llm.textbatch import Words, buffers, mix, shingles, steps, tidy

SHINGLE = 5
PERMS = 128


def permutations(perms: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, perms, dtype=np.uint64)


def signatures(texts: pa.Array, perms: int = PERMS, size: int = SHINGLE) -> np.ndarray:
    """Rows of `perms` uint32 for the texts of a null-free string array."""
    raw, off = buffers(texts)
    h, first = shingles(Words(raw, off), size)
    return _least(h, first, perms)


def _least(h: np.ndarray, first: np.ndarray, perms: int) -> np.ndarray:
    """Signatures of the rows whose hashes begin at `first`."""
    out = np.full((len(first) - 1, perms), np.uint32(0xFFFFFFFF), np.uint32)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    a, b = permutations(perms)
    heads = first[:-1][full]
    for k in range(perms):
        v = ((h * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32)
        out[full, k] = np.minimum.reduceat(v, heads)
    return out


def band_keys(percent: int, perms: int = PERMS) -> ngram_join.KeyMaker:
    """Keys of the bands of the signatures of all sets that are not empty."""
    rows = banding(percent / 100, perms)

    def make(h: np.ndarray, doc: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = np.flatnonzero(n)
        sig = _least(h, np.concatenate([[0], np.cumsum(n)]), perms)[some].reshape(len(some), -1, rows).astype(np.uint64)
        key = np.broadcast_to(mix(np.arange(perms // rows, dtype=np.uint64) + np.uint64(1)), sig.shape[:2])
        for r in range(rows):
            key = mix(key ^ mix(sig[:, :, r] + np.uint64(r)))
        return np.repeat(some, perms // rows), key.ravel()

    return make


def minhash(df: DataFrame, text_col: str = "text", out_col: str = "signature", perms: int = PERMS, size: int = SHINGLE) -> DataFrame:
    """Add the signature as binary (little-endian uint32 components)."""

    @F.arrow_udf(T.BinaryType())
    def sign(texts: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        out: list[bytes] = []
        for a, b in steps(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
            out += [x.tobytes() for x in signatures(texts.slice(a, b - a), perms, size)]
        return pa.array(out, pa.binary())

    return df.withColumn(out_col, sign(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))


def banding(threshold: float, perms: int = PERMS) -> int:
    """Rows of a band: the most that still find a pair at the threshold with probability 0.999."""
    return max(r for r in range(1, 33) if perms % r == 0 and 1 - (1 - threshold**r) ** (perms // r) >= 0.999)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, perms: int = PERMS, size: int = SHINGLE) -> DataFrame:
    """id and component_id per row: bands joined in Spark, Jaccard (100 * common >= percent * union) verified on the shingle sets."""
    out = ngram_join.grouped(ngram_join._source(df, id_col, text_col), percent, size, band_keys(percent, perms))
    return out.select(F.col("id").alias(id_col), "component_id")


def with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Rows dealt to partitions so that each can be read together with its successor in descending id order (the last's is the first).

    Columns part, tail, id, text; sorted by (part, tail, id descending, text) in every partition. A `tail` row ends a
    part: it is a copy of the first row of the part that follows. Parts are ranges of ids between quantiles
    (numbers only reach the driver, one a part), so one shuffle moves every text once.
    """
    spark = df.sparkSession
    src = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    n = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    cuts = sorted({int(x) for x in src.select("id").where("id IS NOT NULL").approxQuantile("id", [i / n for i in range(1, n)], 1 / (8 * n))}) if n > 1 else []
    bounds = np.asarray(cuts, np.int64)

    @F.arrow_udf(T.IntegerType())
    def part_of(ids: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        # Null ids come last in descending order: part 0.
        null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        at = np.searchsorted(bounds, pc.fill_null(ids, 0).to_numpy(zero_copy_only=False), "right") + 1
        return pa.array(np.where(null, 0, at).astype(np.int32))

    heads = sorted((r["part"], r["head"]) for r in src.select("id", part_of("id").alias("part")).groupBy("part").agg(F.max("id").alias("head")).collect())
    dealt = src.select(part_of("id").alias("part"), F.lit(False).alias("tail"), "id", "text")
    if heads:
        follow = spark.createDataFrame([(p, heads[i - 1][1]) for i, (p, _) in enumerate(heads)], "part int, head long")
        firsts = src.join(F.broadcast(follow.select(F.col("head").alias("h")).distinct()), F.col("id").eqNullSafe(F.col("h")), "left_semi").groupBy("id").agg(F.min("text").alias("text"))
        tails = follow.join(firsts, F.col("head").eqNullSafe(F.col("id"))).select("part", F.lit(True).alias("tail"), "id", "text")
        dealt = dealt.union(tails)
    return dealt.repartitionById(len(cuts) + 2, F.col("part")).sortWithinPartitions("part", "tail", F.col("id").desc_nulls_last(), "text")


def edited(text: str, nxt: str) -> str:
    """The last floor(n / 2) characters replaced by the first as many (or all) of the next text."""
    k = len(text) // 2
    return text[: len(text) - k] + nxt[:k]


def compare_with_next(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", perms: int = PERMS, size: int = SHINGLE) -> DataFrame:
    """id, text length, edited text's bytes, both signatures, and the likeness to the edited and to the next text."""
    schema = "doc_id long, n_chars long, edited string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []  # rows that wait for their successor: (part, tail, id, text, signature)
        for batch in batches:
            for piece in slices(batch, "text"):
                sig = signatures(piece.column("text"), perms, size)
                rows = list(zip(piece.column("part").to_pylist(), piece.column("tail").to_pylist(), piece.column("id").to_pylist(), piece.column("text").to_pylist(), sig, strict=True))
                chain = held + rows
                done = [(x, y) for x, y in zip(chain, chain[1:], strict=False) if not x[1]]
                held = chain[-1:]
                if done:
                    yield result(done)

    def result(done: list) -> pa.RecordBatch:
        other = pa.array([edited(x[3], y[3]) for x, y in done], pa.string())
        own, nxt, new = np.stack([x[4] for x, _ in done]), np.stack([y[4] for _, y in done]), signatures(other, perms, size)
        return pa.RecordBatch.from_arrays(
            [pa.array([x[2] for x, _ in done], pa.int64()), pa.array([len(x[3]) for x, _ in done], pa.int64()), other, pa.array([s.tobytes() for s in own], pa.binary()), pa.array([s.tobytes() for s in new], pa.binary()), pa.array((own == new).mean(axis=1)), pa.array((own == nxt).mean(axis=1))],
            names=["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    return with_next(df, id_col, text_col).mapInArrow(tidy(run), schema)
