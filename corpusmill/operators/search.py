"""Exact similarity search: top-k for one query vector, and for a set of queries in blocks.

Distances go up from best (l2), similarities down (cosine); both columns are given and `score`
repeats the asked metric. Ties are broken by id. Filters apply before the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import vector
from corpusmill.operators.filters import MetadataFilter, apply
from corpusmill.session import bounded_batches, saved

#: Vectors of one packed block: a pair of blocks is one matrix product of QUERY_BLOCK x ROW_BLOCK doubles.
QUERY_BLOCK = 8192
ROW_BLOCK = 4096
#: Bytes of packed rows that a task pairs with its query blocks, where rows are not broadcast: a query has k rows a part written.
PART_BLOCKS = 64 << 20
#: Packed blocks of rows up to this many bytes in all, as measured, are broadcast; beyond it parts of both sides are paired by tasks.
BROADCAST_BLOCKS = 64 << 20


def scored(df: DataFrame, query: list[float], metric: str = "l2", vec_col: str = "embedding") -> DataFrame:
    """Add distance (squared Euclidean), similarity (cosine) and score."""
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    q, v = vector.literal(query), F.col(vec_col)
    out = df.withColumns({"distance": F.round(vector.l2(v, q), 6), "similarity": F.round(vector.cosine(v, q), 6)})
    return out.withColumn("score", F.col("distance" if metric == "l2" else "similarity"))


def top_k(df: DataFrame, query: list[float], k: int, metric: str = "l2", filters: list[MetadataFilter] | None = None, id_col: str = "id", vec_col: str = "embedding") -> DataFrame:
    """The k best rows. Plans as filter -> project -> TakeOrderedAndProject: no shuffle of rows, k per task to the driver."""
    if k <= 0:
        raise ValueError("k must be over 0")
    out = scored(apply(df, filters), query, metric, vec_col)
    best = F.col("distance").asc() if metric == "l2" else F.col("similarity").desc()
    return out.orderBy(best, F.col(id_col).asc()).limit(k)


def batch_top_k(df: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding", query_id: str = "qid", query_vec: str = "embedding") -> DataFrame:
    """(qid, rank, id, score) for every query against all rows.

    Both sides are packed into blocks of vectors inside their partitions, and every query block meets every row
    block once; nothing passes through the driver. A task holds the k best rows of one query block at a time and
    emits them when the next begins. Null ids and vectors are left out.
    """
    if metric not in ("l2", "cosine"):
        raise ValueError(f"unknown metric {metric!r}")
    if k <= 0:
        raise ValueError("k must be over 0")
    bounded_batches(df.sparkSession)
    qid, rid = queries.schema[query_id].dataType.simpleString(), df.schema[id_col].dataType.simpleString()
    asked = queries.select(F.col(query_id).alias("id"), F.col(query_vec).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    asked = saved(asked.mapInArrow(_packer(QUERY_BLOCK, _width(asked)), f"ids array<{qid}>, m binary").select(F.expr("uuid()").alias("block"), F.col("ids").alias("qids"), F.col("m").alias("qm")), "query-blocks")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = saved(rows.mapInArrow(_packer(ROW_BLOCK, _width(rows), k), f"ids array<{rid}>, m binary"), "row-blocks")
    return met(asked, rows, None, k, metric, f"qid {qid}, id {rid}, score double", (_width(queries.select(query_vec)), _width(df.select(vec_col))))


def _width(vectors: DataFrame) -> str:
    """The numpy type that holds the last column's numbers as they are."""
    return "f4" if vectors.dtypes[-1][1] == "array<float>" else "f8"


def met(asked: DataFrame, rows: DataFrame, on: Column | None, k: int, metric: str, schema: str, widths: tuple[str, str]) -> DataFrame:
    """(qid, rank, id, score) of query blocks (block, qids, qm, perhaps near) against row blocks (ids, m, perhaps cell), written both; `on` says which pairs meet.

    The rows are the inner side: a task works through one query block after the other, so what it holds and emits is k rows a query.
    """
    size = rows.agg(F.coalesce(F.sum(F.octet_length("m")), F.lit(0))).first()[0]
    n, cores = asked.count(), asked.sparkSession.sparkContext.defaultParallelism
    # Pairs of blocks, not of rows: the queries are a stated set, and each has to meet all rows. Shares of queries, as blocks are few but each is much work.
    if size <= BROADCAST_BLOCKS:
        inner, shares = F.broadcast(rows), min(n, 4 * cores)
    else:
        parts = max(-(-size // PART_BLOCKS), 4 * cores // max(1, n), 1)
        inner, shares = rows.coalesce(parts).hint("shuffle_replicate_nl"), min(n, -(-8 * cores // parts))
    asked = asked.repartition(max(1, shares))
    pairs = asked.crossJoin(inner) if on is None else asked.join(inner, on, "inner")
    found = pairs.mapInArrow(_best_of(k, metric, widths), schema)
    order = F.col("score").asc() if metric == "l2" else F.col("score").desc()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(order, "id")))
    return ranked.where(F.col("rank") <= k).select("qid", "rank", "id", "score")


def _matrix(vectors: pa.ChunkedArray, width: str) -> np.ndarray:
    """A column of vectors of one length as a matrix; a null number is NaN."""
    flat = vectors.combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    lengths = pc.list_value_length(flat)
    span = pc.min_max(lengths).as_py()
    if span["min"] != span["max"]:
        raise ValueError(f"vectors of {span['min']} and of {span['max']} components in one search")
    return flat.flatten().to_numpy(zero_copy_only=False).astype(width).reshape(len(flat), -1)


def _first_of_equal(m: np.ndarray, most: int) -> np.ndarray:
    """Places of the vectors, in order, without those that `most` equal ones precede."""
    if not m.size:
        return np.arange(min(len(m), most))
    _, kind = np.unique(np.ascontiguousarray(m).view(np.dtype((np.void, m.itemsize * m.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(kind, kind="stable")
    kind = kind[order]
    return np.sort(order[np.arange(len(kind)) - np.searchsorted(kind, kind, "left") < most])


def _packer(size: int, width: str = "f8", most: int | None = None):
    """Rows (id, v) to blocks (ids, m): up to `size` vectors as one matrix of numbers of that type, ids in ascending order.

    most: of equal vectors of a block so many are kept, those of the least ids. They tie with each other for every query, so a search for the `most` best rows finds no others.
    """

    def block(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).sort_by("id")
        m = _matrix(t.column("v"), width)
        ids = t.column("id").combine_chunks()
        if most is not None and len(keep := _first_of_equal(m, most)) < len(m):
            m, ids = m[keep], ids.take(pa.array(keep))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([m.tobytes()], pa.binary())], names=["ids", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, size - n)
                held.append(part)
                n, batch = n + len(part), batch.slice(len(part))
                if n == size:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return run


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


#: What rounding to 6 places may move a score by.
_SLACK = 1e-6
#: Queries that are multiplied with a block of rows at a time, so that the products stay in a core's cache, and pairs that are scored exactly at a time.
TILE, PAIRS = 128, 1 << 14


def _sided(x: np.ndarray, metric: str, query: bool) -> np.ndarray:
    """Vectors whose products are the larger the better a pair is: the cosine, or (l2) half of what the squared length of the query exceeds the distance by."""
    if metric == "cosine":
        return x
    return np.hstack([x, np.ones((len(x), 1)) if query else -(x**2).sum(axis=1, keepdims=True) / 2])


def _single(x: np.ndarray) -> np.ndarray:
    """As single-precision numbers, unless squares of them would not be finite there."""
    return x.astype(np.float32) if not x.size or np.abs(x).max() < 1e15 else x


def _candidates(q: np.ndarray, x: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) among which are all whose product is `least` of i or more and that are of the k best of i.

    Products are made in single precision, a tile of queries at a time; what that may move them by is left as room.
    """
    if not len(x) or not len(q):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    fine_q, fine_x = np.isfinite(q).all(axis=1), np.isfinite(x).all(axis=1)
    if not (fine_q.all() and fine_x.all()):  # vectors without a length: those that are numbers at all are scored with all
        at, to = np.flatnonzero(fine_q), np.flatnonzero(fine_x)
        i, j = _candidates(q[at], x[to], least[at], k)
        odd = ~(fine_q[:, None] & fine_x[None, :]) & ~np.isnan(q).any(axis=1)[:, None] & ~np.isnan(x).any(axis=1)[None, :]
        more = np.nonzero(odd)
        return np.concatenate([at[i], more[0]]), np.concatenate([to[j], more[1]])
    own, rows = _single(q), _single(x)
    if own.dtype != rows.dtype:
        own, rows = q, x
    most = np.sqrt((q[:, :-1] ** 2).sum(axis=1)) * np.sqrt((x[:, :-1] ** 2).sum(axis=1).max()) + np.abs(q[:, -1]) * np.abs(x[:, -1]).max()
    room = (q.shape[1] + 8) * np.finfo(own.dtype).eps * most + 1e-30
    who, what = [], []
    products = np.empty((min(TILE, len(q)), len(x)), own.dtype)
    for a in range(0, len(q), TILE):
        at = slice(a, a + TILE)
        s = np.matmul(own[at], rows.T, out=products[: len(own[at])])
        bar = least[at]
        if len(x) > k and np.isinf(bar).any():
            bar = np.maximum(bar, np.partition(s, len(x) - k, axis=1)[:, len(x) - k] - room[at] - _SLACK)
        bar = np.nextafter((bar - room[at]).astype(s.dtype), -np.inf, dtype=s.dtype)
        some = np.flatnonzero(s.max(axis=1) >= bar)
        if len(some):
            i, j = np.divmod(np.flatnonzero(s[some] >= bar[some, None]), len(x))
            who.append(a + some[i])
            what.append(j)
    return (np.concatenate(who), np.concatenate(what)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _exact(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    """Rounded scores of pairs, less is better."""
    s = np.empty(len(i))
    for a in range(0, len(i), PAIRS):
        at = slice(a, a + PAIRS)
        s[at] = -np.einsum("ij,ij->i", q[i[at]], x[j[at]]) if metric == "cosine" else ((q[i[at]] - x[j[at]]) ** 2).sum(axis=1)
    return np.round(np.maximum(s, 0) + 1e-10, 6) if metric == "l2" else -np.round(1e-10 - s, 6)


def _best_of(k: int, metric: str, widths: tuple[str, str]):
    """Pairs of blocks, those of a query block together, to the k best rows of its queries; near: a bit a cell for each query, set where it reads the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, q, sided, square, qids, near, bound, best = None, None, None, None, None, None, None, None

        def matrix(raw: pa.Scalar, n: int, width: str) -> np.ndarray:
            x = np.frombuffer(raw.as_buffer(), width).reshape(n, -1).astype(np.float64)
            return _unit(x) if metric == "cosine" else x

        def emitted() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best):
                t = best.combine_chunks()
                score = t.column("s").to_numpy()
                ids = t.column("id").combine_chunks()
                out = [qids.take(pa.array(t.column("i").to_numpy())), ids, pa.array((score if metric == "l2" else -score) + 0.0)]
                yield pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out], names=["qid", "id", "score"])

        for batch in batches:
            for at in range(len(batch)):
                name = batch.column("block")[at].as_py()
                if name != now:
                    yield from emitted()
                    now, best = name, None
                    qids = batch.column("qids")[at].values
                    q = matrix(batch.column("qm")[at], len(qids), widths[0])
                    sided, square = _sided(q, metric, True), (q**2).sum(axis=1)
                    bound = np.full(len(qids), np.inf)
                    near = np.frombuffer(batch.column("near")[at].as_buffer(), np.uint8).reshape(len(qids), -1) if "near" in batch.schema.names else None
                ids, who = batch.column("ids")[at].values, np.arange(len(qids))
                if near is not None:
                    cell = batch.column("cell")[at].as_py()
                    who = np.flatnonzero(near[:, cell >> 3] >> (cell & 7) & 1)
                if not len(who):
                    continue
                x = matrix(batch.column("m")[at], len(ids), widths[1])
                least = -bound[who] - _SLACK if metric == "cosine" else (square[who] - bound[who] - _SLACK) / 2
                i, j = _candidates(sided if near is None else sided[who], _sided(x, metric, False), least, k)
                if not len(i):
                    continue
                i = who[i]
                score = _exact(q, x, i, j, metric)
                if np.isnan(score).any():
                    i, j, score = (a[~np.isnan(score)] for a in (i, j, score))
                # Ids ascend in a block, so of equal scores the first k can count only.
                order = np.lexsort((j, score, i))
                i, j, score = i[order], j[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
                i, j, score = i[keep], j[keep], score[keep]
                new, rest = pa.table({"i": i, "s": score, "id": ids.take(pa.array(j))}), None
                if best is not None:
                    hit = np.zeros(len(qids), bool)
                    hit[i] = True
                    hit = hit[best.column("i").to_numpy()]
                    rest = best.filter(pa.array(~hit))
                    new = pa.concat_tables([best.filter(pa.array(hit)), new])
                    new = new.take(pc.sort_indices(new, sort_keys=[("i", "ascending"), ("s", "ascending"), ("id", "ascending")]))
                    i = new.column("i").to_numpy()
                    new = new.filter(pa.array(np.arange(len(i)) - np.searchsorted(i, i, "left") < k))
                i, score = new.column("i").to_numpy(), new.column("s").to_numpy()
                last = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i, "left") == k - 1)
                bound[i[last]] = score[last]
                best = (pa.concat_tables([rest, new]) if rest is not None else new).combine_chunks()
        yield from emitted()

    return run
