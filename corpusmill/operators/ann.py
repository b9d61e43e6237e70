"""Approximate top-k over a written index: vectors in coarse cells, of which a search reads the nearest few and ranks their rows exactly.

Cells are the centres of a k-means fitted on a sample of at most SAMPLE vectors, in the order of a hash of their ids; every row is then
assigned to its nearest centre and written into that cell's folder. A search finds the `probes` nearest centres of each query, reads
those folders only (partition pruning), and scores queries against rows of the same cell in blocks, one matrix product a pair. Cells that
hold many rows are many blocks of several tasks, so a cell with a third of all rows is no task of its own.

How many cells a recall takes depends on the vectors: `probes_for` measures it. With as many probes as cells the result is that of the exact search. Null ids and vectors are left out; an empty table has one empty cell.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators.search import ROW_BLOCK, _packer, _unit, _width, batch_top_k, met
from corpusmill.session import bounded_batches, saved

#: Most vectors that the centres are fitted on, and rounds of k-means.
SAMPLE, ROUNDS = 20_000, 12
#: Queries of one block: fewer than in a search of all rows, as a block meets the cells that any of its queries reads.
QUERY_BLOCK = 1024


def _nearest(x: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    """The n nearest centres of every vector, nearest first; ties by number."""
    if len(centres) == 1:  # that of an empty table has no length
        return np.zeros((len(x), 1), np.int64)
    far = (centres**2).sum(axis=1)[None, :] - 2 * (x @ centres.T)
    return np.argsort(far, axis=1, kind="stable")[:, :n]


def fit_cells(x: np.ndarray, cells: int, seed: int = 1) -> np.ndarray:
    """Centres by k-means; a cell that loses all its vectors takes the vector furthest from its centre."""
    rng = np.random.default_rng(seed)
    cells = max(1, min(cells, len(x)))
    centres = x[rng.choice(len(x), cells, replace=False)].copy() if len(x) else np.zeros((1, x.shape[1]))
    for _ in range(ROUNDS if len(x) else 0):
        own = _nearest(x, centres, 1)[:, 0]
        size = np.bincount(own, minlength=cells)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        off = ((x - centres[own]) ** 2).sum(axis=1)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
        empty = np.flatnonzero(size == 0)
        centres[empty] = x[np.argsort(-off, kind="stable")[: len(empty)]]
    return centres


class CellIndex:
    """An index on disk: `centres`, one row with the centres and the metric, and `rows`, partitioned by cell."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        row = spark.read.schema("centres binary, about string").parquet(f"{self.path}/centres").first()
        about = json.loads(row.about)
        self.metric, self.cells, self.schema = about["metric"], about["cells"], T.StructType.fromJson(about["schema"])
        self.centres = np.frombuffer(row.centres, np.float64).reshape(about["cells"], -1)

    @classmethod
    def build(cls, df: DataFrame, path: str, cells: int, metric: str = "cosine", id_col: str = "id", vec_col: str = "embedding", sample: int = SAMPLE) -> CellIndex:
        """Fit on a sample, assign and write every row. cells: of the order of the square root of the number of rows."""
        if metric not in ("l2", "cosine"):
            raise ValueError(f"unknown metric {metric!r}")
        if cells <= 0:
            raise ValueError("cells must be over 0")
        bounded_batches(df.sparkSession)
        spark = df.sparkSession
        rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
        taken = rows.orderBy(F.xxhash64(F.lit("cells"), F.col("id")), "id").limit(sample).collect()
        x = np.asarray([r.v for r in taken], np.float64) if taken else np.zeros((0, 1))
        centres = fit_cells(_unit(x) if metric == "cosine" else x, cells)
        schema = T.StructType([*rows.schema, T.StructField("cell", T.IntegerType())])
        about = json.dumps({"metric": metric, "cells": len(centres), "schema": schema.jsonValue()})
        spark.createDataFrame([(bytearray(np.ascontiguousarray(centres).tobytes()), about)], "centres binary, about string").coalesce(1).write.parquet(f"{path}/centres")
        cell = _cells(centres, metric, 1)(F.col("v"))[0]
        # Ranges of cells and, inside a cell, of hashed ids: a large cell is several tasks' work, and a task writes few files.
        assigned = rows.withColumn("cell", cell).repartitionByRange("cell", F.xxhash64("id"))
        assigned.write.partitionBy("cell").parquet(f"{path}/rows")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    def batch_top_k(self, queries: DataFrame, k: int, probes: int, query_id: str = "qid", query_vec: str = "embedding") -> DataFrame:
        """(qid, rank, id, score) as the exact batch search gives them, of the rows in the `probes` cells nearest to each query.

        A query is written once, with a bit for each cell that it reads, among queries of the same nearest cell; a block of queries meets the cells that any of them reads.
        """
        if k <= 0 or probes <= 0:
            raise ValueError("k and probes must be over 0")
        bounded_batches(self.spark)
        asked = queries.select(F.col(query_id).alias("id"), F.col(query_vec).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
        rows = self.rows()
        qid, rid = asked.schema["id"].dataType, rows.schema["id"].dataType
        placed = asked.withColumn("cell", _cells(self.centres, self.metric, 1)(F.col("v"))[0]).repartitionByRange("cell", F.xxhash64("id")).sortWithinPartitions("cell").select("id", "v")
        packed = placed.mapInArrow(_probing(self.centres, self.metric, min(probes, self.cells), _width(asked)), f"ids array<{qid.simpleString()}>, m binary, near binary, cells array<int>")
        packed = saved(packed.select(F.expr("uuid()").alias("block"), F.col("ids").alias("qids"), F.col("m").alias("qm"), "near", "cells"), "ann-queries")
        # The cells that are read at all: a list of at most `cells` numbers, pushed into the scan as a partition filter.
        read = sorted(r.cell for r in packed.select(F.explode("cells").alias("cell")).distinct().collect())
        rows = rows.where(F.col("cell").isin(read)) if read else rows.limit(0)
        # Files hold one cell each, so rows of a cell come together without a shuffle.
        blocks = rows.select("cell", "id", "v").mapInArrow(_cell_packer(ROW_BLOCK, _width(rows.select("v"))), f"cell int, ids array<{rid.simpleString()}>, m binary")
        return met(packed, saved(blocks, "ann-rows"), F.array_contains("cells", F.col("cell")), k, self.metric, f"qid {qid.simpleString()}, id {rid.simpleString()}, score double", (_width(asked), _width(rows.select("v"))))

    def probes_for(self, queries: DataFrame, k: int, recall: float = 0.9, most: int = 200, query_id: str = "qid", query_vec: str = "embedding") -> int:
        """The least number of probes that finds at least that share of the exact k best, measured by an exact search of at most `most` of the queries, in the order of a hash."""
        asked = queries.select(F.col(query_id).alias("qid"), F.col(query_vec).alias("embedding")).where("qid IS NOT NULL AND embedding IS NOT NULL")
        asked = saved(asked.orderBy(F.xxhash64(F.lit("tune"), F.col("qid")), "qid").limit(most), "ann-tuning")
        exact = batch_top_k(self.rows(), asked, k, self.metric, vec_col="v").select("qid", "id")
        order = asked.select("qid", _cells(self.centres, self.metric, self.cells)(F.col("embedding")).alias("cells"))
        placed = exact.join(self.rows().select("id", "cell"), "id").join(order, "qid")
        hits = placed.groupBy(F.array_position("cells", F.col("cell")).alias("place")).count().collect()  # one row a cell at most
        total, found = sum(r["count"] for r in hits), 0
        for place, n in sorted((r.place, r["count"]) for r in hits):
            found += n
            if found >= recall * total:
                return int(place)
        return self.cells


def _cells(centres: np.ndarray, metric: str, n: int):
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def run(vectors: pa.Array) -> pa.Array:
        near = np.zeros((0, n), np.int64)
        if len(vectors):
            x = np.asarray(vectors.to_pylist(), np.float64)
            near = _nearest(_unit(x) if metric == "cosine" else x, centres, n)
        off = np.arange(0, near.size + 1, max(n, 1), dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(off), pa.array(near.astype(np.int32).ravel()))

    return run


def _probing(centres: np.ndarray, metric: str, probes: int, width: str):
    """Rows (id, v) to query blocks (ids, m, near, cells): `near` has a bit a cell for every query, `cells` those that any query of the block reads."""
    pack = _packer(QUERY_BLOCK, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pack(batches):
            n = len(b.column("ids")[0].values)
            x = np.frombuffer(b.column("m")[0].as_buffer(), width).reshape(n, -1).astype(np.float64)
            bits = np.zeros((n, len(centres)), np.uint8)
            np.put_along_axis(bits, _nearest(_unit(x) if metric == "cosine" else x, centres, probes), 1, axis=1)
            cells = np.flatnonzero(bits.any(axis=0)).astype(np.int32)
            near = np.packbits(bits, axis=1, bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([near], pa.binary()), pa.array([cells], pa.list_(pa.int32()))], names=["ids", "m", "near", "cells"])

    return run


def _cell_packer(size: int, width: str = "f8"):
    """Rows (cell, id, v) to blocks (cell, ids, m) of up to `size` vectors of one cell; a cell that comes in pieces is several blocks."""
    pack = _packer(size, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now: int | None = None

        def packed() -> Iterator[pa.RecordBatch]:
            for b in pack(iter(held)):
                yield pa.RecordBatch.from_arrays([pa.array([now] * len(b), pa.int32()), *b.columns], names=["cell", "ids", "m"])
            held.clear()

        for batch in batches:
            cells = batch.column("cell").to_numpy(zero_copy_only=False)
            edges = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(cells)]]) if len(cells) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if now != cells[a] or sum(map(len, held)) >= size:
                    yield from packed()
                    now = int(cells[a])
                held.append(batch.slice(a, b - a).select(["id", "v"]))
        yield from packed()

    return run
