"""Retries, failures as rows, writers at odds, and the cost of many small upserts."""

from __future__ import annotations

import glob
import sqlite3
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import html
from corpusmill.operators import search
from corpusmill.operators.crawl import TableCrawler
from corpusmill.operators.embed import BackingOff, HashEmbedding, ProviderError, RateLimited
from corpusmill.operators.filters import MetadataFilter
from corpusmill.plans import chat, pipeline
from corpusmill.schema import IndexConfig
from corpusmill.session import saved, shared_root
from corpusmill.sources import config
from corpusmill.sources.batched import upsert_batches
from corpusmill.sources.store import VectorStore

SMALL = "id long, embedding array<float>"


def small_store(spark, path) -> VectorStore:
    from pyspark.sql import types as T

    s = VectorStore(spark, str(path), 2, T.StructType.fromDDL(SMALL))
    s.initialize()
    return s


def rows(spark, *ids, value=0.0):
    return spark.createDataFrame([(i, [float(i), value]) for i in ids], SMALL).coalesce(1)


class Failing:
    """Raises the given errors one after the other, then answers."""

    def __init__(self, *errors: Exception) -> None:
        self.errors = list(errors)

    def embed_batch(self, texts):
        if self.errors:
            raise self.errors.pop(0)
        return [[1.0]] * len(texts)

    def generate(self, prompt, temperature=None, max_output_tokens=None):
        return str(len(self.embed_batch([prompt])))


def test_backoff_doubles_and_knows_what_to_retry():
    waits = []
    assert BackingOff(Failing(ProviderError("x", 503), OSError("fetch failed"), ProviderError("x", 500)), sleep=waits.append).embed_batch(["a"]) == [[1.0]]
    assert waits == [1.0, 2.0, 4.0]
    for error in (ProviderError("bad", 400), RateLimited(), ValueError("no")):
        with pytest.raises(type(error)):
            BackingOff(Failing(error), sleep=waits.append).embed_batch(["a"])
    with pytest.raises(ProviderError):
        BackingOff(Failing(*[ProviderError("x", 502)] * 4), sleep=waits.append).embed_batch(["a"])
    assert len(waits) == 6
    assert chat.BackingOffChat(Failing(RateLimited()), sleep=waits.append).generate("p") == "1"


def test_hostile_page_gives_a_row():
    deep = "<div>" * 100_000 + "<a href='/x'>x</a>" + "</div>" * 100_000
    got = html.page_one("http://h/", deep)
    assert got["content"] == "x" and got["links"] == ["/x"] and got["error"] is None


def test_many_small_upserts_write_little_and_read_right(spark, tmp_path):
    s, want = small_store(spark, tmp_path / "s"), {}
    for b in range(20):
        ids = [b * 5 + j for j in range(10)]
        s.upsert(rows(spark, *ids, value=float(b)))
        want |= {i: float(b) for i in ids}
        if b in (7, 13):
            s.delete([MetadataFilter("id", "in", [3, b * 5])])
            want = {i: v for i, v in want.items() if i not in (3, b * 5)}
    assert {r.id: r.embedding[1] for r in s.read().collect()} == want
    written = sum(spark.read.parquet(p).count() for p in glob.glob(str(tmp_path / "s" / "p-*")))
    assert written < 3 * 20 * 10
    assert s.read(s.versions()[3]).count() == 20  # the empty one and three upserts
    s.vacuum(1)
    assert {r.id: r.embedding[1] for r in s.read().collect()} == want and len(s.versions()) == 1


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_batch_search_equals_single_searches(spark, monkeypatch, metric):
    for name, value in (("QUERY_BLOCK", 3), ("ROW_BLOCK", 7)):
        monkeypatch.setattr(search, name, value)
    rng = np.random.default_rng(1)
    data = [(i, rng.integers(-2, 3, 3).astype(float).tolist()) for i in range(60)] + [(None, [1.0, 1.0, 1.0]), (99, None)]
    df = spark.createDataFrame(data, "id long, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(q, data[q][1]) for q in range(8)], "qid long, embedding array<float>")
    good = df.where("id IS NOT NULL AND embedding IS NOT NULL")
    for limit in (1 << 26, 0):  # query blocks broadcast, and paired by tasks
        monkeypatch.setattr(search, "BROADCAST_BLOCKS", limit)
        got = {}
        for r in search.batch_top_k(df, asked, 4, metric).orderBy("qid", "rank").collect():
            got.setdefault(r.qid, []).append(r.id)
        assert got == {q: [r.id for r in search.top_k(good, data[q][1], 4, metric).collect()] for q in range(8)}


class Sqlite:
    """Refuses rows with a negative id, call by call."""

    def __init__(self, path: str) -> None:
        self.path = path

    def upsert(self, rows):
        if any(r["id"] < 0 for r in rows):
            raise ValueError("negative")
        with sqlite3.connect(self.path, timeout=60) as con:
            con.executemany("INSERT INTO t VALUES (:id, :v) ON CONFLICT (id) DO UPDATE SET v = excluded.v", rows)


def test_batched_upserts(spark, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
    df = spark.createDataFrame([(i, f"{o}", o) for o in (0, 1) for i in range(450)], "id long, v string, o int")
    calls = upsert_batches(df, Sqlite(path), ordinal="o").collect()
    assert sum(r.rows for r in calls) == 450 and max(r.rows for r in calls) <= 200 and not any(r.error for r in calls)
    with sqlite3.connect(path) as con:
        assert con.execute("SELECT count(*), min(v) FROM t").fetchone() == (450, "1")
    bad = upsert_batches(df.limit(1).selectExpr("-1L AS id", "v", "o"), Sqlite(path)).collect()
    assert [r.error for r in bad] == ["ValueError: negative"]


def test_store_named_by_settings(spark, tmp_path):
    try:
        spark.conf.set(config.KIND, "path")
        with pytest.raises(ValueError):
            config.open_store(spark)
        spark.conf.set(config.PATH, str(tmp_path))
        spark.conf.set(config.DIMENSION, "4")
        s = config.open_store(spark, "x")
        assert s.path == f"{tmp_path}/x" and s.dimension == 4 and s.count() == 0
        spark.conf.set(config.KIND, "elsewhere")
        with pytest.raises(ValueError):
            config.open_store(spark)
    finally:
        for c in (config.KIND, config.PATH, config.DIMENSION):
            spark.conf.unset(c)
    assert config.open_store(spark).dimension == config.DEFAULT_DIMENSION


def site(spark):
    page = lambda n, *to: (f"http://s.example/{n}", "".join(f"<a href='/{t}'>" for t in to) + "<p>" + "word " * 200 + "</p>", 404 if n == "c" else 200)
    return spark.createDataFrame([page("a", "b", "c"), page("b", "d"), page("c", "e"), page("d"), page("e")], "url string, html string, status int")


def test_run_from_a_start_url(spark, tmp_path):
    s, p = VectorStore(spark, str(tmp_path / "s"), 8), pipeline.Progress()
    results, summary = pipeline.index_site("http://s.example/a", TableCrawler(site(spark)), s, HashEmbedding(8), IndexConfig(clear_existing=True), p)
    assert sorted(r.url[-1] for r in results.where("success").collect()) == ["a", "b", "d"]
    row = summary.first()
    assert row.pagesVisited == 3 and row.chunksStored == row.chunksCreated == s.count() > 0
    assert all(row[c] >= 0 for c in (*pipeline.DURATIONS.values(), "totalDuration", "embeddingMsPerChunk"))
    assert [e[1] for e in p.events] == ["initialize", "validate", "crawl", "extract", "chunk", "embed", "store", "complete"]
    pipeline.index_site("http://s.example/d", TableCrawler(site(spark)), s, HashEmbedding(8), IndexConfig(clear_existing=True))
    assert {r.url for r in s.read().collect()} == {"http://s.example/d"}


def test_store_failures_are_rows(spark, tmp_path, monkeypatch):
    wide = HashEmbedding(9)
    s = VectorStore(spark, str(tmp_path / "s"), 8)
    results, summary = pipeline.index(site(spark), s, wide)
    assert {(r.success, r.stage, r.failureReason) for r in results.collect()} == {(False, "store", "vectors of 9 components")} and summary.first().chunksStored == 0

    def full(*a):
        raise OSError("disk full")

    monkeypatch.setattr(s, "upsert", full)
    results, summary = pipeline.index(site(spark), s, HashEmbedding(8))
    assert {(r.success, r.stage, r.failureReason) for r in results.collect()} == {(False, "store", "OSError: disk full")} and summary.first().chunksStored == 0


class Slow(HashEmbedding):
    def embed_batch(self, texts):
        time.sleep(60)


def test_cancel_interrupts_running_jobs(spark, tmp_path):
    p = pipeline.Progress()
    p.cancelled = lambda: any(e[1] == "embed" for e in p.events)
    began = time.monotonic()
    with pytest.raises(pipeline.Cancelled):
        pipeline.index(site(spark), VectorStore(spark, str(tmp_path / "s"), 8), Slow(8), progress=p)
    assert time.monotonic() - began < 50 and p.events[-1][1] == "cancel"


def test_batches_told_from_page_sizes_are_those_of_the_sorted_chunks(spark):
    pages = spark.range(0, 90, numPartitions=3).withColumn("page", F.monotonically_increasing_id()).where("id % 7 != 3")
    cut = saved(pages.select("page", F.explode(F.sequence(F.lit(0), (F.col("id") % 5).cast("int"))).alias("chunkIndex")), "test-cut")
    per_page = saved(cut.groupBy("page").agg(F.count("*").cast("int").alias("chunks")), "test-sizes")
    rows = lambda df: sorted((r.page, r.chunkIndex, r.batch) for r in df.collect())
    got = pipeline.page_batches(cut, per_page, 4)
    assert rows(got) == rows(pipeline.with_batches(cut, 4, "page", "chunkIndex"))
    assert "Sort" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_run_leaves_no_table_of_texts_or_chunks(spark, tmp_path):
    before = set(glob.glob(f"{shared_root(spark).removeprefix('file:')}/corpusmill/*"))
    s = VectorStore(spark, str(tmp_path / "s"), 8)
    pages = spark.createDataFrame([(f"http://x/{i}", "<p>" + f"words of page {i}. " * 20 + "</p>") for i in range(5)], "url string, html string")
    results, _ = pipeline.index(pages, s, HashEmbedding(8))
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(glob.glob(f"{shared_root(spark).removeprefix('file:')}/corpusmill/*")) - before}
    assert left and not left & {"texts", "chunks", "numbered"}
    assert results.where("success").count() == 5 and s.count() == results.agg(F.sum("chunks")).first()[0]
