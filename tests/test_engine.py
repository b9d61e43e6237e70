from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import search
from corpusmill.operators.crawl import crawl_pages
from corpusmill.operators.embed import HashEmbedding, RateLimited, Retrying
from corpusmill.operators.filters import MetadataFilter, apply
from corpusmill.plans import chat, pipeline
from corpusmill.schema import CHUNK, ChunkConfig, CrawlConfig, IndexConfig
from corpusmill.sources.store import VectorStore
from corpusmill.streaming import ingest

ROWS = [(i, f"http://x/{i}", "t", f"text {i}", 0, 1, 0, 6, v) for i, v in (("a", [1.0, 0.0, 0.0]), ("b", [0.0, 1.0, 0.0]), ("c", [0.0, 0.0, 1.0]))]


@pytest.fixture()
def filled(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "store"), 3)
    s.initialize()
    s.upsert(spark.createDataFrame(ROWS, s.schema))
    return s


def test_store_sequence(spark, filled):
    assert filled.count() == 3 and filled.validate()
    filled.upsert(spark.createDataFrame(ROWS[:1], filled.schema))
    assert filled.count() == 3
    best = filled.similarity_search([0.9, 0.1, 0.0], 1).collect()
    assert [r.id for r in best] == ["a"] and best[0].score == best[0].distance == pytest.approx(0.02)
    assert filled.similarity_search([0.9, 0.1, 0.0], 3, [MetadataFilter("url", "eq", "http://x/b")]).count() == 1
    filled.delete([MetadataFilter("url", "eq", "http://x/a")])
    assert filled.count() == 2
    filled.delete([MetadataFilter("id", "in", ["b"])])
    assert filled.count() == 1
    filled.clear()
    assert filled.count() == 0 and filled.similarity_search([0.0] * 3, 5).count() == 0
    filled.vacuum(1)
    assert len(filled.versions()) == 1


def test_store_refuses(spark, filled):
    with pytest.raises(ValueError):
        filled.delete([])
    with pytest.raises(ValueError):
        filled.similarity_search([1.0], 1)
    before = filled.versions()
    with pytest.raises(Exception, match="components"):
        filled.upsert(spark.createDataFrame([(*ROWS[0][:8], [1.0])], filled.schema))
    assert filled.versions() == before and filled.count() == 3


def test_metrics_differ(spark):
    df = spark.createDataFrame([("far", [3.0, 3.0, 0.0]), ("near", [1.0, 0.5, 0.0]), ("zero", [0.0, 0.0, 0.0])], "id string, embedding array<float>")
    assert search.top_k(df, [1.0, 1.0, 0.0], 1, "cosine").first().id == "far"
    assert search.top_k(df, [1.0, 1.0, 0.0], 1, "l2").first().id == "near"
    assert search.top_k(df, [0.0, 0.0, 0.0], 100).count() == 3
    q = spark.createDataFrame([(1, [1.0, 1.0, 0.0]), (2, [0.0, 0.0, 0.0])], "qid long, embedding array<float>")
    for metric in ("l2", "cosine"):
        got = search.batch_top_k(df, q, 2, metric).where("qid = 1").orderBy("rank").collect()
        assert [r.id for r in got] == [r.id for r in search.top_k(df, [1.0, 1.0, 0.0], 2, metric).collect()]
    assert search.batch_top_k(df, q.limit(0), 2).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([("a%b", 1), ("aXb", 2), (None, 3)], "s string, n int")
    count = lambda *f, **k: apply(df, [MetadataFilter(*x) for x in f], **k).count()
    assert count(("s", "contains", "%")) == 1 and count(("s", "contains", "a%b"), contains="like") == 2 and count(("s", "contains", "A%"), contains="ilike") == 1
    assert count(("s", "neq", "aXb")) == 1 and count(("n", "gt", 1), ("n", "lt", 3)) == 1 and count(("n", "in", [])) == 0 and count(("n", "contains", 2)) == 1
    for bad in (("x", "eq", 1), ("n", "gte", 1), ("n", "in", 1)):
        with pytest.raises(ValueError):
            count(bad)


def test_crawl_of_pages(spark):
    link = lambda *x: "".join(f"<a href='{u}'>" for u in x)
    pages = spark.createDataFrame([("http://s.example/", link("/b", "a", "http://other.example/")), ("http://s.example/a", link("/c.html")), ("http://s.example/b", link("/", "/secret")), ("http://s.example/c.html", link("/d")), ("http://s.example/secret", ""), ("http://other.example/", "")], "url string, html string")
    robots = spark.createDataFrame([("s.example", "User-agent: *\nDisallow: /secret", True)], "host string, rules string, ok boolean")
    got = [(r["rank"], r.url, r.depth) for r in crawl_pages(pages, "http://s.example/", CrawlConfig(10, 2), robots).orderBy("rank").collect()]
    assert got == [(1, "http://s.example/", 0), (2, "http://s.example/b", 1), (3, "http://s.example/a", 1), (4, "http://s.example/c.html", 2)]
    assert crawl_pages(pages, "http://s.example/", CrawlConfig(2, 2)).count() == 2


class Flaky:
    """Fails twice, then gives a constant vector."""

    def __init__(self, fails: int = 2) -> None:
        self.fails = fails

    def embed_batch(self, texts):
        if self.fails:
            self.fails -= 1
            raise RateLimited(delay=0.0)
        return [[1.0, 0.0, 0.0] for _ in texts]

    def model_name(self):
        return "flaky"

    def dimensions(self):
        return 3


def test_retries():
    waits = []
    assert Retrying(Flaky(2), sleep=waits.append).embed_batch(["a", "b"]) == [[1.0, 0.0, 0.0]] * 2 and waits == [0.0, 0.0]
    with pytest.raises(RateLimited):
        Retrying(Flaky(9), sleep=waits.append).embed_batch(["a"])


def test_indexing_and_answers(spark, tmp_path):
    body = "<title>T</title><body><p>" + "The harbour opens at nine in the morning. " * 8 + "</p></body>"
    pages = spark.createDataFrame([("http://x/1", "T", body), ("http://x/2", None, "<p>short</p>")], "url string, title string, html string")
    s, progress = VectorStore(spark, str(tmp_path / "s"), 32), pipeline.Progress()
    results, summary = pipeline.index(pages, s, HashEmbedding(32), IndexConfig(chunk=ChunkConfig(100, 10), min_chars=50), progress)
    got = {r.url: (r.success, r.stage, r.chunks) for r in results.collect()}
    assert got["http://x/1"][0] and got["http://x/2"] == (False, "extract", 0)
    row = summary.first()
    assert (row.pagesVisited, row.pagesIndexed, row.skippedPages) == (2, 1, 1) and row.chunksCreated == row.chunksStored == s.count() > 0
    assert [e[1] for e in progress.events][-1] == "complete" and pipeline.sse_frames(progress.frame(spark)).count() == len(progress.events)
    pipeline.index(pages, s, HashEmbedding(32), IndexConfig(chunk=ChunkConfig(100, 10), min_chars=50))
    assert s.count() == row.chunksStored  # the same content has the same ids
    asked = spark.createDataFrame([(1, "when does the harbour open")], "qid long, text string")
    answer = chat.ask(asked, s.read(), HashEmbedding(32)).first()
    assert "[Source 1]" in answer.answer and answer.sources[0].chunkNumber >= 1 and len(answer.sources) == 3
    none = chat.prompts(asked, chat.retrieve(asked, s.read().limit(0), HashEmbedding(32))).first()
    assert chat.NO_CONTEXT in none.prompt and none.sources is None


def test_failed_batches_mark_their_pages(spark, tmp_path):
    class Broken(HashEmbedding):
        def embed_batch(self, texts):
            raise OSError("fetch failed")

    pages = spark.createDataFrame([("http://x/1", "T", "<p>" + "word " * 100 + "</p>")], "url string, title string, html string")
    s = VectorStore(spark, str(tmp_path / "s"), 8)
    results, summary = pipeline.index(pages, s, Broken(8))
    r = results.first()
    assert (r.success, r.stage) == (False, "embed") and "fetch failed" in r.failureReason and r.chunks > 0
    assert summary.first().chunksStored == 0 and s.count() == 0


def test_cancel(spark, tmp_path):
    pages = spark.createDataFrame([("u", "t", "h")], "url string, title string, html string")
    p = pipeline.Progress(cancelled=lambda: True)
    with pytest.raises(pipeline.Cancelled):
        pipeline.index(pages, VectorStore(spark, str(tmp_path / "s"), 8), HashEmbedding(8), progress=p)
    assert p.events[-1][1] == "cancel"


def test_stream_ingest_is_idempotent(spark, tmp_path):
    src = str(tmp_path / "pages")
    spark.createDataFrame([("http://x/1", "<title>A</title><p>" + "word one two. " * 30 + "</p>")], "url string, html string").write.parquet(src)
    s = VectorStore(spark, str(tmp_path / "s"), 16)
    for k in range(2):
        stream = spark.readStream.schema("url string, html string").parquet(src)
        ingest.ingest(stream, s, HashEmbedding(16), str(tmp_path / f"ck{k}"), ChunkConfig(100, 10)).awaitTermination()
    rows = s.read().collect()
    assert rows and len({r.id for r in rows}) == len(rows) and {r.title for r in rows} == {"A"}


def test_schemas_agree(spark):
    assert [f.name for f in CHUNK] == ["id", "url", "title", "content", "chunkIndex", "totalChunks", "startOffset", "endOffset"]
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_batches_to_python_are_bounded_by_rows_and_bytes(spark):
    from pyspark.sql import types as T

    from corpusmill.operators.chunking import chunks
    from corpusmill.schema import ChunkConfig
    from corpusmill.session import BATCH_BYTES, BATCH_ROWS

    conf = {k: spark.conf.get(f"spark.sql.execution.arrow.{k}") for k in ("maxRecordsPerBatch", "maxBytesPerBatch")}
    for k in conf:
        spark.conf.unset(f"spark.sql.execution.arrow.{k}")
    try:
        chunks(spark.createDataFrame([("u", "t", "x")], "url string, title string, content string"), ChunkConfig(40, 10))

        @F.arrow_udf(T.IntegerType())
        def size(x):
            import pyarrow as pa

            return pa.array([len(x)] * len(x), pa.int32())

        rows = lambda n, chars: spark.range(0, n, 1, 1).select(size(F.repeat(F.lit("x"), chars)).alias("n")).agg(F.max("n")).first()[0]
        assert rows(3000, 10) == BATCH_ROWS and rows(600, 20_000) <= BATCH_BYTES // 20_000 + 1
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        chunks(spark.createDataFrame([("u", "t", "x")], "url string, title string, content string"), ChunkConfig(40, 10))
        assert rows(3000, 10) == 2000  # a session's own choice stays
    finally:
        for k, v in conf.items():
            spark.conf.set(f"spark.sql.execution.arrow.{k}", v)
