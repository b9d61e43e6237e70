"""Writers at odds, replacing by page, replayed batches, stream progress, page counts, and the recall of the cell index."""

from __future__ import annotations

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import html
from corpusmill.operators import ann, search
from corpusmill.operators.embed import HashEmbedding
from corpusmill.plans import pipeline
from corpusmill.schema import ChunkConfig, IndexConfig
from corpusmill.session import table
from corpusmill.sources import store as store_module
from corpusmill.sources.store import Conflict, VectorStore
from corpusmill.streaming import ingest
from corpusmill.streaming.progress import StreamProgress

SMALL = "id long, url string, embedding array<float>"


def store(spark, path) -> VectorStore:
    s = VectorStore(spark, str(path), 2, T.StructType.fromDDL(SMALL))
    s.initialize()
    return s


def rows(spark, *ids, url="u"):
    return spark.createDataFrame([(i, url, [float(i), 0.0]) for i in ids], SMALL).coalesce(1)


def held(s):
    return sorted((r.id, r.url) for r in s.read().collect())


def test_interleaved_writers_lose_nothing(spark, tmp_path):
    a, b = store(spark, tmp_path / "s"), store(spark, tmp_path / "s")
    a.upsert(rows(spark, 1))
    began = a._commit

    def write_after_the_other(parts):
        assert b.upsert(rows(spark, 2)) == 1  # another writer publishes between this one's reading and publishing
        return [a._write(rows(spark, 3))]

    with pytest.raises(Conflict):
        began(write_after_the_other)
    assert held(a) == [(1, "u"), (2, "u")]
    a.upsert(rows(spark, 3))
    assert held(b) == [(1, "u"), (2, "u"), (3, "u")]
    assert not glob.glob(str(tmp_path / "s" / "t-*"))


def test_an_incomplete_newest_manifest_stops_writers_until_vacuum(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    s.upsert(rows(spark, 1))
    (tmp_path / "s" / "m-0000000003").write_text('{"parts": [')
    assert held(s) == [(1, "u")]
    for call in (lambda: s.upsert(rows(spark, 2)), lambda: s.replace(rows(spark, 2), rows(spark, 2).select("url")), s.clear):
        with pytest.raises(Conflict):
            call()
    s.vacuum()
    s.upsert(rows(spark, 2))
    assert held(s) == [(1, "u"), (2, "u")]


def test_errors_of_the_filesystem_are_no_conflicts(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    last, _ = s._newest()
    with pytest.raises(Conflict):
        s._publish([], last - 1)
    s.path += "\0"
    with pytest.raises(Exception) as e:
        s._publish([], last)
    assert not isinstance(e.value, Conflict)


def test_replace_takes_the_place_of_a_key_in_one_version(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    s.upsert(rows(spark, 1, 2, 3, url="a").union(rows(spark, 4, 5, url="b")).union(rows(spark, 6, url=None)).union(rows(spark, 7, url="c")))
    before = s.versions()
    keys = spark.createDataFrame([("a",), ("c",)], "url string")
    assert s.replace(rows(spark, 2, 9, url="a"), keys) == 2
    assert held(s) == [(2, "a"), (4, "b"), (5, "b"), (6, None), (9, "a")]
    assert len(s.versions()) == len(before) + 1
    s.replace(rows(spark), spark.createDataFrame([(None,)], "url string"))
    assert [i for i, _ in held(s)] == [2, 4, 5, 9]
    with pytest.raises(Exception, match="components"):
        s.replace(spark.createDataFrame([(1, "b", [1.0])], SMALL), keys)
    assert [i for i, _ in held(s)] == [2, 4, 5, 9]


def test_validate_reads_no_rows_and_knows_the_dimension(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    s.upsert(rows(spark, 1))
    assert s.validate() and not VectorStore(spark, s.path, 3, s.schema).validate() and not VectorStore(spark, str(tmp_path / "none"), 2).validate()


def page(text):
    return "<title>T</title><p>" + text * 30 + "</p>"


PAGES = "url string, html string"


def test_a_batch_that_was_published_before_a_crash_is_not_published_again(spark, tmp_path, monkeypatch):
    src, s = str(tmp_path / "pages"), VectorStore(spark, str(tmp_path / "s"), 8)
    spark.createDataFrame([("http://x/1", page("word one two. "))], PAGES).write.parquet(src)
    real = s.replace

    def publish_and_die(*a, **k):
        real(*a, **k)
        raise OSError("killed between publish and checkpoint")

    def run():
        stream = spark.readStream.schema(PAGES).parquet(src)
        ingest.ingest(stream, s, HashEmbedding(8), str(tmp_path / "checkpoint"), ChunkConfig(100, 10)).awaitTermination()

    monkeypatch.setattr(s, "replace", publish_and_die)
    with pytest.raises(Exception, match="killed"):
        run()
    after = s.versions()
    monkeypatch.setattr(s, "replace", real)
    run()
    assert s.versions() == after and s.applied(f"stream {tmp_path / 'checkpoint'}") == 0
    spark.createDataFrame([("http://x/1", page("another text. "))], PAGES).write.mode("append").parquet(src)
    run()
    got = s.read().collect()
    assert len(s.versions()) == len(after) + 1 and got and not any("word" in r.content for r in got)


def test_ledger_outlives_clear_and_merges(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    for b in range(12):
        assert s.upsert(rows(spark, b), batch=("x", b)) == 1 and s.upsert(rows(spark, 100 + b), batch=("x", b)) == 0
    assert [i for i, _ in held(s)] == list(range(12))
    s.clear()
    assert s.applied("x") == 11 and s.applied("y") == -1 and held(s) == []


def test_a_failed_stream_is_an_event(spark, tmp_path):
    src, log = str(tmp_path / "pages"), pipeline.Progress()
    spark.createDataFrame([("http://x/1", page("word. "))], PAGES).write.parquet(src)

    class Broken(HashEmbedding):
        def embed_batch(self, texts):
            raise ValueError("no vectors")

    listener = StreamProgress(log)
    q = ingest.ingest(spark.readStream.schema(PAGES).parquet(src), VectorStore(spark, str(tmp_path / "s"), 8), Broken(8), str(tmp_path / "c"), progress=listener)
    with pytest.raises(Exception, match="no vectors"):
        q.awaitTermination()
    assert listener.wait(q.runId)
    listener.detach()
    assert [e[1] for e in log.events] == ["initialize", "cancel"]


def test_indexing_again_replaces_pages(spark, tmp_path):
    s = VectorStore(spark, str(tmp_path / "s"), 8)
    cfg = IndexConfig(chunk=ChunkConfig(100, 10), replace_pages=True)
    pages = lambda *r: spark.createDataFrame(list(r), PAGES)
    pipeline.index(pages(("http://x/1", page("first words. ")), ("http://x/2", page("other words. "))), s, HashEmbedding(8), cfg)
    _, summary = pipeline.index(pages(("http://x/1", page("changed. ")), ("http://x/2", "short")), s, HashEmbedding(8), cfg)
    by_url = {}
    for r in s.read().collect():
        by_url.setdefault(r.url, []).append(r.content)
    assert not any("first" in c for c in by_url["http://x/1"]) and summary.first().chunksStored == len(by_url["http://x/1"])
    assert any("other" in c for c in by_url["http://x/2"])  # a page that gave no text keeps what it had


def test_results_are_pages_in_the_order_of_visit(spark, tmp_path):
    text = page("some words here. ")
    pages = spark.createDataFrame([("http://x/b", text, 1), ("http://x/a", text, 2), (None, text, 3), ("http://x/b", text, 4)], PAGES + ", rank int")

    s = VectorStore(spark, str(tmp_path / "s"), 8)
    results, summary = pipeline.index(pages, s, HashEmbedding(8), IndexConfig(chunk=ChunkConfig(100, 10), batch_size=4))
    got, row = results.collect(), summary.first()
    assert len(got) == 4 and sum(r.url == "http://x/b" for r in got) == 2 and all(r.success for r in got)
    assert row.chunksCreated == sum(r.chunks for r in got) and row.chunksStored == s.count() == 3 * got[0].chunks

    class FirstFails(HashEmbedding):
        """The batch that holds the first page's first chunk and no other page's."""

        def embed_batch(self, texts):
            if all("o" in t for t in texts):
                raise ValueError("five")
            return super().embed_batch(texts)

    odd = spark.createDataFrame([("http://x/z", page("some words here. "), 1), ("http://x/a", "<p>" + "b" * 120 + "</p>", 2)], PAGES + ", rank int")
    first = pipeline.extract_pages(odd).where("url = 'http://x/z'").first()
    assert first["rank"] == 1
    results, _ = pipeline.index(odd, VectorStore(spark, str(tmp_path / "s2"), 8), FirstFails(8), IndexConfig(chunk=ChunkConfig(100, 10), batch_size=5))
    assert {r.url: r.success for r in results.collect()} == {"http://x/z": False, "http://x/a": True}


def test_hostile_declarations_are_rows_in_every_column(spark):
    bad = ["<![foo[x]]><title>t</title><a href='/x'>y</a>", "<![ [", "<!", "<![CDATA[", "<!DOCTYPE", "<!ELEMENT x>", None, "<a href=", "\0"]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "i int, html string")
    got = df.select("i", html.title(F.col("html")).alias("t"), html.links(F.col("html")).alias("l"), html.to_text(F.lit("u"), F.col("html")).alias("c"), html.page(F.lit("u"), F.col("html"))["error"].alias("e")).orderBy("i").collect()
    assert len(got) == len(bad) and (got[0].t, got[0].l, got[0].c) == ("t", ["/x"], "ty") and all(r.e is None for r in got)


def test_content_scoring_takes_the_prose():
    prose = "<p>" + "A sentence with commas, and more, of some length. " * 4 + "</p>"
    links = "<ul>" + "<li><a href='/x'>one, two, three, and a link text of length</a></li>" * 40 + "</ul>"
    text = lambda body: html.extract_one("http://h/x", f"<body>{body}</body>", "main_content")
    story = html.clean(html.render(html.parse(prose)))
    assert text(f"<div>{links}</div><div>{prose}</div>") == story
    assert text(f"<div class='sidebar'>{prose * 2}</div><div class='post-body'>{prose * 2}</div><div><p><a href='/'>{'x, ' * 400}</a></p></div>") == f"{story}\n\n{story}"
    assert text("<div>short</div><article>art</article>") == "art"  # not enough prose: the article element
    assert text("<div>short</div><p>page</p>") == html.extract_one("u", "<body><div>short</div><p>page</p></body>")
    nested = "<div>" * 20_000 + prose + "</div>" * 20_000
    assert text(nested) == story


def test_recall_of_the_cell_index(spark, tmp_path):
    e = table(spark, "/root/testdata/sf0.01", "embeddings")
    asked = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid")
    for metric in ("cosine", "l2"):
        index = ann.CellIndex.build(e, str(tmp_path / metric), 22, metric, id_col="vec_id")
        want = {(r.qid, r.id) for r in search.batch_top_k(e, asked, 5, metric, id_col="vec_id").collect()}
        probes = index.probes_for(asked, 5, 0.92)
        assert 1 < probes < 22
        got = {(r.qid, r.id) for r in ann.CellIndex(spark, index.path).batch_top_k(asked, 5, probes).collect()}
        assert len(got & want) >= 0.9 * len(want)
        assert {(r.qid, r.id) for r in index.batch_top_k(asked, 5, 22).collect()} == want
        assert index.rows().count() == e.count()


def test_few_cells_are_read(spark, tmp_path):
    rng = np.random.default_rng(3)
    data = [(i, (rng.normal(0, 0.1, 4) + 10 * np.eye(4)[i % 4]).tolist()) for i in range(400)] + [(None, [1.0] * 4), (999, None)]
    df = spark.createDataFrame(data, "id long, embedding array<float>")
    index = ann.CellIndex.build(df, str(tmp_path / "i"), 4, "l2")
    one = df.where("id = 5").withColumnRenamed("id", "qid")
    plan = index.rows().where(F.col("cell").isin([1]))._jdf.queryExecution().toString()
    assert "PartitionFilters: [cell" in plan.replace("isnotnull(cell", "cell") or "PartitionFilters: [isnotnull(cell" in plan
    got = index.batch_top_k(one, 3, 1).orderBy("rank").collect()
    assert got[0].id == 5 and got[0].score == 0 and all(r.id % 4 == 1 for r in got)
    empty = ann.CellIndex.build(df.limit(0), str(tmp_path / "e"), 4)
    assert empty.batch_top_k(one, 3, 2).count() == 0 and index.batch_top_k(one.limit(0), 3, 2).count() == 0
    for bad in (lambda: index.batch_top_k(one, 0, 1), lambda: ann.CellIndex.build(df, "x", 0), lambda: ann.CellIndex.build(df, "x", 1, "dot")):
        with pytest.raises(ValueError):
            bad()


def test_only_rows_whose_ids_are_given_twice_are_moved_to_find_the_last(spark, tmp_path, monkeypatch):
    moved = []
    keep = store_module.last_wins
    monkeypatch.setattr(store_module, "last_wins", lambda rows, *a: moved.append(rows.count()) or keep(rows, *a))
    for written in (False, True):
        s = VectorStore(spark, str(tmp_path / f"s{written}"), 1, T.StructType.fromDDL("id long, n int, embedding array<float>"))
        s.initialize()
        rows = spark.range(1000).selectExpr("id", "0 AS n", "array(1f) AS embedding")
        assert s.upsert(rows, written=written) == 1000 and moved == []
        twice = rows.union(rows.where("id % 100 = 0").withColumn("n", F.lit(1)))
        assert s.upsert(twice, ordinal="n", written=written) == 1000 and moved == [20]
        assert s.read().where("n = 1").count() == 10 and s.count() == 1000
        assert len(s._names("p-")) == 2  # a part that was written only to be looked at is gone
        moved.clear()


def test_a_filter_by_what_was_read_does_not_parse_pages_twice(spark):
    pages = spark.createDataFrame([("u", "<p>" + "words of a page. " * 20 + "</p>")], "url string, html string")
    plan = ingest.to_vectors(pages, HashEmbedding(8), ChunkConfig(100, 10))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- ArrowEvalPython") == 3  # parsed, cut, embedded
