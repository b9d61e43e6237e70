"""Indexing: pages -> text -> chunks -> vectors -> store, with failures as rows.

A page or batch that fails never ends the run: it becomes a result row with the stage it failed in. A page with
any chunk in a failed batch counts as failed, while its chunks of other batches are stored.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import html, vector
from corpusmill.operators.chunking import chunks
from corpusmill.operators.crawl import Crawler
from corpusmill.operators.embed import EmbeddingProvider
from corpusmill.schema import EVENT_STAGES, PROGRESS_EVENT, CrawlConfig, IndexConfig
from corpusmill.session import bounded_batches, discard, saved, saved_rows, sized_join, written
from corpusmill.sources.store import VectorStore


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """Add `row`, the 0-based place in the order, without sorting in one task: places inside range partitions, plus the rows before each."""
    placed = saved(df.orderBy(*order).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().alias("__i")), "numbered")
    sizes = placed.groupBy("__p").agg(F.count("*").alias("n"))
    before = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inside = F.col("__i") - F.shiftleft(F.col("__p").cast("long"), 33)
    return placed.join(before, "__p").withColumn("row", inside + F.col("__b")).drop("__p", "__i", "__b")


def with_batches(chunk_rows: DataFrame, size: int, *order: str) -> DataFrame:
    """Add batch (from 1): floor(place / size) + 1."""
    return numbered(chunk_rows, *order).withColumn("batch", (F.floor(F.col("row") / size) + 1).cast("int"))


def page_batches(cut: DataFrame, per_page: DataFrame, size: int) -> DataFrame:
    """`with_batches` of all chunks of pages in the order of page and chunkIndex, told from the numbers of chunks (page, chunks; written): no chunk is sorted or written for it.

    Pages are numbered as `monotonically_increasing_id` does, so their upper bits name a range of pages.
    """
    ranged = per_page.select("page", "chunks", F.shiftright("page", 33).alias("__p"))
    sizes = ranged.groupBy("__p").agg(F.sum("chunks").alias("n"))  # one row a range
    before = sizes.select("__p", F.coalesce(F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inside = F.coalesce(F.sum("chunks").over(Window.partitionBy("__p").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first, pages = saved_rows(ranged.join(F.broadcast(before), "__p").select("page", (inside + F.col("__b")).alias("__first")), "page-first")
    placed = sized_join(cut, first, ["page"], "inner", 16 * pages)
    return placed.withColumn("batch", (F.floor((F.col("__first") + F.col("chunkIndex")) / size) + 1).cast("int")).drop("__first")


def mark_failures(results: DataFrame, chunk_rows: DataFrame, failed: DataFrame, page: str = "url") -> DataFrame:
    """Results after batches failed. failed: (batch, stage, reason); of a page's failed batches the first counts; earlier failures stay. `page` names a page in both tables; null names one."""
    hit = chunk_rows.select(F.col(page).alias("__page"), "batch").distinct().join(failed, "batch").groupBy("__page").agg(F.min(F.struct("batch", "stage", "reason")).alias("f"))
    now = F.col("success") & F.col("f").isNotNull()
    kept = [page, "url"] if page != "url" else ["url"]
    return results.join(hit, F.col(page).eqNullSafe(F.col("__page")), "left").select(*kept, (F.col("success") & ~now).alias("success"), F.when(now, F.col("f.stage")).otherwise(F.col("stage")).alias("stage"), "chunks", F.when(now, F.col("f.reason")).otherwise(F.col("failureReason")).alias("failureReason"))


def _counters() -> list[Column]:
    return [F.count("*").alias("pagesVisited"), F.coalesce(F.count_if("success"), F.lit(0)).alias("pagesIndexed"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunksCreated")]


def summarize(results: DataFrame, stored: DataFrame) -> DataFrame:
    """One row of counters. results: one row a page; stored: rows, one a stored chunk."""
    counts = results.agg(*_counters()).crossJoin(stored.agg(F.count("*").alias("chunksStored")))
    return counts.withColumn("skippedPages", F.col("pagesVisited") - F.col("pagesIndexed"))


def written_and_counted(results: DataFrame, stored: int, label: str) -> tuple[DataFrame, dict[str, int]]:
    """The results, written, and their counters, observed while they are written."""
    seen = Observation(label)
    out = saved(results.observe(seen, *_counters()), label)
    counts = seen.get
    return out, {**counts, "chunksStored": stored, "skippedPages": counts["pagesVisited"] - counts["pagesIndexed"]}


@dataclass
class Progress:
    """Collects progress events; optional callback; `cancelled` is looked at between stages and, while jobs run, once a second."""

    callback: object = None
    cancelled: object = None
    events: list = field(default_factory=list)

    def emit(self, stage: str, message: str, **details: object) -> None:
        if stage not in EVENT_STAGES:
            raise ValueError(f"unknown stage {stage!r}")
        event = (len(self.events), stage, message, {k: str(v) for k, v in details.items()})
        self.events.append(event)
        if self.callback:
            self.callback(event)

    def stopped(self) -> bool:
        return bool(self.cancelled and self.cancelled())

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame(self.events, PROGRESS_EVENT)


def sse_frames(events: DataFrame, kind: str = "progress") -> DataFrame:
    """One `data:` frame of JSON an event."""
    body = F.to_json(F.struct(F.lit(kind).alias("type"), "stage", "message", "details"))
    return events.select("seq", F.concat(F.lit("data: "), body, F.lit("\n\n")).alias("frame"))


class Cancelled(Exception):
    pass


@contextmanager
def cancellable(spark: SparkSession, progress: Progress, tick: float = 1.0):
    """Jobs inside run under a tag of their own; each tick asks for a cancel, which then interrupts them, batches and waits included."""
    if not progress.cancelled:
        yield
        return
    # Tags of the context, as those of a session belong to the thread that set them.
    sc, tag, done = spark.sparkContext, f"corpusmill-{uuid.uuid4().hex}", threading.Event()

    def watch() -> None:
        while not done.wait(tick):
            if progress.stopped():
                sc.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True)
    sc.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as e:
        if progress.stopped() and not isinstance(e, Cancelled):
            progress.emit("cancel", "stopped on request")
            raise Cancelled from e
        raise
    finally:
        done.set()
        watcher.join()
        sc.removeJobTag(tag)


def extract_pages(pages: DataFrame, min_chars: int = 100, mode: str = "full_page") -> DataFrame:
    """(url, title, content, long_enough, error, and the pages' rank where they have one) of pages (url, html, perhaps title), each parsed once."""
    bounded_batches(pages.sparkSession)
    got = pages.withColumn("__p", html.page(F.col("url"), F.col("html"), mode))
    titles = [F.col(c) for c in ("title", "__p.title") if c != "title" or c in pages.columns]
    return got.select("url", *[c for c in ("rank",) if c in pages.columns], html.title_or_default(*titles).alias("title"), F.col("__p.content").alias("content"), F.coalesce(F.char_length("__p.content") >= min_chars, F.lit(False)).alias("long_enough"), F.col("__p.error").alias("error"))


def embed_batches(rows: DataFrame, provider: EmbeddingProvider) -> DataFrame:
    """Add embedding and error. All rows of one `batch` meet in one call of the provider; a call that fails gives errors instead of vectors."""
    schema = T.StructType([*rows.schema, T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])

    def run(batch: pa.Table) -> pa.Table:
        n, error, vectors = len(batch), None, None
        try:
            vectors = provider.embed_batch(batch.column("content").to_pylist())
            if len(vectors) != n:
                raise ValueError(f"{len(vectors)} vectors for {n} texts")
        except Exception as e:  # a failed batch is a row, not the end of the run
            vectors, error = [None] * n, f"{type(e).__name__}: {e}"
        return batch.append_column("embedding", pa.array(vectors, pa.list_(pa.float32()))).append_column("error", pa.array([error] * n, pa.string()))

    return rows.groupBy("batch").applyInArrow(run, schema)


def index(pages: DataFrame, store: VectorStore, provider: EmbeddingProvider, config: IndexConfig | None = None, progress: Progress | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, summary) of indexing the pages (url, title, html) into the store, in the order of their rank, where they have one, else of url and text.

    One result a page: a URL that is given twice is two pages, and a null URL is one. Equal chunks of a URL are one row of the store, and chunksStored counts rows.
    """
    return _run(lambda: pages, "", store, provider, config or IndexConfig(), progress or Progress())


def index_site(start: str, crawler: Crawler, store: VectorStore, provider: EmbeddingProvider, config: IndexConfig | None = None, progress: Progress | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, summary) of crawling a site from its start URL, within max_pages and max_depth, and indexing what is found."""
    c = config or IndexConfig()
    at = CrawlConfig(c.max_pages, c.max_depth)
    return _run(lambda: saved(crawler.crawl(start, at), "crawled"), start, store, provider, c, progress or Progress())


#: Columns of the summary that hold the milliseconds of stages, and the events that begin them.
DURATIONS = {"crawl": "crawlDuration", "extract": "extractionDuration", "chunk": "chunkingDuration", "embed": "embeddingDuration", "store": "storageDuration"}


def _run(find: Callable[[], DataFrame], start: str, store: VectorStore, provider: EmbeddingProvider, c: IndexConfig, p: Progress) -> tuple[DataFrame, DataFrame]:
    spark, marks = store.spark, []

    def step(stage: str, message: str, **details: object) -> None:
        if p.stopped():
            p.emit("cancel", "stopped on request")
            raise Cancelled
        p.emit(stage, message, **details)
        marks.append((stage, time.monotonic()))

    with cancellable(spark, p):
        step("initialize", "opening the store")
        store.initialize()
        step("validate", "checking the store")
        if not store.validate():
            raise RuntimeError("the store does not validate")
        if c.clear_existing:
            store.clear()
        step("crawl", f"finding the pages of {start}" if start else "taking the pages as given", maxPages=c.max_pages, maxDepth=c.max_depth)
        pages = find()
        step("extract", "extracting text")
        found = extract_pages(pages, c.min_chars)
        order = ["rank"] if "rank" in found.columns else ["url", "title", "content"]
        # A number for every page, ascending in that order: places inside range partitions.
        texts = written(found.orderBy(*order).withColumn("page", F.monotonically_increasing_id()), "texts")
        step("chunk", "cutting chunks")
        cut = saved(chunks(texts.where("long_enough"), c.chunk, key_cols=("page", "url", "title")), "chunks")
        # From here on pages are what their results need; every table goes once the next is written, so that the disk holds a text in one form or two.
        listed = saved(texts.drop("title", "content"), "pages")
        discard(texts)
        per_page = saved(cut.groupBy("page").agg(F.count("*").cast("int").alias("chunks")), "page-chunks")
        stage = F.when(~F.col("long_enough"), "extract").when(F.col("chunks").isNull(), "chunk")
        reason = F.coalesce("error", F.when(stage == "extract", "too little text").when(stage == "chunk", "no chunks"))
        results = listed.join(per_page, "page", "left").select("page", "url", stage.isNull().alias("success"), stage.alias("stage"), F.coalesce("chunks", F.lit(0)).alias("chunks"), reason.alias("failureReason"))
        step("embed", "embedding chunks")
        vectors = written(embed_batches(page_batches(cut, per_page, c.batch_size), provider), "vectors")
        discard(cut)
        step("store", "storing vectors")
        # A vector that the store would refuse fails its batch, not the others.
        misfit = F.when(~vector.has_dimension(F.col("embedding"), store.dimension), F.concat(F.lit("vectors of "), F.size("embedding").cast("string"), F.lit(" components")))
        problem = F.when(F.col("error").isNotNull(), F.struct(F.lit("embed").alias("stage"), F.col("error").alias("reason"))).when(misfit.isNotNull(), F.struct(F.lit("store").alias("stage"), misfit.alias("reason")))
        failed = saved(vectors.select("batch", problem.alias("f")).where("f IS NOT NULL").groupBy("batch").agg(F.min("f").alias("f")).select("batch", "f.*"), "failed-batches")
        good = vectors.join(failed.select("batch"), "batch", "left_anti")
        rows, stored = good.drop("batch", "error"), 0
        try:
            # Pages that lost a batch keep what they had; the others' old chunks go in the version that brings the new ones.
            lost = vectors.join(failed.select("batch"), "batch", "left_semi").select("url").distinct().withColumnRenamed("url", "__lost")
            keys = listed.where("long_enough").select("url").distinct().join(lost, F.col("url").eqNullSafe(F.col("__lost")), "left_anti")
            # Of equal chunks of a URL that of the last page stays.
            stored = store.replace(rows, keys, "page", spread=False, written=True) if c.replace_pages else store.upsert(rows, "page", written=True)
        except Exception as e:  # the upsert is all or nothing: every batch that was left fails in this stage
            if p.stopped():
                raise
            failed = failed.union(good.select("batch").distinct().select("batch", F.lit("store"), F.lit(f"{type(e).__name__}: {e}"[:500])))
        results, counts = written_and_counted(mark_failures(results, vectors, failed, "page").drop("page"), stored, "page-results")
        ended = [*(t for _, t in marks[1:]), time.monotonic()]
        took = {s: 1000 * (b - a) for (s, a), b in zip(marks, ended, strict=True)}
        total = 1000 * (ended[-1] - marks[0][1])
        # One row: the average cost of a chunk's vector goes with the six durations.
        each = round(took["embed"] / counts["chunksCreated"], 3) if counts["chunksCreated"] else None
        row = {**counts, **{name: round(took[s], 3) for s, name in DURATIONS.items()}, "totalDuration": round(total, 3), "embeddingMsPerChunk": each}
        schema = T.StructType([T.StructField(n, T.LongType() if n in counts else T.DoubleType()) for n in row])
        out = spark.createDataFrame([tuple(row.values())], schema)
        p.emit("complete", "done", **{n: round(took[s], 3) for s, n in DURATIONS.items()}, totalDuration=round(total, 3))
    return results, out
