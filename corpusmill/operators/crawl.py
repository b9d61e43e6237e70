"""Breadth-first traversal of a link graph held in tables, level by level.

Equal to a first-in-first-out queue: within a level pages are visited in the order of (rank of the parent, place of
the link), a URL counts where it is first met, blocked and missing pages stay visited but do not
count, pages at the depth limit are fetched but not expanded, and the first `max_pages` fetched
pages of the whole order are the result. One round of joins a level; every level is a
written table, so the lineage stays short. Only the pages of a level are parsed, and only its URLs are judged by robots
rules; levels are held to what can still count, so the work follows max_pages and not the table.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.urls import is_http, same_domain
from corpusmill.schema import CrawlConfig
from corpusmill.session import bounded_batches, saved_rows, sized_join


class Crawler(Protocol):
    """Finds the pages of a site: url, title, html, depth and rank of those that could be fetched."""

    def crawl(self, start: str, config: CrawlConfig) -> DataFrame: ...


class TableCrawler:
    """Crawls a table of pages by its own links; robots: (host, rules, ok)."""

    def __init__(self, pages: DataFrame, robots: DataFrame | None = None) -> None:
        self.pages, self.robots = pages, robots

    def crawl(self, start: str, config: CrawlConfig) -> DataFrame:
        return crawl_pages(self.pages, start, config, self.robots)


def fetch_failure(pages: DataFrame) -> Column:
    """Why a page could not be fetched, or null: from its columns status, contentType and fetchError, as far as it has them."""
    has = lambda name, test: test(F.col(name)) if name in pages.columns else F.lit(False)
    return (
        F.when(has("fetchError", lambda c: c.isNotNull()), "network")
        .when(has("status", lambda c: ~F.coalesce(c.between(200, 299), F.lit(False))), "status")
        .when(has("contentType", lambda c: ~F.coalesce(F.lower(c).contains("text/html"), F.lit(False))), "contentType")
    )


def edges_of(pages: DataFrame, src: Column | None = None) -> DataFrame:
    """(src, dst, pos) of all resolvable links of pages (url, html); src names the page, by its url unless another column is given."""
    from corpusmill.functions import html, urls

    name = F.col("url") if src is None else src
    bounded_batches(pages.sparkSession)
    raw = pages.select(name.alias("src"), "url", F.posexplode(html.links(F.col("html"))).alias("pos", "link"))
    return raw.select("src", urls.resolve(F.col("link"), F.col("url")).alias("dst"), "pos").where("dst IS NOT NULL")


def walk(start: str, config: CrawlConfig, fetch: Callable[[DataFrame, int, int], DataFrame], expand: Callable[[DataFrame, int], DataFrame], spark: SparkSession) -> DataFrame:
    """(url, depth, rank) of the pages that count, in breadth-first order, rank from 1.

    fetch: of the URLs met (url, depth, ord, pos; their number) those that can be fetched, in the order of ord and pos as many at least as are asked for, where there
    are so many. expand: of a level (url, depth, ord; its number of pages) its links as (url, ord, pos).
    """
    if config.max_pages <= 0 or config.max_depth < 0:
        raise ValueError("max_pages must be over 0 and max_depth 0 or more")
    front = spark.createDataFrame([(start, 0, 0, 0)], "url string, depth int, ord long, pos int")
    visited, met = front.select("url"), 1
    found, total = None, 0
    for depth in range(config.max_depth + 1):
        # A level's order number: sorted by range partitions, so no single task holds the level; of a long level only the first pages can count.
        got = fetch(front, met, config.max_pages - total).select("url", "ord", "pos").orderBy("ord", "pos").limit(config.max_pages - total)
        level, n = saved_rows(got.select("url", F.lit(depth).alias("depth"), F.monotonically_increasing_id().alias("ord")), "crawl-level")
        found = level if found is None else found.union(level)
        total += n
        if not n or total >= config.max_pages or depth == config.max_depth:
            break
        links = expand(level, n).where(same_domain(F.col("url"), F.lit(start)) & is_http(F.col("url")))
        first = links.groupBy("url").agg(F.min(F.struct("ord", "pos")).alias("at")).select("url", F.lit(depth + 1).alias("depth"), "at.ord", "at.pos")
        front, met = saved_rows(first.join(visited, "url", "left_anti"), "crawl-front")
        visited = visited.union(front.select("url"))
    best = found.orderBy("depth", "ord").limit(config.max_pages)
    return best.select("url", "depth", F.row_number().over(Window.orderBy("depth", "ord")).cast("int").alias("rank"))


def _with_pages(pages: DataFrame, ranked: DataFrame, config: CrawlConfig) -> DataFrame:
    return pages.join(F.broadcast(ranked) if config.max_pages <= 1_000_000 else ranked, "url")


def crawl(pages: DataFrame, edges: DataFrame, start: str, config: CrawlConfig | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """Fetched pages with rank (from 1) and depth. pages: url and any columns (those that can be fetched); edges: src, dst, pos."""
    c = config or CrawlConfig()
    urls = pages.select("url").distinct()

    def fetch(front: DataFrame, met: int, wanted: int) -> DataFrame:
        reach = front if blocked is None else front.join(blocked.select("url"), "url", "left_anti")
        return reach.join(urls, "url", "left_semi")

    def expand(level: DataFrame, n: int) -> DataFrame:
        return level.join(edges, level["url"] == edges["src"]).select(F.col("dst").alias("url"), "ord", "pos")

    return _with_pages(pages, walk(start, c, fetch, expand, pages.sparkSession), c)


#: Bytes of one URL of a level, for the check of a broadcast.
_URL_BYTES = 256


def crawl_pages(pages: DataFrame, start: str, config: CrawlConfig | None = None, robots: DataFrame | None = None) -> DataFrame:
    """Crawl a table of pages (url, html) by its own links. Pages whose fetch failed are visited, but neither count nor are expanded.

    A level meets the table's URLs, then the HTML of those of its pages that count, each time by a broadcast behind a check of its size; only these pages are parsed.
    """
    from corpusmill.functions.robots import with_verdict

    c = config or CrawlConfig()
    pages = pages.where(fetch_failure(pages).isNull())

    def fetch(front: DataFrame, met: int, wanted: int) -> DataFrame:
        if robots is not None:
            front = with_verdict(front, robots, agent=c.user_agent).where("allowed").drop("allowed")
        return sized_join(pages.select("url"), front, ["url"], "inner", _URL_BYTES * met).distinct()

    def expand(level: DataFrame, n: int) -> DataFrame:
        held = sized_join(pages.select("url", "html"), level, ["url"], "inner", _URL_BYTES * n)
        return edges_of(held, F.col("ord")).select(F.col("dst").alias("url"), F.col("src").alias("ord"), "pos")

    return _with_pages(pages, walk(start, c, fetch, expand, pages.sparkSession), c)
