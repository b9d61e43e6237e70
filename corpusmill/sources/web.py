"""Pages fetched over HTTP: one task a host, requests of a host one after the other with a pause between them.

`fetched` takes a table of URLs of any size: URLs are dealt by host, so that all of a host's requests come from one task, which
reads the origin's robots.txt first. `PagesSource` is the same as a Data Source for a short list of URLs
(`spark.read.format("web_pages").option("urls", json)`), with a partition a host. `WebCrawler` walks a site breadth first with it.

An outcome is a row, never the end of a job: status, content type and the error of a request that failed. Only HTML with a 2xx status counts as
fetched (`crawl.fetch_failure`). A URL that robots.txt forbids is not asked for, and has `allowed` false; a
robots.txt that is not served forbids nothing. Requests are repeated where a task is (a lost executor); they read only.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from corpusmill.functions.robots import allowed_one
from corpusmill.functions.urls import host
from corpusmill.operators.crawl import edges_of, fetch_failure, walk
from corpusmill.schema import CrawlConfig
from corpusmill.session import sized_join, saved_rows

FETCHED = T.StructType([T.StructField(n, t) for n, t in (("url", T.StringType()), ("html", T.StringType()), ("status", T.IntegerType()), ("contentType", T.StringType()), ("fetchError", T.StringType()), ("allowed", T.BooleanType()))])
#: URLs that the data source takes as an option; longer lists are tables for `fetched`.
MOST_URLS = 10_000


@dataclass(frozen=True)
class FetchConfig:
    """delay: seconds from the end of a host's request to its next. Bodies are read up to most_bytes; longer ones are an error."""

    user_agent: str = "corpusmill"
    delay: float = 0.2
    timeout: float = 10.0
    most_bytes: int = 16 << 20

    def __post_init__(self) -> None:
        if self.delay < 0 or self.timeout <= 0 or self.most_bytes <= 0:
            raise ValueError("delay must be 0 or more, timeout and most_bytes over 0")


class _SameOrigin(urllib.request.HTTPRedirectHandler):
    """Follows redirects inside an origin: another host has a task, a pace and rules of its own."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if urlsplit(newurl)[:2] != urlsplit(req.full_url)[:2]:
            raise urllib.error.HTTPError(req.full_url, code, "redirect to another origin", headers, fp)
        return super().redirect_request(req, fp, code, msg, headers, newurl)


_open = urllib.request.build_opener(_SameOrigin()).open


def get(url: str, config: FetchConfig) -> tuple[str | None, int | None, str | None, str | None]:
    """(body, status, content type, error) of one request. The body is decoded by its charset, bytes that do not fit replaced; only HTML and plain text are read."""
    try:
        if urlsplit(url).scheme.lower() not in ("http", "https"):
            return None, None, None, "not http"
        with _open(urllib.request.Request(url, headers={"User-Agent": config.user_agent}), timeout=config.timeout) as r:
            kind = r.headers.get("Content-Type")
            if not (kind or "").lower().startswith("text/"):
                return None, r.status, kind, None
            body = r.read(config.most_bytes + 1)
            if len(body) > config.most_bytes:
                return None, r.status, kind, f"more than {config.most_bytes} bytes"
            try:
                return body.decode(r.headers.get_content_charset() or "utf-8", "replace"), r.status, kind, None
            except LookupError:  # a charset that nobody knows
                return body.decode("utf-8", "replace"), r.status, kind, None
    except urllib.error.HTTPError as e:
        return None, e.code, e.headers.get("Content-Type") if e.headers else None, None
    except Exception as e:  # a request that fails is a row
        return None, None, None, f"{type(e).__name__}: {e}"[:300]


class Host:
    """Requests to one host in turn; rules are read once an origin, and every request waits for its time."""

    def __init__(self, config: FetchConfig, ask: Callable = get, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        self.config, self.ask, self.sleep, self.clock = config, ask, sleep, clock
        self.rules: dict[str, str] = {}
        self.free = float("-inf")

    def _paced(self, url: str) -> tuple:
        wait = self.free - self.clock()
        if wait > 0:
            self.sleep(wait)
        try:
            return self.ask(url, self.config)
        finally:
            self.free = self.clock() + self.config.delay

    def page(self, url: str) -> tuple:
        """A row of FETCHED."""
        try:
            at = urlsplit(url)
        except ValueError as e:
            return url, None, None, None, f"ValueError: {e}", True
        origin = f"{at.scheme}://{at.netloc}"
        if origin not in self.rules:
            body, status, _, error = self._paced(f"{origin}/robots.txt")
            self.rules[origin] = body or "" if error is None and status is not None and 200 <= status < 300 else ""
        if not allowed_one(url, self.rules[origin], self.config.user_agent):
            return url, None, None, None, None, False
        return url, *self._paced(url), True


def _pages(named: Iterator[tuple[str | None, str]], config: FetchConfig) -> Iterator[tuple]:
    """Rows of (host, url) in the order of hosts: a host's state goes when its rows end."""
    for _, rows in groupby(named, key=lambda r: r[0]):
        at = Host(config)
        for _, url in rows:
            yield at.page(url)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(FETCHED)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)


def fetched(urls: DataFrame, config: FetchConfig | None = None, partitions: int = 64) -> DataFrame:
    """FETCHED of the distinct non-null URLs (url). A host's URLs are one task's; a task that has several hosts takes them in turn. Write the result: reading it twice asks twice."""
    c = config or FetchConfig()
    named = urls.select("url").where("url IS NOT NULL").distinct().withColumn("host", F.coalesce(host(F.col("url")), F.lit("")))
    # The number of partitions is given, so no later coalescing puts more hosts in a row than this.
    dealt = named.repartition(partitions, "host").sortWithinPartitions("host", "url").select("host", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((h, u) for b in batches for h, u in zip(b.column("host").to_pylist(), b.column("url").to_pylist(), strict=True))
        for row in _pages(rows, c):
            yield _batch([row])

    return dealt.mapInArrow(run, FETCHED)


@dataclass
class _HostPartition(InputPartition):
    host: str
    urls: tuple[str, ...]


class _PagesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.urls = json.loads(options.get("urls", "[]"))
        if not isinstance(self.urls, list) or not all(isinstance(u, str) for u in self.urls):
            raise ValueError("option urls has to be a JSON list of strings")
        if len(self.urls) > MOST_URLS:
            raise ValueError(f"option urls takes {MOST_URLS} URLs; use fetched for more")
        known = {f: type(v) for f, v in asdict(FetchConfig()).items()}
        self.config = FetchConfig(**{f: kind(options[f]) for f, kind in known.items() if f in options})

    def partitions(self) -> list[_HostPartition]:
        by_host: dict[str, dict[str, None]] = {}
        for u in self.urls:
            by_host.setdefault(urlsplit(u).netloc.lower(), {})[u] = None
        return [_HostPartition(h, tuple(us)) for h, us in sorted(by_host.items())] or [_HostPartition("", ())]

    def read(self, partition: _HostPartition) -> Iterator[tuple]:
        yield from _pages(((partition.host, u) for u in partition.urls), self.config)


class PagesSource(DataSource):
    """Options: urls (a JSON list) and the fields of FetchConfig."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> T.StructType:
        return FETCHED

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _PagesReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagesSource)


class WebCrawler:
    """Crawls a site over HTTP; result and order are those of a crawl of a table with the same pages. Every level's pages are written once and parsed from there.

    A level is asked for in waves of as many URLs as may still count, in order, so no page is requested that a crawl one by one would not ask for.
    """

    def __init__(self, spark: SparkSession, config: FetchConfig | None = None) -> None:
        self.spark, self.config = spark, config

    def crawl(self, start: str, config: CrawlConfig) -> DataFrame:
        asked = self.config or FetchConfig(user_agent=config.user_agent)
        pages: DataFrame | None = None

        def fetch(front: DataFrame, met: int, wanted: int) -> DataFrame:
            nonlocal pages
            left, found = front, None
            while True:
                wave, n = saved_rows(left.orderBy("ord", "pos").limit(wanted), "fetch-wave")
                got, _ = saved_rows(fetched(wave, asked), "fetched")
                got = got.where(F.col("allowed") & fetch_failure(got).isNull())
                pages = got if pages is None else pages.union(got)
                hits = got.select("url").join(wave, "url")
                found = hits if found is None else found.union(hits)
                met -= n
                wanted -= hits.count()
                if wanted <= 0 or met <= 0:
                    return found
                left = left.join(wave.select("url"), "url", "left_anti")

        def expand(level: DataFrame, n: int) -> DataFrame:
            held = sized_join(pages.select("url", "html"), level, ["url"], "inner", 256 * n)
            return edges_of(held, F.col("ord")).select(F.col("dst").alias("url"), F.col("src").alias("ord"), "pos")

        ranked = walk(start, config, fetch, expand, self.spark)
        return pages.drop("allowed").join(ranked, "url")
