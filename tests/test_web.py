"""Pages over HTTP from a local server: the crawl equals that of a table, hosts run beside each other, a host's requests do not; robots rules."""

from __future__ import annotations

import json
import re
import threading
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import robots
from corpusmill.operators.crawl import TableCrawler, crawl_pages
from corpusmill.schema import CrawlConfig
from corpusmill.sources import web

LINKS = {"/": ["/b", "a", "#x", "/gone", "/b"], "/a": ["/c.html", "/secret/x", "/picture"], "/b": ["/", "/d", "/a"], "/c.html": ["/e"], "/d": ["/late"], "/e": [], "/secret/x": ["/e"], "/late": []}


class Site(BaseHTTPRequestHandler):
    """Serves LINKS; notes when each request began and ended."""

    log: list[tuple[str, str, float, float]] = []

    def do_GET(self) -> None:  # noqa: N802
        began = time.monotonic()
        time.sleep(0.05)
        if self.path == "/robots.txt":
            self.reply(200, "text/plain", "User-agent: *\nDisallow: /secret/*\n")
        elif self.path == "/picture":
            self.reply(200, "image/png", "x")
        elif self.path == "/away":
            self.reply(302, "text/html", "", {"Location": "http://localhost:1/"})
        elif self.path in LINKS:
            self.reply(200, "text/html; charset=latin-1", "<title>é</title><![foo[x]]>" + "".join(f"<a href='{u}'>x</a>" for u in LINKS[self.path]))
        else:
            self.reply(404, "text/html", "no")
        self.log.append((self.headers["Host"], self.path, began, time.monotonic()))

    def reply(self, status: int, kind: str, body: str, more: dict | None = None) -> None:
        self.send_response(status)
        for name, value in {"Content-Type": kind, "Content-Length": str(len(body.encode("latin-1"))), **(more or {})}.items():
            self.send_header(name, value)
        self.end_headers()
        self.wfile.write(body.encode("latin-1"))

    def log_message(self, *args) -> None:
        pass


@pytest.fixture()
def server():
    s = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    Site.log = []
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield s.server_address[1]
    s.shutdown()


def as_table(spark, root):
    rows = [(root + p, "<title>é</title>" + "".join(f"<a href='{u}'>" for u in links)) for p, links in LINKS.items()]
    rules = spark.createDataFrame([(root.split("/")[2], "User-agent: *\nDisallow: /secret/", True)], "host string, rules string, ok boolean")
    return TableCrawler(spark.createDataFrame(rows, "url string, html string"), rules)


@pytest.mark.parametrize("pages,depth", [(50, 2), (3, 5)])
def test_crawl_over_http_equals_the_crawl_of_a_table(spark, server, pages, depth):
    root, config = f"http://127.0.0.1:{server}", CrawlConfig(pages, depth)
    place = lambda df: sorted((r["rank"], r.url, r.depth) for r in df.collect())
    found = web.WebCrawler(spark, web.FetchConfig(delay=0.01)).crawl(root + "/", config)
    assert place(found) == place(as_table(spark, root).crawl(root + "/", config))
    assert {r.status for r in found.collect()} == {200} and "<title>é</title>" in found.first().html
    asked = [p for _, p, _, _ in Site.log]
    assert "/secret/x" not in asked and all(asked.count(p) == 1 for p in asked if p != "/robots.txt")
    if pages == 3:
        assert sorted(p for p in asked if p != "/robots.txt") == ["/", "/a", "/b"]  # no page that cannot count


def test_hosts_run_beside_each_other_and_a_host_in_turn(spark, server):
    web.register(spark)
    paths = ["/", "/a", "/b", "/c.html", "/d", "/e", "/gone", "/secret/x", "/picture", "/away"]
    urls = [f"http://{h}:{server}{p}" for h in ("127.0.0.1", "localhost") for p in paths] + [f"http://127.0.0.1:{server}/", "ftp://127.0.0.2/x", "http://127.0.0.1:1/closed"]
    frame = spark.read.format("web_pages").option("urls", json.dumps(urls)).option("delay", "0.1").load()
    got = {r.url: r for r in frame.collect()}
    assert got.keys() == set(urls)
    for h in ("127.0.0.1", "localhost"):
        at = lambda p: got[f"http://{h}:{server}{p}"]  # noqa: B023, E731
        assert at("/").status == 200 and at("/gone").status == 404 and at("/gone").html is None and at("/picture").html is None and at("/picture").contentType == "image/png"
        assert at("/secret/x").allowed is False and at("/secret/x").status is None and at("/away").status == 302
    assert got["ftp://127.0.0.2/x"].fetchError == "not http" and "refused" in got["http://127.0.0.1:1/closed"].fetchError.lower()
    spans = {}
    for h, _, a, b in Site.log:
        spans.setdefault(h, []).append((a, b))
    assert len(spans) == 2
    for own in spans.values():
        own.sort()
        assert all(b[0] - a[1] >= 0.08 for a, b in zip(own, own[1:], strict=False))  # a pause after each request
    (a, b), (c, d) = ((min(x)[0], max(x)[1]) for x in spans.values())
    assert max(a, c) < min(b, d)  # the hosts' requests overlap in time


def test_source_and_settings_are_checked(spark):
    web.register(spark)
    for options in ({"urls": '{"a": 1}'}, {"urls": json.dumps(["x"] * (web.MOST_URLS + 1))}, {"urls": "[]", "delay": "-1"}):
        with pytest.raises(Exception, match="urls|delay"):
            spark.read.format("web_pages").options(**options).load().collect()
    assert spark.read.format("web_pages").load().count() == 0
    empty = spark.createDataFrame([(None,)], "url string")
    assert web.fetched(empty).count() == 0


def test_pace_by_the_clock():
    now, asked = [0.0], []

    def ask(url, config):
        asked.append((url, now[0]))
        now[0] += 1
        return "", 404, None, None

    h = web.Host(web.FetchConfig(delay=2.0), ask, lambda s: now.__setitem__(0, now[0] + s), lambda: now[0])
    assert [h.page(f"http://x/{i}")[2] for i in range(2)] == [404, 404]
    assert asked == [("http://x/robots.txt", 0.0), ("http://x/0", 3.0), ("http://x/1", 6.0)]


# -- robots rules -------------------------------------------------------------------
CASES = [
    ("User-agent: *\nDisallow: /a*b$", {"/axxb": False, "/axxbc": True, "/ab?x": True, "/ab": False}),
    ("User-agent: *\nDisallow: /\nAllow: /p\nAllow: /p/*.html$", {"/": False, "/p": True, "/p/x.html": True, "/q.html": False}),
    ("User-agent: *\nAllow: /x\nDisallow: /x", {"/x": True}),
    ("User-agent: a\nUser-agent: CorpusMill\nDisallow: /own\n\nUser-agent: *\nDisallow: /", {"/own/1": False, "/other": True}),
    ("﻿User-agent: *\nDisallow: /a.b # no\n  DISALLOW : /c?d=\nCrawl-delay: 3\nnonsense", {"/a.b": False, "/aXb": True, "/c?d=1": False, "/c": True}),
    ("User-agent: *\nDisallow:", {"/": True}),
    ("Disallow: /", {"/x": True}),
    ("User-agent: *\nDisallow: /", {"/robots.txt": True, "": False, "?q": False}),
    ("", {"/": True}),
    (None, {"/": True}),
]


def test_rules_by_column_and_by_function(spark):
    rows = [(i, rules, f"HTTP://h{i}.example:8080{path}", want) for i, (rules, paths) in enumerate(CASES) for path, want in paths.items()]
    df = spark.createDataFrame(rows, "i int, rules string, url string, want boolean")
    files = df.select(F.concat(F.lit("h"), "i", F.lit(".example:8080")).alias("host"), "rules", F.lit(True).alias("ok")).distinct()
    for r in robots.with_verdict(df, files, agent="corpusmill/2.0").collect():
        assert r.allowed == r.want == robots.allowed_one(r.url, r.rules, "corpusmill/2.0"), r
    assert all(r.allowed for r in robots.with_verdict(df, files.withColumn("ok", F.lit(False))).collect())
    assert robots.allowed_one(None, "User-agent: *\nDisallow: /", "x") and robots.allowed_one("no url", "User-agent: *\nDisallow: /", "x")


def test_pattern_has_no_other_wildcards():
    assert re.match(robots.pattern_of("/a(b)+[c]*."), "/a(b)+[c]zz.") and not re.match(robots.pattern_of("/a."), "/ab")


# -- crawl by levels ------------------------------------------------------------------
def test_a_crawl_parses_only_the_pages_of_its_levels(spark, tmp_path, monkeypatch):
    from corpusmill.functions import html

    parsed = str(tmp_path / "parsed")
    real = html.links

    def counted(column):
        def note(batch):
            for b in batch:
                with open(parsed, "a") as f:
                    f.write("x" * len(b))
            return batch

        @F.arrow_udf("string")
        def noted(values):
            with open(parsed, "a") as f:
                f.write("x" * len(values))
            return values

        return real(noted(column))

    monkeypatch.setattr(html, "links", counted)
    rows = [(f"http://s.example/{i}", f"<a href='/{2 * i}'></a><a href='/{2 * i + 1}'></a>") for i in range(1, 500)] + [("http://s.example/3", "<a href='/400'>")]
    pages = spark.createDataFrame(rows, "url string, html string")
    got = crawl_pages(pages, "http://s.example/1", CrawlConfig(12, 9))
    assert sorted({int(r.url.rpartition("/")[2]) for r in got.collect()}) == [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 400]
    with open(parsed) as f:
        assert len(f.read()) <= 2 * (1 + 3 + 5)  # the levels that are expanded; a plan may run twice
