from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.functions import errors, html, requests, robots, text, urls
from corpusmill.operators.chunking import windows
from corpusmill.schema import ChunkConfig, IndexConfig

BASE = "https://shop.example/docs"


@pytest.mark.parametrize(
    ("base", "link", "want"),
    [
        (BASE, "intro.html", f"{BASE}/intro.html"),
        (BASE + "/", "intro.html", f"{BASE}/intro.html"),
        (BASE + "/page.html", "intro.html", f"{BASE}/intro.html"),
        (BASE + "/", "/intro.html", "https://shop.example/intro.html"),
        ("https://shop.example/", "intro.html", "https://shop.example/intro.html"),
        ("https://shop.example/a.html", "../b.html", "https://shop.example/b.html"),
        (BASE, "./intro.html", f"{BASE}/intro.html"),
        (BASE, "intro.html?q=1#part", f"{BASE}/intro.html?q=1"),
        (BASE, ".html", None),
        (BASE, "#", None),
        (BASE, "javascript:void(0)", None),
        (BASE, "mailto:a@b.c", None),
        (BASE, "sub/", f"{BASE}/sub"),
        (BASE, "x/.html", None),
        (None, "a", None),
    ],
)
def test_resolve(base, link, want):
    assert urls.resolve_one(link, base) == want


def test_url_columns(spark):
    rows = [("HTTP://A.example:80/x/#f",), ("https://a.example:8443",), ("http://a.example/?q=1",), ("nothing",), (None,)]
    df = spark.createDataFrame(rows, "u string")
    got = [tuple(r) for r in df.select(urls.normalize(F.col("u")), urls.host(F.col("u")), urls.is_http(F.col("u")), urls.same_domain(F.col("u"), F.lit("https://a.example/z"))).collect()]
    assert got == [("http://a.example/x", "a.example", True, True), ("https://a.example:8443/", "a.example:8443", True, False), ("http://a.example/?q=1", "a.example", True, True), (None, None, False, False), (None, None, False, False)]


SPELLINGS = [
    ("http://x.y/é", "http://x.y/%C3%A9"),
    ("HTTP://EX%41MPLE.com:80/%7e/../x y?a b'\"#f", "http://example.com/x%20y?a%20b%27%22"),
    ("http:\\\\h\\a\\.\\b\n", "http://h/a/b"),
    ("https:/h.example/a/%2E%2e/b/", "https://h.example/b"),
    ("http://user:p@ss@h.example:443/", "http://user:p%40ss@h.example:443/"),
    ("https://h.example:443?", "https://h.example/?"),
    ("http://0300.0x2.513/", "http://192.2.2.1/"),
    ("http://256.1.1.1/", None),
    ("http://[::FFFF:1.2.3.4]:8080/x", "http://[::ffff:102:304]:8080/x"),
    ("http://[::1", None),
    ("http://faß。de/", "http://xn--fa-hia.de/"),
    ("http://ＧＯ.com/.", "http://go.com/"),
    ("http://a b/", None),
    ("http://h%00.x/", None),
    ("http://h:65536/", None),
    ("http://h:/x/", "http://h/x"),
    ("http:///h//x//", "http://h//x/"),
    ("  http://h/a|b`{}^[]\t ", "http://h/a|b%60%7B%7D%5E[]"),
    ("http://", None),
    ("//h/x", None),
    ("ftp://h/x", None),
    ("http://h/a/./b?x=/", "http://h/a/b?x="),
    ("http://plain.example:8080/a/b.html?x=1&y=2#z", "http://plain.example:8080/a/b.html?x=1&y=2"),
    ("http://plain.example/a\n", "http://plain.example/a"),
    ("", None),
]
REFERENCES = [("?y", "http://a.example/b/c.d?y"), ("../../../g", "http://a.example/g"), ("//g\\h", "http://g/h"), ("/\\g", "http://g/"), ("http:g", "http://a.example/b/g"), ("https:g", "https://g/"), ("g;x=1/../y", "http://a.example/b/y"), ("http://[", None), ("./", "http://a.example/b"), ("é#x", "http://a.example/b/%C3%A9")]


def test_spellings_through_columns_and_python_agree(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(SPELLINGS)], "i int, u string")
    got = {r.i: r.n for r in df.select("i", urls.normalize(F.col("u")).alias("n")).collect()}
    for i, (u, want) in enumerate(SPELLINGS):
        assert got[i] == urls.normalize_one(u) == want, u
    refs = spark.createDataFrame([(link, want) for link, want in REFERENCES], "l string, want string")
    for r in refs.select("l", "want", urls.resolve(F.col("l"), F.lit("http://a.example/b/c.d?q")).alias("n")).collect():
        assert r.n == urls.resolve_one(r.l, "http://a.example/b/c.d?q") == r.want, r.l


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", ".", "..", "%2e", "é", "x y", "/", "//", "\\", "?", "q=1", "'", "#f", ":8080", "~"]), max_size=8))
def test_a_normalised_url_is_its_own_spelling(parts):
    once = urls.normalize_one("http://h.example/" + "".join(parts))
    twice = once and urls.normalize_one(once)
    # A last slash goes each time, where several end the path.
    assert once == twice or (once.endswith("/") and twice == once[:-1])


def test_offsets_in_utf16_units(spark):
    from corpusmill.operators.chunking import chunks

    text = "🙂 one. 𝄞𝄞 two three. " * 9 + "end"
    df = spark.createDataFrame([("u", "t", text)], "url string, title string, content string")
    plain = {r.chunkIndex: r for r in chunks(df, ChunkConfig(40, 10)).collect()}
    units = lambda s: len(s.encode("utf-16-le")) // 2
    for r in chunks(df, ChunkConfig(40, 10), units="utf16").collect():
        p = plain[r.chunkIndex]
        assert (r.id, r.content, r.startOffset, r.endOffset) == (p.id, p.content, units(text[: p.startOffset]), units(text[: p.endOffset]))
    with pytest.raises(ValueError):
        chunks(df, units="bytes")


def test_white_space(spark):
    df = spark.createDataFrame([("  a \t b \n\n\n\n c ﻿",), ("　",), (None,)], "t string")
    assert [r[0] for r in df.select(text.clean_whitespace(F.col("t"))).collect()] == ["a b\n\nc", "", None]
    assert [r[0] for r in df.select(text.is_blank(F.col("t"))).collect()] == [False, True, True]


def test_html_rendering():
    page = "<html><head><title> A &amp; B </title></head><body><nav>x</nav><h1>T</h1><p>one<p>two <b>bold<ul><li>a<li>b</ul><h5>h</h5><pre><code>x  y</code></pre><div>c</div><div>d</div><!-- no --><script>var p='</p>'</script></body></html>"
    assert html.title_one(page) == "A & B"
    assert html.extract_one("u", page) == "# T\n\none\n\ntwo bold\n\n* a\n\n* b\n\n#### h\n\n```\nx y\n```\ncd"
    assert html.title_one("<p>") == "Untitled Page" and html.extract_one(None, None) == ""
    assert html.links_one("<a href=' /x '>a</a><a>b</a><p><a href=''>c</a><a href='/x'>d</a>") == ["/x", "/x"]


def test_titles_read_the_references_that_their_sql_reads(spark, tmp_path):
    import duckdb

    from corpusmill.plans import catalogue

    rows = [(i, f"http://h.example/{i}", f"<html><head><title>{t}</title></head><body><script>a &amp; b</script><h1>{t}</h1><p>{'word ' * 30} &quot;q&quot; {t}</p></body></html>") for i, t in enumerate(["a &amp;&amp", "say &quot;so&quot;", "&amp;lt; &lt;b&gt; &am", "AT&T; &#38; x"], 1)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("title_extract", "title_coalesce", "html_to_text"):
        assert sorted(map(tuple, catalogue.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(duckdb.sql(catalogue.ORACLES[name]).fetchall()), name
    assert html.title_one("<title>a &amp b &quot;") == 'a & b "' and html.links_one("<a href='/x?a=1&amp;b=2'>x</a>") == ["/x?a=1&b=2"]
    late = "<!-- </title> --><title>x &quot;</title><p>y"
    assert html.page_one("u", late, names=("quot",), title_names=("amp",))["title"] == "x &quot;"


def test_main_content_is_bypassed_for_people_pages():
    page = "<body><div>menu</div><article><p>body</p></article></body>"
    assert html.extract_one("http://x/a", page, "main_content") == "body"
    assert "menu" in html.extract_one("http://x/About", page, "main_content")


def test_robots(spark):
    rules = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /private", True), ("b.example", "User-agent: *\nDisallow: /", False)], "host string, rules string, ok boolean")
    df = spark.createDataFrame([("http://a.example/private/x",), ("http://a.example/x",), ("http://b.example/x",), ("http://c.example/",)], "url string")
    got = {r.url: r.allowed for r in robots.with_verdict(df, rules).collect()}
    assert got == {"http://a.example/private/x": False, "http://a.example/x": True, "http://b.example/x": True, "http://c.example/": True}


SENTENCE = "The quick brown fox jumps over the lazy dog."


@pytest.mark.parametrize(
    ("content", "size", "overlap", "want"),
    [
        ("x" * 50, 20, 5, [(0, 20), (15, 35), (30, 50), (45, 50)]),
        ("one two three four five six seven eight nine ten", 16, 0, [(0, 16), (14, 30), (28, 44), (45, 48)]),
        ("alpha beta\n\ngamma delta epsilon zeta eta theta iota kappa", 20, 10, [(0, 12), (2, 18), (6, 24), (14, 32), (18, 37), (24, 41), (32, 52), (41, 57), (47, 57)]),
        (" ".join([SENTENCE] * 4), 80, 20, [(0, 80), (61, 134), (110, 179), (155, 179), (159, 179)]),
        ("hello", 10, 2, [(0, 5), (3, 5)]),
        ("hello wide world", 1000, 5, [(0, 16), (11, 16)]),
        (" \n\t ", 10, 2, []),
    ],
)
def test_chunk_windows(content, size, overlap, want):
    assert [(s, e) for s, e, _ in windows(content, size, overlap)] == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .!\n ", max_size=300), st.integers(1, 60), st.integers(0, 59))
def test_chunks_cover_the_text(content, size, overlap):
    overlap = min(overlap, size - 1)
    seen, last = set(), -1
    for s, e, _ in windows(content, size, overlap):
        assert s > last and s < e and e - s <= size
        last = s
        seen.update(range(s, e))
    assert all(i in seen for i, c in enumerate(content) if not c.isspace())


def test_configuration_is_checked():
    for bad in ({"size": 0}, {"overlap": -1}, {"size": 10, "overlap": 10}):
        with pytest.raises(ValueError):
            ChunkConfig(**bad)
    for bad in ({"max_pages": 0}, {"max_depth": -1}, {"batch_size": 0}):
        with pytest.raises(ValueError):
            IndexConfig(**bad)


def test_errors(spark):
    df = spark.createDataFrame([("Please RETRY in 4.5 s", None), ("retry after 7 seconds", "12s"), ("x", None)], "m string, d string")
    assert [r[0] for r in df.select(errors.retry_delay(F.col("m"), F.col("d"))).collect()] == [4.5, 12.0, None]


def test_index_requests(spark):
    df = spark.createDataFrame([('{"url": "http://x"}',), ('{"url": " "}',), ('{"url": "http://x", "maxPages": "3"}',), ('{"url": "http://x", "maxPages": 0}',), ("nope{",)], "body string")
    assert [(r.error, r.max_pages) for r in requests.validate_index(df).collect()][:4] == [(None, 10.0), ("url", 10.0), (None, 3.0), ("maxPages", 0.0)]
    assert requests.validate_index(df).collect()[4].error == "json"
    out = df.limit(1).select(requests.response(F.lit("bad"), F.struct(F.lit(1).alias("a"))), requests.response(F.lit(None).cast("string"), F.struct(F.lit(1).alias("a")))).first()
    assert tuple(out) == ('{"error":"bad"}', '{"a":1}')


def test_deeply_nested_pages_give_a_row(spark):
    deep = "<title>x</title>" + "<div>" * 100_000 + "<a href='/l'>in</a><p>text" + "</div>" * 100_000
    mixed = "<ul><li><b>" * 5_000 + "end"
    df = spark.createDataFrame([("http://h/", deep), ("http://h/", mixed), ("http://h/", "</p></div>" * 1000), (None, None)], "url string, html string")
    got = df.select(html.title(F.col("html")).alias("t"), html.links(F.col("html")).alias("l"), html.to_text(F.col("url"), F.col("html")).alias("x")).collect()
    assert got[0].t == "x" and got[0].l == ["/l"] and got[0].x.split() == ["xin", "text"]  # children are joined without a separator
    assert got[1].x.endswith("end") and got[2].x == got[3].x == ""


def test_waits_in_messages(spark):
    said = {"please retry in 4 s": 4.0, "Retry after 2.5seconds": 2.5, "retry_delay: 7s": 7.0, "retry in a minute": None, "retry in 5 minutes": None, "retrying 3 s": None, None: None}
    df = spark.createDataFrame([(m,) for m in said], "m string")
    assert [r[0] for r in df.select(errors.retry_delay(F.col("m"))).collect()] == list(said.values())
