"""The registered queries over a small written table with awkward rows, each contract column against plain Python or SQL."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import struct
import zlib
from urllib.parse import urlsplit

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tests.llm import awkward
from tests.llm.test_duplicates import brute_clean, brute_components, brute_repeats, near_rows, repeat_texts
from tokenizers import Tokenizer

from corpusmill.llm import fingerprints, queries, quality_classifier, textbatch, url_filter

URLS = [None, "", "no scheme", "http://H.example.COM/en/x?q=1", "http://www.example.com/en/", "https://a.net/es/1#top", "https://b.net/fr/1", "https://b.net/de/1", "ftp://example.com", "https://example.org/x", "https://free-casino.example.org/x"]


def texts() -> list[str | None]:
    rng = random.Random(8)
    long = " ".join(rng.choice(["sea", "wind", "été", "harbour", "东", "9"]) + str(rng.randrange(50)) for _ in range(20_000))
    return [*awkward.texts()[:30], *repeat_texts()[:40], None, "", *near_rows()[::6], long, long, long[:-40] + " end"]


@pytest.fixture(scope="module")
def docs():
    return {3 * i + 1: t for i, t in enumerate(texts())}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory, docs):
    root = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en" if i % 2 else None, None if i % 7 == 0 else f"s{i % 3}", None, "clash", "clash", "clash") for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string, size string, kept string").repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(i, int("ab" not in (t or "")), 0) for i, t in docs.items()] + [(1, None, None), (None, 1, 0), (10**9, 0, 0), (4, 0, 0), (4, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(i, u, "clash") for i, u in enumerate(URLS * 8)], "page_id long, url string, html string").write.parquet(f"{root}/pages.parquet")
    return root


def run(spark, sf, name):
    rows = queries.queries()[name](spark, sf).collect()
    key = "page_id" if "page_id" in rows[0].asDict() else "doc_id"
    out = {r[key]: r for r in rows}
    assert len(out) == len(rows)
    return out


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_op1(spark, sf, docs):
    got = run(spark, sf, "op1_quality_classifier")
    assert got.keys() == docs.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op1_scores_of_the_query(spark, sf, docs, monkeypatch):
    """The query's scores are those of its model, document by document, and the model has seen no held-out label."""
    made = []
    real = quality_classifier.train

    def train(rows, labels, **more):
        assert all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in labels.collect())
        made.append(real(rows, labels, **more))
        return made[-1]

    monkeypatch.setattr(quality_classifier, "train", train)
    got = run(spark, sf, "op1_quality_classifier")
    for i, t in docs.items():
        assert got[i].score == pytest.approx(float(made[0].score(*quality_classifier.encode(pa.array([t or ""])))[0]), abs=1e-9)


def test_op1_score_by_hand():
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    x, first = quality_classifier.encode(pa.array(["one two " * 200, "", "x ### y", "z " * 65]))
    m = quality_classifier.Model().fit(x, first, np.array([1.0, 0.0, 0.0, 1.0]), hidden=4, gate=3, epochs=3)
    w = m.w
    for bag, (a, b) in enumerate(zip(first, first[1:], strict=False)):
        hidden = [np.maximum((row - w["mean"]) / w["scale"] @ w["W"] + w["b"], 0) for row in x[a:b].astype(float)]
        weight = np.exp([float(np.sum(w["w"] * np.tanh(z @ w["V"]) * sigmoid(z @ w["U"]))) for z in hidden])
        whole = sum(u * z for u, z in zip(weight / weight.sum(), hidden, strict=True))
        assert m.score(x, first)[bag] == pytest.approx(float(sigmoid(whole @ w["c"] + w["d"][0])), abs=1e-9)


def test_op2(spark, sf, docs):
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = run(spark, sf, "op2_bpe")
    assert got.keys() == docs.keys()
    for i, t in docs.items():
        ids = plain.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()))


@pytest.mark.parametrize("name", ["op3_quality_rules", "op6_source_mixing"])
def test_op3_and_op6(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    rounded = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    got = queries.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(columns)
    assert {rounded(r) for r in got.select(*columns).collect()} == {rounded(r) for r in want.fetchall()}


def test_op4(spark, sf, docs):
    got = run(spark, sf, "op4_ngram_jaccard")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(list(docs.items()))


def test_op5(spark, sf):
    rules = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
    for i, r in run(spark, sf, "op5_url_filter").items():
        url = URLS[i % len(URLS)]
        parts = urlsplit(url) if url and "://" in url else urlsplit("")
        host, path = parts.netloc.lower(), parts.path
        fits = [(p, v) for p, v in rules if ("." + host).endswith("." + p.partition("/")[0]) and path.startswith("/" + p.partition("/")[2])]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "block" if r.block_score >= 0.5 else "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def plain_features(url: str | None, shares: dict, prior: float) -> list[float]:
    u = url or ""
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?", u)
    host, path, query, fragment = (m.group(k) or "" for k in range(1, 5)) if m else ("", "", "", "")
    host = host.lower()
    digits = lambda t: sum(c in "0123456789" for c in t)

    def entropy(t):
        b = t.encode()
        return -sum(b.count(c) / len(b) * math.log2(b.count(c) / len(b)) for c in set(b))

    labels = host.split(".")
    counted = [len(u), len(host), len(path), len(query), path.count("/"), host.count("."), host.count("-"), digits(u) / max(len(u), 1), digits(host), query.count("="), len(fragment), max(map(len, labels))]
    return [*counted, entropy(host), entropy(path), *(shares[s].get(".".join(labels[-k:]), prior) for k, s in enumerate(("tld", "domain", "label"), 1))]


def test_op5_model_by_hand(spark, sf):
    """The scores of the query from features and trees walked one URL at a time."""
    rng = random.Random(3)
    labelled = [(u, 0) for u in URLS[2:]] + [(f"http://{'ads' if b else 'sea'}{rng.randrange(30)}.{rng.choice(['com', 'org'])}/{'x' * rng.randrange(40)}?q={rng.randrange(99)}{'#é' * (b)}", b) for b in [0, 1] * 200]
    model = url_filter.train(spark.createDataFrame(labelled, "url string, blocked int"))
    seen = {s: set(v) for s, v in model.suffixes.shares.items()}
    assert "com" in seen["tld"] and all(0 < p < 1 for v in model.suffixes.shares.values() for p in v.values())
    df = spark.createDataFrame([(u,) for u, _ in labelled[:150]] + [(None,), ("é://Ünï.Com:80/1-2/",)], "url string")
    scores = []
    for r in url_filter.judge(df, model, ()).collect():
        x, raw = plain_features(r.url, model.suffixes.shares, model.suffixes.prior), model.trees.base
        for node in model.trees.trees:
            while isinstance(node, tuple):
                feature, cut, low, high = node
                node = low if sum(e < x[feature] for e in model.trees.edges[feature]) <= cut else high
            raw += node
        scores.append(r.block_score)
        assert r.block_score == pytest.approx(1 / (1 + math.exp(-raw)), abs=1e-9) and r.verdict == ("block" if r.block_score >= 0.5 else "allow")
    assert min(scores) < 0.2 and max(scores) > 0.8


def test_op5_unseen_hosts_are_counted_once(spark):
    rng = random.Random(2)
    rows = [(f"https://{'x' * rng.randint(20, 30) if b else 'sea'}{rng.randrange(40)}.example.org/{rng.randrange(9)}", b) for b in [0, 1] * 300]
    got = url_filter.held_out_by_host(spark.createDataFrame(rows, "url string, blocked int"))
    assert sum(got.values()) == 600 and got["blocked_right"] + got["allowed_right"] > 570


def test_op7(spark, sf, docs):
    got = run(spark, sf, "op7_minhash")
    order, by_text = sorted(docs, reverse=True), {}
    for i, nxt in zip(order, [*order[1:], order[0]], strict=True):
        t, after, r = docs[i] or "", docs[nxt] or "", got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(edited.encode())) and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint and by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert edited != t or r.near_edited == 1
        assert after != t or r.near_next == 1


def test_op7_near_group_and_fingerprint(spark, sf, docs):
    """Groups against plain Jaccard of 5-word sets, fingerprints against a plain MinHash."""
    got = run(spark, sf, "op7_minhash")
    assert {i: r.near_group for i, r in got.items()} == {i: c for i, (_, c) in brute_components(list(docs.items()), 5, 80).items()}
    a, b = fingerprints.permutations(fingerprints.PERMS)
    for i in list(docs)[::9]:
        raw, off = textbatch.buffers(pa.array([docs[i] or ""]))
        h, _ = textbatch.shingles(textbatch.Words(raw, off), 5)
        least = [min(((int(x) * int(p) + int(q)) % 2**64 >> 32 for x in h[:3000]), default=2**32 - 1) for p, q in zip(a, b, strict=True)] if len(h) <= 3000 else None
        assert least is None or got[i].fingerprint == struct.pack("<128I", *least).hex()


def test_op8(spark, sf, docs):
    got = run(spark, sf, "op8_suffix_dedup")
    for (i, t), (spans, kept) in zip(docs.items(), brute_repeats(list(docs.values()), 400), strict=True):
        n = len((t or "").encode())
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256, got[i].n_kept) == (n, n - len(kept), len(spans), sha(kept), len(kept))


def test_op8_passages_of_fifty_words(spark, sf, docs):
    """The text that is left has no repeated passage of 50 words, those under 400 bytes included."""
    got = run(spark, sf, "op8_suffix_dedup")
    for i, clean in zip(docs, brute_clean(list(docs.values()), 400, 50), strict=True):
        assert (got[i].clean_text, got[i].n_clean) == (clean, len(clean.encode()))


def test_op9_and_op10(spark, sf, docs):
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    tok.no_truncation()
    files, counts, start = run(spark, sf, "op9_token_files"), run(spark, sf, "op10_token_counts"), 0
    for i in sorted(docs):
        ids = tok.encode(docs[i] or "", add_special_tokens=False).ids
        assert (counts[i].n_bytes, counts[i].n_tokens, counts[i].over_limit) == (len((docs[i] or "").encode()), len(ids), len(ids) > 2048)
        ids = [*ids, 2]
        assert (files[i].start, files[i].n_tokens, files[i].ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
