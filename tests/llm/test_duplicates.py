from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm import awkward

from corpusmill.llm import components, fingerprints, hot_keys, ngram_join, suffix_dedup
from corpusmill.session import written

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, n string, id string, key string, kept string"


def sets_of(rows, k):
    out = {}
    for i, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_components(rows, k=3, percent=90):
    sets, root = sets_of(rows, k), {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            c = len(sets[a] & sets[b])
            if a < b and c and 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_rows():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    texts = []
    for _ in range(6):
        base = [rng.choice(vocab) for _ in range(rng.choice([4, 30, 150, 600]))]
        for _ in range(40):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5, 8])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            texts.append(" ".join(w).upper() if rng.random() < 0.2 else "\n".join(w))
    return texts


def test_join_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 7)  # many blocks
    texts = near_rows() + [t for t in awkward.texts() if t is None or len(t) < 20000]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(df).collect()}
    assert got == brute_components(rows)


def test_join_of_empty_and_null_ids(spark):
    assert ngram_join.linked_components(awkward.frame(spark, empty=True)).count() == 0
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (7, ""), (7, ""), (None, "x y z"), (None, None)], "doc_id long, text string")
    assert sorted(map(tuple, ngram_join.linked_components(df).collect()), key=str) == sorted([(None, 2, 5), (5, 2, 5), (7, 0, 7), (7, 0, 7), (None, 1, None), (None, 0, None)], key=str)
    # A text whose ids are all null still links others; texts that share an id are rows of their own.
    chain = [[f"w{i}" for i in range(100)] for _ in range(3)]
    chain[1][0], chain[2][0], chain[2][99] = "a", "a", "b"
    rows = [(8, " ".join(chain[0])), (None, " ".join(chain[1])), (9, " ".join(chain[2])), (9, "q r s")]
    got = ngram_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(8, 98, 8), (None, 98, 8), (9, 98, 8), (9, 1, 9)], key=str)


def test_sketch_distance_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
        b = np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, 10, dtype=np.uint64)])
        h, doc = np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)])
        words = ngram_join.bit_sketch(h, doc, 2)
        differ = len(set(a.tolist()) ^ set(b.tolist()))
        assert np.bitwise_count(words[0] ^ words[1]).sum() <= differ
        assert ngram_join.distance(ngram_join.wide_sketch(a), ngram_join.wide_sketch(b)) <= differ
        assert ngram_join.distance(ngram_join.wide_sketch(a), ngram_join.wide_sketch(a[:9])) <= len(a) - 9


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key(percent):
    rng = np.random.default_rng(percent)
    make = ngram_join.parity_keys(percent)
    for n in [*range(1, 40), 100, 333, 1000, 4000] * 6:
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        common = a[rng.permutation(n)[: n - int(rng.integers(0, n // 5 + 1))]]
        b = np.unique(np.concatenate([common, rng.integers(0, 2**64, int(rng.integers(0, n // 5 + 1)), dtype=np.uint64)]))
        if 100 * len(common) < percent * (len(a) + len(b) - len(common)):
            continue
        owner, key = make(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]))
        assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist())


def test_large_keys_are_dealt_to_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 20)
    monkeypatch.setattr(ngram_join, "SAMPLE", 3)
    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 7), (2, 9), (3, 5), (4, 9), (4, 7), (5, 7), (5, 9), (5, 11)], "key long, id long")
    got = ngram_join.shared_keys(rows).collect()
    assert sorted((r.key, r.id) for r in got) == [(1, i) for i in range(500)] + [(2, 7), (2, 9), (5, 7), (5, 9), (5, 11)]
    sizes = Counter(r.block for r in got if r.key == 1)
    assert len(sizes) > 12 and max(sizes.values()) < 60


def test_bands_meet_every_linkable_size():
    tops = ngram_join.band_tops(5000)
    for n in range(1, 2000):
        for m in range(n, min(-(-n * 100 // 90) + 1, 2400)):
            if 100 * n >= 90 * m:
                bn, bm = np.searchsorted(tops, [n, m])
                assert bm == bn or (bm == bn + 1 and 100 * n >= 90 * (tops[bn] + 1))
                assert ngram_join.max_difference(n, m, 90) <= ngram_join.band_difference(tops[bm], 90)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (200, 100), (300, 300), (7, 50)] + [(1000, 1000 + k) for k in range(1, 40)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in [*range(31), 50]) and got[200] == got[100] == 100 and all(got[1000 + k] == 1000 for k in range(40)) and 300 not in got
    assert components.components(spark.createDataFrame([], "src long, dst long")).count() == 0


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[s : s + length] for b in data for s in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if seen[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def repeat_texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshré") for _ in range(rng.randint(1, 7)))
    passage = [" ".join(word() for _ in range(n)) for n in (60, 75, 90, 300)]
    texts = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 120))) for _ in range(3)]
        p = rng.choice(passage)
        if i % 2:
            cut = rng.randint(0, len(p) // 4)
            p = p[cut : len(p) - rng.randint(0, len(p) // 4)]
        texts.append(parts[0] + p + parts[1] + (rng.choice(passage) if i % 5 == 0 else "") + parts[2])
    texts += ["ab" * 700, "ab" * 250 + "x", "q" * 399, "q" * 400, "q" * 401, "zyx " * 300 + "end", texts[0], texts[1][:-1], None, "", "é" * 500, "Erlyre " * 200]
    near = list(texts[3])
    for _ in range(3):
        near[rng.randrange(len(near))] = "#"
    return [*texts, "".join(near)]


def test_repeats_equal_brute_force(spark):
    texts = repeat_texts()
    df = spark.createDataFrame([(i if i != 4 else None, t, "x", "x", "x", "x") for i, t in enumerate(texts)], SCHEMA)
    got = suffix_dedup.remove_repeats(df, kept_col="rest").select("text", "removed", "rest", "n").collect()
    want = {t: x for t, x in zip(texts, brute_repeats(texts, 400), strict=True)}
    assert len(got) == len(texts)
    for r in got:
        spans, kept = want[r.text]
        assert [(s.start, s.stop) for s in r.removed] == spans and bytes(r.rest) == kept and r.n == "x"
    assert suffix_dedup.remove_repeats(awkward.frame(spark, empty=True)).count() == 0


def test_repeats_of_other_lengths(spark):
    texts = [t for t in repeat_texts() if t][:30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: ([(s.start, s.stop) for s in r.removed], bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, length=150).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 150)))


@pytest.fixture
def every_key_large(monkeypatch):
    """Keys of three rows are large, and their rows are dealt to blocks of two."""
    for name, value in (("SAMPLE", 1), ("LARGE", 3), ("BLOCK_ROWS", 2)):
        monkeypatch.setattr(hot_keys, name, value)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_dealt_join_equals_a_join(spark, every_key_large, how):
    rows = spark.createDataFrame([(k, i) for k in range(5) for i in range(4 * k)], "k long, i long")
    keys = spark.createDataFrame([(k, f"v{k}") for k in (1, 3, 4, 9)], "k long, v string")
    large = hot_keys.sampled(rows, ["k"], F.xxhash64("i"))
    assert {(r.k, r.blocks) for r in large.collect()} == {(k, 2 * k) for k in range(1, 5)}
    got = hot_keys.dealt_join(rows, keys, ["k"], how, large, F.xxhash64("i"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(keys, "k", how).collect()), key=str)


def test_results_do_not_depend_on_the_dealing(spark, every_key_large):
    texts = repeat_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: ([(s.start, s.stop) for s in r.removed], bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == dict(enumerate(brute_repeats(texts, 400)))
    copies = [(i, t) for i, t in enumerate(near_rows()[:60] * 2 + [None, "", " "] * 3)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    assert got == brute_components(copies)


def brute_clean(texts, length, words):
    """Texts without repeated strings of `length` bytes or of `words` words."""
    data = [(t or "").encode() for t in texts]
    at = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)] for b in data]
    windows = [[(x[0], y[1]) for x, y in zip(w, w[words - 1 :], strict=False)] for w in at]
    seen = Counter(b[s:e] for b, w in zip(data, windows, strict=True) for s, e in w)
    whole, out = Counter(texts), []
    for t, b, w, (spans, _) in zip(texts, data, windows, brute_repeats(texts, length), strict=True):
        gone = bytearray(len(b))
        for s, e in [*spans, *((s, e) for s, e in w if seen[b[s:e]] > 1), *([(0, len(b))] if whole[t] > 1 and w else [])]:
            gone[s:e] = b"\1" * (e - s)
        out.append(bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore"))
    return out


def short_passages():
    """Passages of over 50 words and under 400 bytes, in texts of their own and inside longer repeats, with odd neighbours."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("etaoinshré") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    short, long, tiny = [text(n) for n in (51, 55, 60)], text(160), " ".join(rng.choice("abc") for _ in range(52))
    assert all(len(p.encode()) < 400 for p in (*short, tiny))
    inner = " ".join(long.split(" ")[40:93])
    texts = [f"{text(rng.randint(0, 90))} {p}{gap}{text(rng.randint(0, 90))}" for p in (*short, inner, tiny) for gap in ("\n", " ") for _ in range(2)]
    texts += [f"{text(30)} {long} {text(20)}", f"{text(9)}\t{long}", f"{long} {text(50)}", f"{text(70)} {short[0]} {text(5)} {short[0]}", f"{text(40)} {text(51)}", f"{short[1]}x {text(60)}"]
    return [*texts, text(60), text(49), tiny, short[2], texts[3], "a " * 300, "b " * 60 + "c", text(52)[:-1], " " * 500, None, "", "", long, "q" * 399]


def clean_texts(spark, texts, words=50):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(df, words=words).collect()
    assert {r.doc_id: ([(s.start, s.stop) for s in r.removed], bytes(r.kept)) for r in rows} == dict(enumerate(brute_repeats(texts, 400)))
    return {r.doc_id: r.clean_text for r in rows}


def test_repeated_passages_of_fifty_words(spark):
    """Passages of over 50 words stayed where they had less than 400 bytes."""
    texts = short_passages()
    want = brute_clean(texts, 400, 50)
    assert sum(w != b.decode("utf-8", "ignore") for w, (_, b) in zip(want, brute_repeats(texts, 400), strict=True)) > 20
    assert clean_texts(spark, texts) == dict(enumerate(want))


@pytest.mark.parametrize("words", [1, 7, 90])
def test_repeated_passages_of_other_lengths(spark, words):
    texts = [*short_passages(), *repeat_texts()]
    assert clean_texts(spark, texts, words) == dict(enumerate(brute_clean(texts, 400, words)))


def test_repeated_passages_do_not_depend_on_the_dealing(spark, every_key_large):
    texts = short_passages()
    assert clean_texts(spark, texts) == dict(enumerate(brute_clean(texts, 400, 50)))


def test_ranks_are_joined_in_one_form(spark, monkeypatch):
    """A position has one row at most after the ranks' join, and the join has the same keys whether or not a pair is large."""
    pairs = spark.createDataFrame([(k, k, j, 0, 1, j % 3, j % 2) for k in range(9) for j in range(12)], "k1 long, k2 long, j int, b int, e int, r1 long, r2 long")
    forms = set()
    for least in (3, 10**6):
        for name, value in (("SAMPLE", 1), ("LARGE", least), ("BLOCK_ROWS", 2)):
            monkeypatch.setattr(hot_keys, name, value)
        monkeypatch.setattr(suffix_dedup, "written", lambda df, label: (forms.add(df._jdf.queryExecution().optimizedPlan().toString().count("deal#") > 0), written(df, label))[1])
        out = suffix_dedup.rerank(pairs, ["r1", "r2"], "ranks")
        assert out.count() == pairs.count() == out.select("k1", "k2", "j").distinct().count()
    assert forms == {True}


def test_ranks_take_two_rounds_however_long_the_repeats(spark, monkeypatch):
    """Ranks were made in a round for every doubling of the longest repeat."""
    rng = random.Random(3)
    long = " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(1500))
    texts = [f"one {long} two", f"three {long}", "four"]
    labels = []
    monkeypatch.setattr(suffix_dedup, "written", lambda df, label: (labels.append(label), written(df, label))[1])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(df).collect()}
    assert got == {i: kept for i, (_, kept) in enumerate(brute_repeats(texts, 400))}
    assert sum("ranks" in x for x in labels) == 2


def test_next_document_and_likeness(spark):
    df = awkward.frame(spark)
    rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda x: (x[0] is None, -(x[0] or 0)))
    got = fingerprints.compare_with_next(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    sets = sets_of([(i, t) for i, t in rows], 5)
    for k, (i, t) in enumerate(rows):
        j, nxt = rows[(k + 1) % len(rows)]
        r, half = by[i], len(t) // 2
        changed = t[: len(t) - half] + nxt[:half]
        assert (r.n_chars, r.edited) == (len(t), changed)
        for seen, other in ((r.near_next, sets[j]), (r.near_edited, sets_of([(0, changed)], 5)[0])):
            union = sets[i] | other
            assert seen == pytest.approx(len(sets[i] & other) / len(union) if union else 1.0, abs=0.2)
    prints = {}
    for (i, t) in rows:
        assert prints.setdefault(t, by[i].fingerprint) == by[i].fingerprint
    assert fingerprints.compare_with_next(awkward.frame(spark, empty=True)).count() == 0
    one = fingerprints.compare_with_next(df.where("doc_id = 20")).first()
    assert one.near_next == 1.0


def test_near_duplicate_groups(spark):
    texts = [*near_rows(), None, "", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in fingerprints.near_duplicates(df).collect()}
    # Bands may miss a pair with probability 0.001; here every link is found.
    assert got == {i: c for i, (_, c) in brute_components(list(enumerate(texts)), 5, 80).items()}
    assert fingerprints.near_duplicates(awkward.frame(spark, empty=True)).count() == 0
    assert fingerprints.signatures(pa.array(["", " "]), 16).tolist() == [[0xFFFFFFFF] * 16] * 2


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    texts = repeat_texts() + near_rows()[:60]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", None, None, None)]
    rows += [(1000 + i, " ".join(f"the {w}{i} of and" for w in "abcdefghijklmnopqrst"), "en", "s1", None) for i in range(8)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        seen.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.where("n_chars != char_length(text)").count() == 0
    assert seen[0] >= 8 and seen[1] <= seen[0]
    ids = docs.select("decoded_sha256").distinct().count()
    texts_left = spark.read.parquet(str(tmp_path / "stage3")).select(F.sha2(F.col("text").cast("binary"), 256).alias("h")).distinct()
    assert ids == texts_left.count() and {r.h for r in texts_left.collect()} == {r.decoded_sha256 for r in docs.select("decoded_sha256").distinct().collect()}
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
