"""Operators 11 to 13: their cores and registered queries against brute force, and language labels on held-out and code-switched texts."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from tests.llm import awkward

from corpusmill.llm import conversation_repair, language_id, periodic_runs, queries

STEMS = {"en": ["the", "thing", "with", "ation", "hand"], "fr": ["dé", "queux", "elle", "pour", "été"], "de": ["über", "schung", "keit", "und", "ße"]}


def text_in(lang: str, n: int, rng: random.Random) -> str:
    stems = STEMS[lang]
    return " ".join(rng.choice(stems) + (rng.choice(stems) if rng.random() < 0.5 else "") + rng.choice(["", "", ".", ","]) for _ in range(n))


# -- 11 ------------------------------------------------------------------------
def test_forward_backward_is_that_of_a_plain_loop():
    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 127, 128, 129, 700):
        e, t, first = rng.random((n, 3)) ** 4 + 1e-6, rng.random((3, 3)) + 0.01, rng.random(n) < 0.1
        first[0] = True
        a, b = language_id.forward_backward(e, t, first)
        got = a * b / (a * b).sum(axis=1, keepdims=True)
        alpha, beta = np.ones((n, 3)), np.ones((n, 3))
        for i in range(n):
            alpha[i] = e[i] * (1 if first[i] else alpha[i - 1] @ t)
            alpha[i] /= alpha[i].sum()
        for i in range(n - 2, -1, -1):
            if not first[i + 1]:
                beta[i] = t @ (e[i + 1] * beta[i + 1])
                beta[i] /= beta[i].sum()
        want = alpha * beta
        assert np.allclose(got, want / want.sum(axis=1, keepdims=True))


def test_texts_in_a_batch_do_not_touch():
    texts = ["ab", "cd é", "", "1", "Ab"]
    whole = language_id.encode(pa.array(texts))
    ones = [language_id.encode(pa.array([t])) for t in texts]
    for part in ("pairs", "triples", "entry"):
        assert getattr(whole, part).tolist() == np.concatenate([getattr(o, part) for o in ones]).tolist()
    for k in range(len(whole.affixes)):
        assert whole.affixes[k].tolist() == np.concatenate([o.affixes[k] for o in ones]).tolist()
    assert whole.entry[0] == whole.entry[-1]


def test_weights_follow_the_likelihood():
    rng = random.Random(1)
    texts, langs = zip(*[(text_in(x, 12, rng), i) for i, x in enumerate(["de", "en", "fr"]) for _ in range(20)], strict=True)
    x = language_id.encode(pa.array(texts))
    label = np.repeat(langs, np.diff(x.first_word))
    first = language_id._firsts(x.first_word)

    def loss(m):
        return -np.log(m.probabilities(x)[np.arange(len(label)), label]).mean()

    losses = [loss(language_id.Model(["de", "en", "fr"]).fit(x, label, first, rounds=r)) for r in (1, 5, 20)]
    assert np.log(3) > losses[0] > losses[1] > losses[2]


@pytest.fixture(scope="module")
def languages(spark, tmp_path_factory):
    """A table of documents in three languages among awkward ones, the query's rows and its model."""
    rng = random.Random(4)
    rows = [(i, text_in(lang := rng.choice(sorted(STEMS)), rng.choice([1, 5, 60, 300]), rng), lang) for i in range(400)]
    rows += [(1000 + i, t, None) for i, t in enumerate(awkward.texts())] + [(None, "the thing", "xx"), (7, "the thing with", "en"), (2000, "the thing", None)]
    root = str(tmp_path_factory.mktemp("languages"))
    spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, lang string, score string, letter string").repartition(3).write.parquet(f"{root}/documents.parquet")
    return rows, queries.queries()["op11_language_id"](spark, root).collect()


def test_op11_held_out(languages):
    rows, got = languages
    assert sorted((r.doc_id is None, r.doc_id) for r in got) == sorted((i is None, i) for i, _, _ in rows)
    known = {i: lang for i, _, lang in rows if lang and i != 7}
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert len(held) > 50 and np.mean([r.lang_pred == known[r.doc_id] for r in held]) > 0.97
    by_id = {i: t for i, t, _ in rows if i != 7}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.lang_pred in (*STEMS, "und")
        if r.doc_id in by_id:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in by_id[r.doc_id] or ""))


def test_code_switched_text_is_labelled_piece_by_piece(spark):
    rng = random.Random(9)
    train = [(i, text_in(lang, 40, rng), lang) for i, lang in enumerate(list(STEMS) * 40)]
    model = language_id.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    mixed = [(i, [(lang, text_in(lang, 15, rng)) for lang in rng.sample(sorted(STEMS), 3)]) for i in range(30)]
    frame = spark.createDataFrame([(i, " ".join(t for _, t in parts), "clash") for i, parts in mixed], "doc_id long, text string, spans string")
    right = total = 0
    for r in language_id.label(frame, model).collect():
        got = [s.lang for s in r.spans for _ in range(s.words)]
        want = [lang for lang, t in dict(mixed)[r.doc_id] for _ in t.split()]
        assert [s.first for s in r.spans] == [0, *itertools.accumulate(s.words for s in r.spans)][:-1]
        low = r.text.lower().encode()
        assert [len(low[s.start : s.stop].split()) for s in r.spans] == [s.words for s in r.spans]
        right, total = right + sum(a == b for a, b in zip(got, want, strict=True)), total + len(want)
    assert right / total > 0.95


def test_nothing_learned_and_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language_id.train(empty)
    assert [tuple(r) for r in language_id.label(spark.createDataFrame([(1, "the")], "doc_id long, text string"), model).collect()] == [(1, "the", "und", 0.0, [])]
    assert language_id.label(empty, model).count() == 0
    one = language_id.train(spark.createDataFrame([(1, "the thing", "en"), (2, None, "en")], "doc_id long, text string, lang string"))
    assert [r.lang_pred for r in language_id.label(spark.createDataFrame([("word",), ("12",), (None,)], "text string"), one, spans=False).collect()] == ["en", "und", "und"]


# -- 12 ------------------------------------------------------------------------
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    """Rows after damage by conversation, in order, written plainly."""
    out = {r[0]: [] for r in rows}
    for conv, turn, role, text in rows:
        name = lambda v: " " if v is None else str(v)
        kind, role, text = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20, name(role), name(text)
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def plain_repair(rows):
    """Every sequence of edits with at most two inserts in a gap, by enumeration."""
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    inserts = [[(2 * k, "I" * k, tuple(("user" if x == "u" else "assistant", "") for x in s)) for k in range(3) for s in (itertools.product("ua", repeat=k) if k < 2 else ("ua", "au"))]]
    steps = list(inserts)
    for (_, role, text), fault in zip(rows, faults, strict=True):
        own = [(3, "D", ())]
        if fault not in ("blank", "duplicate"):
            more = fault == "truncated"
            own += [(more, "K", ((role, text),))] + [(2 + more, "R", ((r, text),)) for r in ("user", "assistant")]
        steps += [own, *inserts]
    best = None
    for path in itertools.product(*steps):
        cost, audit = sum(p[0] for p in path), "".join(p[1] for p in path)
        if best and (cost, audit) >= best[:2]:
            continue
        out = [t for p in path for t in p[2]]
        if all(r for r, _ in out) and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out)):
            best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, *best[:2], hashlib.sha256(best[2].encode()).hexdigest()


def conversations(n: int, longest: int, seed: int):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "tool", ""])
            rows.append((c, None if rng.random() < 0.05 else turn + rng.choice([0, 0, 0, 1]), role, rng.choice(["Yes.", "No!", "cut", "Why? ", "", None, " \n", "é.", "Yes."])))
    return rows + [(None, 1, "user", "Hm."), (None, 2, "assistant", "Ah.")]


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("longest,n", [(2, 60), (3, 10)])
def test_op12_equals_enumeration(spark, tmp_path, longest, n):
    rows = conversations(n, longest, longest)
    spark.createDataFrame([(*r, "clash") for r in rows], CONV + ", seen string").repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in queries.queries()["op12_conversation_repair"](spark, str(tmp_path)).collect()}
    want = {c: v for c, v in damaged(rows).items() if len(v) <= 3}
    assert got.keys() == {r[0] for r in rows} and len(want) >= n / 2
    for c, v in want.items():
        assert got[c] == plain_repair(v), (c, v)


def cheapest(rows):
    """(cost, audit) by shortest paths over (turn, state), with whole audits and no settling."""
    best, seen = {"": (0, "")}, set()

    def relax(to, state, value):
        if state not in to or value < to[state]:
            to[state] = value

    def close(at):
        for _ in range(4):
            for s, (c, a) in list(at.items()):
                relax(at, {"": "u", "s": "u", "a": "u", "u": "a"}[s], (c + 2, a + "I"))
        return at

    close(best)
    for role, text in rows:
        bare, new = text.strip(WHITE), {}
        gone = not bare or (role, text) in seen
        more = bool(bare) and bare[-1] not in ".!?"
        seen.add((role, text))
        for s, (c, a) in best.items():
            relax(new, s, (c + 3, a + "D"))
            for x in () if gone else "sua":
                if s + x in ("s", "u", "su", "ua", "au"):
                    if role[:1] == x:
                        relax(new, x, (c + more, a + "K"))
                    if x != "s":
                        relax(new, x, (c + 2 + more, a + "R"))
        best = close(new)
    return min(best[s] for s in ("", "a") if s in best)


def test_long_conversations_settle_as_they_go(spark):
    rng = random.Random(3)
    kinds = [["user", "assistant"], ["user", "assistant", "system", "tool"], ["system"], ["user"]]
    convs = {c: [(rng.choice(kinds[c % 4]), rng.choice(["Yes.", "No.", "cut", ""]) + rng.choice(["", f" {i}."])) for i in range(rng.choice([5, 400, 1500]))] for c in range(24)}
    frame = spark.createDataFrame([(c, i, r, t) for c, v in convs.items() for i, (r, t) in enumerate(v)], CONV)
    got = {r.conv_id: r for r in conversation_repair.report(frame).collect()}
    turns = {}
    for r in conversation_repair.repaired(frame).collect():
        turns.setdefault(r.conv_id, []).append(r)
    for c, v in convs.items():
        assert (got[c].cost, got[c].audit) == cheapest(v)
        out = sorted(turns.get(c, []), key=lambda r: r.place)
        assert [r.place for r in out] == list(range(len(out)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in out))
        assert got[c].audit.replace("D", "") == "".join(r.edit for r in out)
        assert got[c].repaired_sha256 == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in out).encode()).hexdigest()


def test_no_conversations(spark):
    empty = spark.createDataFrame([], CONV)
    assert conversation_repair.report(empty).count() == conversation_repair.repaired(empty).count() == 0


# -- 13 ------------------------------------------------------------------------
def plain_runs(words, least=24, times=3):
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i < len(words) - q:
            start = i
            while i < len(words) - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if i > start and length >= max(least, times * q):
                out.setdefault((start, length), q)
            i = max(i, start + 1) if i == start else i
    return sorted((s, m, q) for (s, m), q in out.items())


def word_lists(n, seed):
    rng = random.Random(seed)
    for _ in range(n):
        words = [rng.randrange(rng.choice([1, 2, 3, 10, 100])) for _ in range(rng.choice([0, 1, 23, 24, 25, 60, 150, 500]))]
        for _ in range(rng.randrange(4)):
            if len(words) > 3:
                a = rng.randrange(len(words))
                p = rng.randint(1, max(1, (len(words) - a) // 3))
                for i in range(a, rng.randint(a, len(words))):
                    words[i] = words[a + (i - a) % p]
        yield words


def test_runs_equal_brute_force():
    for words in word_lists(600, 1):
        for least, times in ((24, 3), (4, 2)):
            assert periodic_runs.find_runs(np.array(words, np.int64), least, times) == plain_runs(words, least, times)


def test_lag_counts_are_exact():
    for words in word_lists(80, 2):
        if words:
            most = len(words) // 2
            got = periodic_runs.lag_counts(np.array(words, np.int64), most)
            assert got.tolist()[1:] == [sum(a == b for a, b in zip(words, words[p:], strict=False)) for p in range(1, most + 1)]


def test_op13(spark, tmp_path):
    rng = random.Random(6)
    docs = {3 * i: t for i, t in enumerate([*awkward.texts(), *(rng.choice([" ", "\n"]).join(f"w{x}" for x in w) for w in word_lists(120, 5))])}
    rows = [(i, t, "clash", "clash") for i, t in docs.items()]
    spark.createDataFrame([*rows, (None, "a b", "x", "y"), rows[20]], "doc_id long, text string, runs string, collapsed string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op13_periodic_runs"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) + 2
    planted = 0
    for r in got:
        words, h = (docs[r.doc_id] or "" if r.doc_id is not None else "a b").encode().split(), zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words, planted = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)], planted + 1
        # One word 60000 times needs no brute force.
        runs = plain_runs(words) if len(set(words)) > 1 else [(0, len(words), 1)] if len(words) >= 24 else []
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in runs)]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
    assert planted > 5


def test_a_word_a_million_times_and_an_empty_table(spark):
    assert periodic_runs.find_runs(np.zeros(1_000_000, np.int64)) == [(0, 1_000_000, 1)]
    assert periodic_runs.collapse(spark.createDataFrame([], "text string, runs int")).count() == 0
