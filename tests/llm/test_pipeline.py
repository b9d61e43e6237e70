"""The stages of the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import tiktoken
from tests.llm.test_duplicates import brute_components, brute_repeats, near_rows
from tests.llm.test_text_operators import WORDS, brute_quality, brute_targets
from tiktoken.load import load_tiktoken_bpe

from corpusmill.llm import quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], SCHEMA)


def test_near_copies_equal_brute_force_at_five_words(spark):
    words = [f"w{i}" for i in range(200)]
    # Four edits in 200 words: similarity 0.81 on five words, but 0.88 on three.
    edited = [f"x{i}" if i in (30, 70, 110, 150) else w for i, w in enumerate(words)]
    rows = list(enumerate([*near_rows(), " ".join(words), " ".join(edited), "", None, "a b"]))
    got = sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, frame(spark, rows), "").collect())
    at_five = {i: c for i, (_, c) in brute_components(rows, 5, 80).items()}
    at_three = {i: c for i, (_, c) in brute_components(rows, 3, 90).items()}
    assert got == sorted(i for i, c in at_five.items() if i == c)
    assert at_five[241] == 240 and at_three[241] == 241


def test_repeated_rows_stay_once_through_stages_two_and_three(spark):
    text = lambda k: " ".join(f"{k}word{i}" for i in range(80))
    near = text("e").replace("eword70", "other")
    rows = [(1, text("a")), (1, text("a")), (2, text("b")), (2, text("c")), (3, text("d")), (None, text("f")), (None, text("f")), (None, text("d"))]
    rows += [(5, text("e")), (4, near), (4, near), (6, ""), (6, ""), (6, None)]
    kept = corpus_pipeline.near_copies(spark, frame(spark, rows), "")
    assert kept.columns == list(corpus_pipeline.COLUMNS)
    want = [(1, text("a")), (2, text("b")), (2, text("c")), (3, text("d")), (4, near), (None, text("f"))]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted((x for x in got if x[1]), key=str) == sorted(want, key=str)
    assert [(i, t or "") for i, t in got if not t] == [(6, "")]
    assert sorted(((r.doc_id, r.text) for r in corpus_pipeline.repeated_passages(spark, kept, "").collect()), key=str) == sorted(want, key=str)


def test_a_few_repeated_lines_are_no_junk(spark):
    lines = [" ".join(f"the word{i}x{j} of and tree{i}x{j}" for j in range(4)) for i in range(8)]
    rows = [(1, "\n".join([*lines, *["the menu"] * 5])), (2, "\n".join([*lines, *["the menu"] * 12]))]  # 4 of 13 and 11 of 20 lines repeat one
    assert {r.doc_id: r.kept for r in quality_rules.judge(frame(spark, rows)).select("doc_id", "kept").collect()} == {1: True, 2: False}


def brute_kept(text):
    n, chars, symbols, dup, repeated, failed = brute_quality(text)
    lines = len([x for x in (text or "").split("\n") if WORDS.search(x)])
    stops = {w for x in quality_rules.STOP_WORDS.values() for w in x.split()}
    stop = sum(w.lower() in stops for w in WORDS.findall(text or ""))
    return not failed and 3 <= chars / n <= 12 and symbols / n <= 0.1 and text.count("!") / n <= 0.1 and stop / n >= 0.02 and dup / lines <= 0.5 and repeated / n <= 0.5


def brute_mix(rows):
    """(doc_id, source, text) of (doc_id, source, text) as often as the mix takes them."""
    names = sorted({s for _, s, _ in rows})
    words = lambda t: len(WORDS.findall(t))
    sizes = [sum(words(t) for _, x, t in rows if x == s) for s in names]
    out = []
    for s, size, target in zip(names, sizes, brute_targets(sizes, [(3.0, 1.0, 2.0)[i % 3] for i in range(len(names))], 1.5, 2.0), strict=True):
        whole, left = divmod(int(target + 1e-9), size)
        for i, _, t in sorted((r for r in rows if r[1] == s), key=lambda r: hashlib.md5(f"mix-1:{r[0]}".encode()).hexdigest()):
            part = min(words(t), left)
            left -= part
            copies, rest = divmod(whole * words(t) + part, words(t))
            out += [(i, s, t)] * copies + [(i, s, "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", t)[:rest]))] * (rest > 0)
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["the", "of", "und", f"wört{rng.randrange(10**6)}", f"w{rng.randrange(10**6)}"]) for _ in range(n))
    base, passage = text(200).split(" "), text(90)
    edited = [f"x{k}" if k in (30, 70, 110, 150) else w for k, w in enumerate(base)]
    texts = [text(rng.choice([20, 60, 90, 150, 400])) for _ in range(25)] + [" ".join(base), " ".join(edited), " ".join(base), "### " * 80, "", None]
    texts += [f"{text(60)} {passage} {text(70)}", f"{text(80)} {passage}", "\n".join([text(30), text(30), "the menu", "the menu"])]
    docs = frame(spark, list(enumerate(texts)))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = [(i, t) for i, t in enumerate(texts) if brute_kept(t)]
    near = {i: c for i, (_, c) in brute_components(kept, 5, 80).items()}
    alone = [(i, t) for i, t in kept if near[i] == i]
    cut = [(i, f"s{i % 3}", b.decode("utf-8", "ignore")) for (i, _), (_, b) in zip(alone, brute_repeats([t for _, t in alone], 400), strict=True)]
    assert len(texts) > len(kept) > len(alone) and sum(t != c for (_, t), (_, _, c) in zip(alone, cut, strict=True)) == 2
    coder = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_tiktoken_bpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = [(i, s, len(ids := coder.encode_ordinary(t)), ids, hashlib.sha256(t.encode()).hexdigest()) for i, s, t in brute_mix([r for r in cut if r[2]])]
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(want)


def test_repeated_passages_of_fifty_words_go(spark):
    """A passage of over 50 words and under 400 bytes in two documents stayed in both."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(10**4)}" for _ in range(n))
    passage, around = text(55), [text(60) for _ in range(5)]
    assert len(passage) < 400
    docs = frame(spark, [(0, f"{around[0]} {passage} {around[1]}"), (1, f"{around[2]}\n{passage}"), (2, around[3]), (3, passage[:200] + around[4]), (4, None)])
    got = {r.doc_id: r.text for r in corpus_pipeline.repeated_passages(spark, docs, "").collect()}
    assert got == {0: f"{around[0]}  {around[1]}", 1: f"{around[2]}\n", 2: around[3], 3: passage[:200] + around[4]}
