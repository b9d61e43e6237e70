"""Rows every operator has to take: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, ids string, size string, score string"


def texts() -> list[str | None]:
    rng = random.Random(5)
    word = ["the", "Of", "ANd", "it's", "été", "naïve", "x1y2", "<|endoftext|>", "a<|startoftext|>b", "###", "é", "́x", "ﬁ", "Σίσυφος", "東京", "🙂", "don'T", "\x1cq", " ", " z"]
    gap = [" ", "  ", "\n", "\t", "\r\n", "  ", "\x0b"]
    out: list[str | None] = [None, "", " ", "\n\n", "a", "A a", "a" * 5000, " " * 3000, "ab " * 60000]
    out += ["".join(rng.choice(word) + rng.choice(gap) for _ in range(rng.choice([1, 3, 40, 400]))) for _ in range(40)]
    out += [out[12], out[12], out[13]]
    return out


def rows() -> list[tuple]:
    return [(i if i != 3 else None, t, None, None if i % 7 == 0 else f"s{i % 3}", None, "clash", "clash", "clash", "clash") for i, t in enumerate(texts())]


def frame(spark, empty: bool = False):
    return spark.createDataFrame([] if empty else rows(), SCHEMA)
