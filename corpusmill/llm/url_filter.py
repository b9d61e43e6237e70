"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the other URLs.

Features: lengths of URL, host, path and query, path depth, dots, hyphens, digit ratio and parameter count, by Spark's own functions;
byte entropy of the host and the path, by numpy over a batch; and suffix statistics (the smoothed share of blocked URLs
among the training URLs with the same last label, last two and last three labels of the host).
Trees are fitted to labelled URLs by histogram splits on the logistic loss. The sample
is bounded by TRAIN_URLS; model and statistics go to the executors with the function.

Rules are a host suffix and a path prefix, written `host/path`; the longest that fits wins.

Defined results: a null URL or one without `://` has an empty host and path, fits no rule and is judged by
the model like any other; without training labels of both kinds the model allows all; repeated rows are judged each.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.textbatch import buffers

TRAIN_URLS = 20_000


@dataclass(frozen=True)
class Rule:
    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.partition("/")[2]


def host_of(url: Column) -> Column:
    """Between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? or #; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Pattern of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.pattern), r.pattern)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(r.pattern)).otherwise(out)
    return out


#: Features that Spark's own functions give, and those that the function below adds.
COUNTED = ("url_length", "host_length", "path_length", "query_length", "depth", "dots", "hyphens", "digit_ratio", "host_digits", "parameters", "fragment", "longest_label")
SUFFIXES = ("tld", "domain", "label")
FEATURES = (*COUNTED, "host_entropy", "path_entropy", *(f"{s}_share" for s in SUFFIXES))


def lexical(url: Column) -> Column:
    """Struct of the COUNTED features, host, path and suffixes (the last one, two and three labels of the host) of a URL."""
    url = F.coalesce(url, F.lit(""))
    part = lambda i: F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?", i)
    host, path, query = F.lower(part(1)), part(2), part(3)
    count = lambda c, kind: (F.char_length(c) - F.char_length(F.regexp_replace(c, kind, ""))).cast("double")
    length = lambda c: F.char_length(c).cast("double")
    values = {
        "url_length": length(url), "host_length": length(host), "path_length": length(path), "query_length": length(query),
        "depth": count(path, "/"), "dots": count(host, r"\."), "hyphens": count(host, "-"), "digit_ratio": count(url, "[0-9]") / F.greatest(length(url), F.lit(1.0)), "host_digits": count(host, "[0-9]"),
        "parameters": count(query, "="), "fragment": length(part(4)), "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.char_length)).cast("double"),
    }
    ends = [F.substring_index(host, ".", -k).alias(s) for k, s in enumerate(SUFFIXES, 1)]
    return F.struct(*[v.alias(n) for n, v in values.items()], host.alias("host"), path.alias("path"), *ends)


def entropies(texts: pa.Array) -> np.ndarray:
    """Entropy in bits of the bytes of each text of a null-free string array, 0 of an empty one."""
    raw, off = buffers(texts)
    n = np.diff(off)
    keys, times = np.unique(np.repeat(np.arange(len(n)), n) * 256 + raw, return_counts=True)
    doc = keys // 256
    share = times / n[doc]
    return np.bincount(doc, -share * np.log2(share), len(n))


class Suffixes:
    """Smoothed shares of blocked URLs by the suffixes of hosts, from the training URLs."""

    def __init__(self) -> None:
        self.shares: dict[str, dict[str, float]] = {s: {} for s in SUFFIXES}
        self.prior = 0.5

    def learn(self, rows: pa.StructArray, y: np.ndarray, smooth: float = 20.0) -> Suffixes:
        self.prior = float(y.mean())
        for kind in SUFFIXES:
            ends = rows.field(kind).dictionary_encode()
            total, blocked = np.bincount(ends.indices, minlength=len(ends.dictionary)), np.bincount(ends.indices, y, len(ends.dictionary))
            self.shares[kind] = dict(zip(ends.dictionary.to_pylist(), ((blocked + smooth * self.prior) / (total + smooth)).tolist(), strict=True))
        return self

    def matrix(self, rows: pa.StructArray) -> np.ndarray:
        """FEATURES of rows of `lexical`. Distinct suffixes are looked up once a batch."""
        out = [rows.field(c).to_numpy(zero_copy_only=False) for c in COUNTED] + [entropies(rows.field("host")), entropies(rows.field("path"))]
        for kind in SUFFIXES:
            ends = rows.field(kind).dictionary_encode()
            known = np.asarray([self.shares[kind].get(e, self.prior) for e in ends.dictionary.to_pylist()])
            out.append(known[ends.indices.to_numpy()] if len(rows) else np.zeros(0))
        return np.stack(out, axis=1)


class BoostedTrees:
    """Gradient-boosted regression trees on the logistic loss, with histogram splits."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, ridge: float = 1.0) -> None:
        self.n_trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge
        self.base, self.edges, self.trees = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
        self.base = math.log(share / (1 - share))
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1)
        raw = np.full(len(y), self.base)
        for _ in range(self.n_trees):
            p = 1 / (1 + np.exp(-raw))
            tree = self._grow(binned, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            raw += self._walk(tree, binned)
        return self

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = self.rate * total_g / (total_h + self.ridge)
        if depth == 0 or len(rows) < 2 * self.least:
            return value
        best, base = (1e-6, None, None), total_g**2 / (total_h + self.ridge)
        for f in range(x.shape[1]):
            b = x[rows, f]
            width = len(self.edges[f]) + 1
            cg, ch, cn = (np.cumsum(np.bincount(b, w, width))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = np.where((cn >= self.least) & (len(rows) - cn >= self.least), cg**2 / (ch + self.ridge) + (total_g - cg) ** 2 / (total_h - ch + self.ridge) - base, 0)
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        if best[1] is None:
            return value
        left = x[rows, best[1]] <= best[2]
        return best[1], best[2], self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1)

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        out, left = np.zeros(len(x)), x[:, tree[0]] <= tree[1]
        out[left], out[~left] = self._walk(tree[2], x[left]), self._walk(tree[3], x[~left])
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], axis=1)
        raw = np.full(len(x), self.base)
        for t in self.trees:
            raw += self._walk(t, binned)
        return 1 / (1 + np.exp(-raw))


@dataclass
class UrlModel:
    suffixes: Suffixes
    trees: BoostedTrees | None

    def block_score(self, rows: pa.StructArray) -> np.ndarray:
        """Scores of rows of `lexical`."""
        if self.trees is None:
            return np.zeros(len(rows))
        return self.trees.predict(self.suffixes.matrix(rows))


#: Words of host names that mark the training URLs as blocked where no other labels are given: gambling, adult matter, spam, medicine and loan sellers, advertising.
SEED_TERMS = tuple("adult ads adserver affiliate bet bets betting casino clickbait escort gambling jackpot loans lottery payday pharmacy pills poker porn replica sex slots spam tracker tracking viagra warez xxx".split())


def seed_labels(urls: DataFrame, url_col: str = "url", terms: tuple[str, ...] = SEED_TERMS) -> DataFrame:
    """url and blocked: whether a word of the host (between dots and hyphens) is one of the terms."""
    words = F.split(host_of(F.col(f"`{url_col}`")), r"[.\-]")
    return urls.select(F.col(f"`{url_col}`").alias("url"), F.arrays_overlap(words, F.array(*[F.lit(t) for t in terms])).alias("blocked"))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked", most: int = TRAIN_URLS) -> UrlModel:
    """Fit on at most `most` labelled URLs (label 1: block), taken in the order of a hash of the URL."""
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(url_col).isNotNull()).select(F.col(url_col).alias("u"), F.col(label_col).cast("int").alias("y")).distinct()
    picked = rows.orderBy(F.xxhash64(F.lit("fit"), F.col("u")), "u", "y").limit(most)
    got = picked.select("u", "y", lexical(F.col("u")).alias("x")).toArrow().sort_by([("u", "ascending"), ("y", "ascending")]).combine_chunks()
    y = got.column("y").to_numpy().astype(float)
    suffixes = Suffixes()
    if len(set(y.tolist())) < 2:
        return UrlModel(suffixes, None)
    x = pa.concat_arrays(got.column("x").chunks)
    # Half of the sample gives the suffix shares, the other half the trees: a share then says as little about its own row as about others.
    half = np.arange(len(y)) % 2 == 0
    suffixes.learn(x.filter(pa.array(half)), y[half])
    return UrlModel(suffixes, BoostedTrees().fit(suffixes.matrix(x.filter(pa.array(~half))), y[~half]))


def held_out_by_host(labelled: DataFrame, folds: int = 5, url_col: str = "url", label_col: str = "blocked", most: int = TRAIN_URLS, threshold: float = 0.5) -> dict[str, int]:
    """How the trees do on hosts that they have never seen: counts of right and wrong verdicts, every host judged by a model fitted without it.

    Hosts are dealt to folds by a hash, so no host is on both sides, nor are suffix shares of its own labels.
    """
    rows = labelled.where(F.col(label_col).isNotNull() & F.col(url_col).isNotNull())
    rows = rows.select(F.col(url_col).alias("url"), F.col(label_col).cast("int").alias("y"), F.pmod(F.xxhash64(F.lit("fold"), host_of(F.col(url_col))), F.lit(folds)).alias("fold"))
    out = Counter({k: 0 for k in ("blocked_right", "blocked_wrong", "allowed_right", "allowed_wrong")})
    for f in range(folds):
        model = train(rows.where(F.col("fold") != f), label_col="y", most=most)
        blocks = (F.col("verdict") == "block").cast("int")
        for r in judge(rows.where(F.col("fold") == f), model, (), threshold=threshold).groupBy("y", blocks.alias("said")).count().collect():
            out[("blocked" if r.said else "allowed") + ("_right" if r.said == r.y else "_wrong")] += r["count"]
    return dict(out)


def judge(df: DataFrame, model: UrlModel, rules: tuple[Rule, ...], url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Add host, path, rule, block_score and verdict: the rule's where one fits, else the model's."""

    @F.arrow_udf(T.DoubleType())
    def block_score(rows: pa.Array) -> pa.Array:
        return pa.array(model.block_score(rows))

    url = F.col(f"`{url_col}`")
    out = df.withColumns({"host": host_of(url), "path": path_of(url), "block_score": block_score(lexical(url))})
    out = out.withColumn("rule", best_rule(F.col("host"), F.col("path"), rules))
    by_rule = F.coalesce(*[F.when(F.col("rule") == r.pattern, F.lit(r.verdict)) for r in rules], F.lit(None).cast("string")) if rules else F.lit(None).cast("string")
    return out.withColumn("verdict", F.coalesce(by_rule, F.when(F.col("block_score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))))
