"""Quality classifier: attention-based multiple-instance learning over the passages of a document.

A document is a bag of passages of PASSAGE_WORDS words. Every passage is encoded: surface ratios (character classes,
word lengths, repeats) and hashed word frequencies, then a learned hidden layer z = relu(W x + b).
Gated attention a_i = softmax_i(w . (tanh(V z_i) * sigmoid(U z_i))) weighs the passages, and the
score is sigmoid(c . sum a_i z_i + d). The weights are learned from document labels only, by
Adam on the cross entropy, on a bounded seeded sample of labelled documents (`TRAIN_DOCS`) and their passages (`TRAIN_PASSAGES`).
Encoding and scoring run on the executors in Arrow batches over whole texts, about 2 MB of text a step; one longer text is a step of its own
and takes some 34 bytes a byte. Only the sample's features (170 MB at most) and the few thousand weights pass through the driver.

Defined results: a null or empty text is a bag with one passage of zeros and gets a score like any other;
ids, sources, languages and labels are no inputs; labels of unknown documents or with null quality are not used;
without labels of both classes every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.bpe import slices
from corpusmill.llm.textbatch import Words, buffers, mix, shingles, steps, tidy

PASSAGE_WORDS = 64
#: Most labelled documents that a model is fitted on, taken in the order of a hash of their id, and passages of each, evenly spaced over the text.
TRAIN_DOCS, TRAIN_PASSAGES = 6000, 128
HASHED = 32
_CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", "|", "#", "*", "$", "%", "&", "<>", "!", ".,;:", "?", "'\"()-/", ""]
_LUT = np.full(256, len(_CLASSES) - 1, np.int64)
for _i, _chars in enumerate(_CLASSES):
    _LUT[[ord(c) for c in _chars]] = _i
N_FEATURES = len(_CLASSES) + 6 + HASHED


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of a null-free string array, and where each text's begin (one passage at least)."""
    raw, off = buffers(texts)
    words = Words(raw, off)
    count = np.diff(words.first_word)
    per = np.maximum(1, -(-count // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(per)])
    doc = np.repeat(np.arange(len(count)), count)
    at = np.arange(len(doc)) - words.first_word[doc]
    passage = first[doc] + at // PASSAGE_WORDS
    n = first[-1]
    out = np.zeros((n, N_FEATURES), np.float32)
    if not len(doc):
        return out, first
    # A passage's bytes reach from its first word to the next passage's, or to the end of its text: no other text of the batch counts.
    head = np.flatnonzero(at % PASSAGE_WORDS == 0)
    edge = words.start[head]
    size = np.minimum(np.append(edge[1:], len(raw)), off[1:][doc[head]]) - edge
    before = np.cumsum(size) - size
    byte = raw[np.arange(size.sum()) + np.repeat(edge - before, size)]
    kinds = np.bincount(np.repeat(passage[head], size) * len(_CLASSES) + _LUT[byte], minlength=n * len(_CLASSES)).reshape(n, -1)
    out[:, : len(_CLASSES)] = kinds / np.maximum(kinds.sum(axis=1, keepdims=True), 1)
    k = len(_CLASSES)
    in_passage = np.bincount(passage, minlength=n)
    some = np.maximum(in_passage, 1)
    length = (words.end - words.start).astype(np.float64)
    mean = np.bincount(passage, length, n) / some
    out[:, k] = in_passage / PASSAGE_WORDS
    out[:, k + 1] = mean / 10
    out[:, k + 2] = np.sqrt(np.maximum(np.bincount(passage, length**2, n) / some - mean**2, 0)) / 10
    out[:, k + 3] = np.bincount(passage, length <= 2, n) / some
    same = np.zeros(len(doc), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (doc[1:] == doc[:-1])
    out[:, k + 4] = np.bincount(passage, same, n) / some
    # Windows of three words that occur again in the text.
    h, of = shingles(words, 3)
    own = np.repeat(np.arange(len(count)), np.diff(of))
    key = mix(h + mix(own.astype(np.uint64)))
    order = np.argsort(key)
    again = np.zeros(len(key), bool)
    equal = key[order][1:] == key[order][:-1]
    again[order[1:][equal]] = True
    again[order[:-1][equal]] = True
    where = words.first_word[own] + np.arange(len(h)) - of[own]
    out[:, k + 5] = np.bincount(passage[where], again, n) / some
    bucket = (mix(words.hash) % np.uint64(HASHED)).astype(np.int64)
    out[:, k + 6 :] = np.bincount(passage * HASHED + bucket, minlength=n * HASHED).reshape(n, -1) / some[:, None]
    return out, first


class Model:
    """Hidden layer, gated attention and output of the classifier."""

    def __init__(self, prior: float = 0.5) -> None:
        self.prior, self.w = prior, None

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.w is None:
            return np.full(len(first) - 1, self.prior)
        return self._forward(x, first)[-1]

    def _forward(self, x: np.ndarray, first: np.ndarray):
        w = self.w
        x = (x - w["mean"]) / w["scale"]
        pre = x @ w["W"] + w["b"]
        z = np.maximum(pre, 0)
        t, u = np.tanh(z @ w["V"]), 1 / (1 + np.exp(-np.clip(z @ w["U"], -30, 30)))
        e = (t * u) @ w["w"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        a = e / np.add.reduceat(e, first[:-1])[bag]
        rep = np.add.reduceat(a[:, None] * z, first[:-1])
        p = 1 / (1 + np.exp(-np.clip(rep @ w["c"] + w["d"], -30, 30)))
        return x, pre, z, t, u, a, bag, rep, p

    def fit(self, x: np.ndarray, first: np.ndarray, y: np.ndarray, hidden: int = 32, gate: int = 16, epochs: int = 25, rate: float = 0.005, decay: float = 1e-4, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        x = x.astype(np.float64)
        d = x.shape[1]
        self.w = w = {"mean": x.mean(axis=0), "scale": x.std(axis=0) + 0.02, "W": rng.normal(0, (2 / d) ** 0.5, (d, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, hidden**-0.5, (hidden, gate)), "U": rng.normal(0, hidden**-0.5, (hidden, gate)), "w": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}
        names = ["W", "b", "V", "U", "w", "c", "d"]
        m, v, step = {k: np.zeros_like(w[k]) for k in names}, {k: np.zeros_like(w[k]) for k in names}, 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for s in range(0, len(order), 64):
                ids = order[s : s + 64]
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in ids])
                cut = np.concatenate([[0], np.cumsum(first[ids + 1] - first[ids])])
                g = self._gradients(x[rows], cut, y[ids])
                step += 1
                for k in names:
                    grad = g[k] + decay * w[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.999 * v[k] + 0.001 * grad**2
                    w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self

    def _gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        x, pre, z, t, u, a, bag, rep, p = self._forward(x, first)
        out = (p - y) / len(y)
        d_rep = out[:, None] * w["c"]
        along = (d_rep[bag] * z).sum(axis=1)
        d_e = a * (along - np.add.reduceat(a * along, first[:-1])[bag])
        d_tu = d_e[:, None] * w["w"]
        d_t, d_u = d_tu * u * (1 - t**2), d_tu * t * u * (1 - u)
        d_z = a[:, None] * d_rep[bag] + d_t @ w["V"].T + d_u @ w["U"].T
        d_pre = d_z * (pre > 0)
        return {"c": rep.T @ out, "d": np.array([out.sum()]), "w": (t * u).T @ d_e, "V": z.T @ d_t, "U": z.T @ d_u, "W": x.T @ d_pre, "b": d_pre.sum(axis=0)}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAIN_DOCS) -> Model:
    """Fit on at most `most` labelled documents; `labels` holds only rows that may be learned from. Labels of one document that differ count as their mean."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    picked = known.groupBy(F.col(id_col).alias("__id")).agg(F.avg(F.col(label_col).cast("double")).alias("__y")).orderBy(F.xxhash64(F.lit("fit"), F.col("__id")), "__id").limit(most)
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                x, first = encode(part.column("text"))
                bags = [x[np.unique(np.linspace(a, b - 1, min(b - a, TRAIN_PASSAGES)).astype(np.int64))].tobytes() for a, b in zip(first.tolist(), first[1:].tolist(), strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__y"), pa.array(bags, pa.binary())], names=["id", "y", "x"])

    got = sorted(rows.select("__id", "__y", "text").mapInArrow(tidy(run), "id long, y double, x binary").collect(), key=lambda r: (r.id, bytes(r.x)))
    y = np.asarray([r.y for r in got])
    if len(set(y)) < 2:
        return Model(float(y.mean()) if len(y) else 0.5)
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in got]
    first = np.concatenate([[0], np.cumsum([len(b) for b in bags])])
    return Model(float(y.mean())).fit(np.concatenate(bags), first, y)


def score(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """Add the score (0 to 1) of every whole text."""

    @F.arrow_udf(T.DoubleType())
    def of(texts: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        out = [model.score(*encode(texts.slice(a, b - a))) for a, b in steps(pc.binary_length(texts).to_numpy(zero_copy_only=False))]
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return df.withColumn(out_col, of(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
