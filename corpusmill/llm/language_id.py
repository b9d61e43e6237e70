"""Language ID: a linear-chain conditional random field labels every word of a text with a language.

Words are runs of ASCII letters and non-ASCII bytes of the lower-cased text. A word's features are its affixes (first and last one to four
bytes), its n-grams (all pairs and triples of bytes, the word's edges included) and its entry in a lexicon (words seen
twice in the sample); a feature has a weight for each language, and so has every pair of neighbouring labels, so a text that switches languages
is labelled piece by piece. Forward-backward over the whole text gives each word's label probabilities. It runs for all words of a batch at once: the chain is cut
into blocks, each block's product of transition matrices is built beside the others', and what enters a block follows from the products before it.
The first word of a text takes no transition, so texts do not touch.

The weights are fitted by Adam on the likelihood of labelled words: windows of at most WINDOW characters, at a hashed
place, of at most TRAIN_DOCS documents a language in the order of a hash of their ids. Windows of different documents are chained, so that transitions are learned from switches
as well. Only these windows and the weights pass through the driver; labelling runs on the executors over whole texts, without a shuffle.

A text's language is that with the greatest mean probability over its words, its score that mean.

Defined results: `und` with score 0 for a null text, one without a letter, and where nothing was learned; of equal languages the first by code point; null texts,
languages and ids are not learned from, repeated rows are labelled each; `lang_pred`, `score` and `spans` replace columns of these
names, all others pass through; an empty table gives an empty table. A step works on STEP bytes of text; one longer text is a step
of its own and takes about 150 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.bpe import slices
from corpusmill.llm.textbatch import buffers, mix, tidy

#: Most documents of a language that are learned from, and characters of each.
TRAIN_DOCS, WINDOW = 500, 400
BITS = 16
UNKNOWN = "und"
AFFIXES = (1, 2, 3, 4)
#: Words of a block of the chain, and bytes of text that one step labels.
BLOCK, STEP = 128, 1 << 18
#: Words after which weights are scaled.
SCALE = 8
ADDED = ("lang_pred", "score", "spans")

_LETTERS = np.full(256, 0x20, np.uint8)
_LETTERS[0x80:] = np.arange(0x80, 256)
_LETTERS[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)


@dataclass
class Encoded:
    """Features of the words of consecutive texts: places in the tables of weights, by kind."""

    start: np.ndarray  # first byte of each word in the texts' buffer, and the byte after its last
    end: np.ndarray
    first_word: np.ndarray  # of each text
    entry: np.ndarray  # hash of each word
    pairs: np.ndarray  # one a byte of a word: the byte and the one before it
    triples: np.ndarray  # one a byte of a word: the byte and its neighbours, hashed
    affixes: list[np.ndarray]  # one a word, hashed; 0 where the word is too short
    first_byte: np.ndarray  # of each word, in pairs and triples


def encode(texts: pa.Array) -> Encoded:
    """Words and features of a null-free string array."""
    raw, off = buffers(pc.utf8_lower(texts))
    raw = _LETTERS[raw]
    letter = raw != 0x20
    inside = np.flatnonzero(letter)
    # Words end at texts' ends, though texts touch in the buffer.
    touch = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(raw))]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = letter[:-1], letter[1:]
    before[touch], after[touch - 1] = False, False
    start, end = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    size = end - start
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    # Each byte with its left and right neighbour; a space is the word's edge.
    here = raw.astype(np.uint32)
    left, right = np.full_like(here, 0x20), np.full_like(here, 0x20)
    left[1:], right[:-1] = here[:-1], here[1:]
    left[touch], right[touch - 1] = 0x20, 0x20
    left <<= np.uint32(8)
    left |= here
    pairs = left[inside]
    triples = pairs << np.uint32(8)
    triples |= right[inside]
    # Eight bytes from each word's start, and eight up to its end.
    wide = np.concatenate([np.zeros(8, np.uint8), raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(wide) - 7,), dtype="<u8", buffer=wide.tobytes(), strides=(1,))
    head, tail = eight[start + 8], eight[end]
    affixes = []
    for k in AFFIXES:
        long = size >= k
        cut, drop = np.uint64((1 << (8 * k)) - 1), np.uint64(64 - 8 * k)
        for kind, value in ((2 * k, head & cut), (2 * k + 1, tail >> drop)):
            affixes.append(_bucket(value.astype(np.uint32), kind) * long)
    # Eight bytes at either end and the length stand for a whole word.
    short = np.uint64(8) * np.uint64(8) - np.uint64(8) * np.minimum(size, 8).astype(np.uint64)
    entry = mix(mix((head << short) + size.astype(np.uint64)) ^ (tail >> short))
    return Encoded(start, end, np.searchsorted(start, off), entry, pairs.astype(np.int64), _bucket(triples, 1), affixes, first)


def _bucket(value: np.ndarray, kind: int) -> np.ndarray:
    """Place in a table of weights, from 1: a multiplicative hash of the value and the kind of feature."""
    h = value ^ np.uint32(kind * 0x9E3779B1 & 0xFFFFFFFF)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - BITS)
    h |= np.uint32(1)
    return h.astype(np.int64)


def forward_backward(emission: np.ndarray, transition: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward weights of every word, each up to a factor, for potentials that are not logarithms.

    emission: (words, k); transition: (k, k); first: whether a word is the first of its text. Weights are scaled to sum 1 every few words, which
    takes potentials of exp(-50) to exp(5).
    """
    n, k = emission.shape
    blocks = -(-n // BLOCK)
    e, new = np.ones((blocks * BLOCK, k)), np.ones(blocks * BLOCK, bool)
    e[:n], new[:n] = emission, first
    e = np.ascontiguousarray(e.reshape(blocks, BLOCK, k).transpose(1, 0, 2))
    new = [np.flatnonzero(column) for column in new.reshape(blocks, BLOCK).T]
    # Products of all matrices of a block.
    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(BLOCK):
        step = (product.reshape(-1, k) @ transition).reshape(blocks, k, k)
        if len(new[t]):
            step[new[t]] = product[new[t]].sum(axis=2, keepdims=True)
        step *= e[t][:, None, :]
        if t % SCALE == SCALE - 1:
            step /= step.sum(axis=(1, 2), keepdims=True)
        product = step
    enter, leave = np.empty((blocks, k)), np.empty((blocks, k))
    v = np.full(k, 1 / k)
    for b in range(blocks):
        enter[b] = v
        v = v @ product[b]
        v = v / v.sum()
    v = np.full(k, 1 / k)
    for b in range(blocks - 1, -1, -1):
        leave[b] = v
        v = product[b] @ v
        v = v / v.sum()
    alpha, beta = np.empty_like(e), np.empty_like(e)
    v = enter
    for t in range(BLOCK):
        v = v @ transition
        v[new[t]] = 1.0  # a first word's weights depend on its emission alone
        v *= e[t]
        if t % SCALE == SCALE - 1:
            v /= v.sum(axis=1, keepdims=True)
        alpha[t] = v
    v, back = leave, np.ascontiguousarray(transition.T)
    for t in range(BLOCK - 1, -1, -1):
        beta[t] = v
        v = (v * e[t]) @ back
        v[new[t]] = 1.0
        if t % SCALE == 0:
            v /= v.sum(axis=1, keepdims=True)
    return alpha.transpose(1, 0, 2).reshape(-1, k)[:n], beta.transpose(1, 0, 2).reshape(-1, k)[:n]


class Model:
    """Weights of features and transitions for the learned languages."""

    def __init__(self, languages: list[str]) -> None:
        self.languages = sorted(languages)
        k = len(self.languages)
        # Weights by language, so that a lookup reads one short array.
        self.grams, self.hashed = np.zeros((k, 1 << 16), np.float32), np.zeros((k, 1 << BITS), np.float32)
        self.lexicon = np.zeros(0, np.uint64)  # sorted hashes of words; place 0 of their weights is for all others
        self.lexical = np.zeros((k, 1), np.float32)
        self.transition = np.zeros((k, k))

    def entries(self, x: Encoded) -> np.ndarray:
        at = np.searchsorted(self.lexicon, x.entry)
        hit = at < len(self.lexicon)
        hit[hit] = self.lexicon[at[hit]] == x.entry[hit]
        return np.where(hit, at + 1, 0)

    def emissions(self, x: Encoded) -> np.ndarray:
        """Sums of the weights of each word's features, (words, k). N-grams count by their mean, so that long words weigh no more than short ones."""
        out = np.empty((len(self.languages), len(x.start)), np.float32)
        share = GRAM_WEIGHT / (x.end - x.start).astype(np.float32)
        entry = self.entries(x)
        for c, (grams, hashed, lexical) in enumerate(zip(self.grams, self.hashed, self.lexical, strict=True)):
            of_bytes = grams[x.pairs]
            of_bytes += hashed[x.triples]
            out[c] = np.add.reduceat(of_bytes, x.first_byte) * share + lexical[entry]
            for places in x.affixes:
                out[c] += hashed[places]
        return out.T

    def probabilities(self, x: Encoded) -> np.ndarray:
        """Label probabilities of every word, (words, k)."""
        if not len(x.start) or not self.languages:
            return np.zeros((len(x.start), len(self.languages)))
        score = self.emissions(x).astype(np.float64)
        score -= score.max(axis=1, keepdims=True)
        alpha, beta = forward_backward(np.exp(np.maximum(score, -50)), np.exp(self.transition), _firsts(x.first_word))
        out = alpha * beta
        return out / out.sum(axis=1, keepdims=True)

    def fit(self, x: Encoded, label: np.ndarray, first: np.ndarray, rounds: int = 25, rate: float = 0.08, decay: float = 1e-5) -> Model:
        """Adam on the likelihood of the labelled words, all of them in every round. `first`: words that begin a chain."""
        k, n = len(self.languages), len(label)
        seen, times = np.unique(x.entry, return_counts=True)
        self.lexicon = seen[times > 1]
        self.lexical = np.zeros((k, len(self.lexicon) + 1), np.float32)
        entry = self.entries(x)
        truth = np.zeros((n, k))
        truth[np.arange(n), label] = 1
        size = x.end - x.start
        word_of, share = np.repeat(np.arange(n), size), np.repeat(GRAM_WEIGHT / size, size)
        inner = ~first[1:]
        pairs = np.bincount(label[:-1][inner] * k + label[1:][inner], minlength=k * k).reshape(k, k)
        weights = (self.grams, self.hashed, self.lexical, self.transition)
        moments = [(np.zeros(w.shape), np.zeros(w.shape)) for w in weights]
        for step in range(1, rounds + 1):
            score = self.emissions(x).astype(np.float64)
            score -= score.max(axis=1, keepdims=True)
            e, t = np.exp(np.maximum(score, -50)), np.exp(self.transition)
            alpha, beta = forward_backward(e, t, first)
            p = alpha * beta
            p /= p.sum(axis=1, keepdims=True)
            error = (p - truth) / n
            both = (alpha[:-1, :, None] * t * (e[1:] * beta[1:])[:, None, :])[inner]
            both /= both.sum(axis=(1, 2), keepdims=True)
            gradients = tuple(np.zeros(w.shape) for w in weights[:3]) + ((both.sum(axis=0) - pairs) / n,)
            for c in range(k):
                spread = error[word_of, c] * share
                gradients[0][c] = np.bincount(x.pairs, spread, self.grams.shape[1])
                gradients[1][c] = np.bincount(x.triples, spread, self.hashed.shape[1])
                for places in x.affixes:
                    gradients[1][c] += np.bincount(places, error[:, c], self.hashed.shape[1])
                gradients[2][c] = np.bincount(entry, error[:, c], self.lexical.shape[1])
            gradients[1][:, 0] = gradients[2][:, 0] = 0  # places of what is no feature
            for w, gradient, (m, v) in zip(weights, gradients, moments, strict=True):
                gradient += decay * w
                m *= 0.9
                m += 0.1 * gradient
                v *= 0.999
                v += 0.001 * gradient**2
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


#: How many features a word's n-grams of one length count as together.
GRAM_WEIGHT = 3.0


def _firsts(first_word: np.ndarray) -> np.ndarray:
    out = np.zeros(first_word[-1], bool)
    out[first_word[:-1][np.diff(first_word) > 0]] = True
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = TRAIN_DOCS) -> Model:
    """Fit on windows of at most `most` documents a language; `docs` holds only rows that may be learned from."""
    place = lambda salt: F.xxhash64(F.lit(salt), F.col("id"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("id IS NOT NULL AND lang IS NOT NULL")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row a language
    if not counts:
        return Model([])
    # A share of each language's documents by hash, twice what is wanted, so that texts of few are looked at; then exactly `most` of them.
    share = F.element_at(F.create_map(*[F.lit(v) for lang, n in counts.items() for v in (lang, min(1.0, 2 * most / n))]), F.col("lang"))
    picked = rows.where((F.pmod(place("fit"), F.lit(1 << 20)) <= share * (1 << 20)) & has_letter(F.col("text")))
    start = F.pmod(place("window"), F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1).cast("int") + 1
    got = picked.select("lang", place("fit").alias("at"), "id", F.substr("text", start, F.lit(WINDOW)).alias("text"), (start > 1).alias("cut_head"), (F.char_length("text") - start >= WINDOW).alias("cut_tail")).collect()
    taken: dict[str, int] = {}
    windows: list[tuple[int, int, str]] = []
    languages = sorted(counts)
    for r in sorted(got, key=lambda r: (r.at, r.id, r.lang, r.text)):
        text = r.text
        if r.cut_head:
            text = text.partition(" ")[2] or text
        if r.cut_tail:
            text = text.rpartition(" ")[0] or text
        if taken.setdefault(r.lang, 0) < most:
            taken[r.lang] += 1
            windows.append((r.at, languages.index(r.lang), text))
    model = Model(languages)
    x = encode(pa.array([t for _, _, t in windows], pa.string()))
    count = np.diff(x.first_word)
    label = np.repeat([lang for _, lang, _ in windows], count)
    # Windows in the order of a hash; every third begins a chain, the others go on from the one before.
    begins = np.arange(len(windows)) % 3 == 0
    first = np.zeros(len(label), bool)
    first[x.first_word[:-1][begins & (count > 0)]] = True
    if len(label):
        first[0] = True
    if len(languages) < 2 or not len(label):
        return model
    return model.fit(x, label, first)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def label(df: DataFrame, model: Model, text_col: str = "text", spans: bool = True) -> DataFrame:
    """Add lang_pred and score of every whole text and, where asked, spans: the longest stretches of words with one most probable language (lang, first word, words, and the bytes they reach over)."""
    added = ADDED if spans else ADDED[:2]
    keep = [c for c in df.columns if c not in added]
    # Carried columns lie in a struct, so that none of them can clash with ours.
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    text = F.col(f"`{text_col}`")
    src = df.select(row.alias("row"), F.coalesce(text, F.lit("")).alias("text"), has_letter(text).alias("letter"))
    span = T.StructType([T.StructField("lang", T.StringType()), *[T.StructField(c, T.LongType()) for c in ("first", "words", "start", "stop")]])
    kinds = [T.StringType(), T.DoubleType(), T.ArrayType(span)]
    schema = T.StructType([src.schema["row"], *[T.StructField(c, t) for c, t in zip(added, kinds, strict=False)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", STEP):
                x = encode(part.column("text"))
                p = model.probabilities(x)
                names, scores = _of_texts(model, p, x.first_word, part.column("letter").to_numpy(zero_copy_only=False))
                made = [pa.array(names, pa.string()), pa.array(scores)]
                if spans:
                    made.append(_spans(model, p, x, part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("row"), *made], names=["row", *added])

    out = src.mapInArrow(tidy(run), schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], *added)


def _of_texts(model: Model, p: np.ndarray, first_word: np.ndarray, letter: np.ndarray) -> tuple[list[str], np.ndarray]:
    count = np.diff(first_word)
    n, k = len(count), len(model.languages)
    if not k:
        return [UNKNOWN] * n, np.zeros(n)
    share = np.zeros((n, k))
    some = count > 0
    if some.any():
        share[some] = np.add.reduceat(p, first_word[:-1][some], axis=0) / count[some, None]
    best = share.argmax(axis=1)
    score = np.minimum(share[np.arange(n), best], 1.0)
    known = letter & some
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), known.tolist(), strict=True)], np.where(known, score, 0.0)


def _spans(model: Model, p: np.ndarray, x: Encoded, texts: pa.Array) -> pa.Array:
    """Places are words and bytes of the lower-cased text."""
    if not len(p) or not model.languages:
        return pa.array([[] for _ in range(len(texts))], pa.list_(pa.struct([("lang", pa.string()), *[(c, pa.int64()) for c in ("first", "words", "start", "stop")]])))
    best = p.argmax(axis=1)
    head = _firsts(x.first_word)
    head[1:] |= best[1:] != best[:-1]
    at = np.flatnonzero(head)
    end = np.append(at[1:], len(best))
    doc = np.searchsorted(x.first_word, at, side="right") - 1
    _, off = buffers(pc.utf8_lower(texts))
    fields = [pa.array([model.languages[b] for b in best[at].tolist()], pa.string()), pa.array(at - x.first_word[doc]), pa.array(end - at), pa.array(x.start[at] - off[doc]), pa.array(x.end[end - 1] - off[doc])]
    rows = pa.StructArray.from_arrays(fields, names=["lang", "first", "words", "start", "stop"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)), rows)
