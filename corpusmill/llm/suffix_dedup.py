"""Exact removal of repeated byte strings by ranks of the prefixes of suffixes.

Every byte covered by a string of `length` bytes that also starts anywhere else (in another
document or at another place of the same one) goes. Naming every byte position would sort the corpus
many times over, so ranks are made for a sample of positions that the text itself
chooses, and positions between are settled from it exactly:

1. An anchor is a position whose next 16 bytes hash under a bound (one in GAP). Equal strings have equal
   anchors. Anchors (and the ends of the text) cut a text into phrases, named by their bytes and the 16 that follow.
2. Ranks in two rounds: first of phrases, then of runs of phrases that stand twice each, just long enough to hold a window.
   Spark brings equal names together, gives each repeated one a rank (the least position that has it) and drops
   positions whose name is unique. A run is named by 128 bits of hash of its phrases' names.
3. A window of `length` bytes inside a run with a rank over the threshold is repeated. A window
   whose inner anchors span a phrase without a rank is unique. What remains are windows near the
   ends of repeated stretches. Those, and one representative of each rank that could equal them, are settled eight
   at a time: windows that start at most seven bytes before a place aligned to their first anchor share an
   inner string (unique: so are all eight) and lie in an outer one (repeated: so are all eight).
   Only starts between the two are compared one by one, by two 64-bit rolling hashes of all their bytes.
   Windows with one anchor always take part; those without any (periodic or odd text) are compared one by one.
5. If asked for, passages of `words` words go as well, however few bytes they have: each string from the first byte of a word to the last byte of the
   word `words` - 1 further that also stands anywhere else, between white space or ends of texts. It has no phrase (with the bytes that name it) without a
   rank, so only stretches between two such phrases are looked at. What lies in a run with a rank is repeated; all else is compared by two 64-bit hashes,
   with those strings of runs' representatives whose phrases stand at three places or more, as one outside of runs is a third.

Equal whole texts are one text throughout (with its number of copies), so the largest groups of
copies cost one copy. Ranks met by very many positions pass through aggregations with partial results and joins
that deal their rows to blocks. Every step is a table in the shared folder.

Defined results: null text is empty, has no bytes and loses none; texts under `length` bytes (and under `words` words, where these are given) lose none; rows repeated in
whole count as copies, and go whole where they are long enough; other columns pass through; an empty table gives an empty table.
Names are hashes: 64 bits for a phrase, where an error needs equal neighbours too (or two phrases of `length`
bytes, which are rare), 127 bits for the groups of eight and 128 bits for windows and texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.bpe import slices
from corpusmill.llm.hot_keys import dealt_join, sampled
from corpusmill.llm.textbatch import buffers, mix, steps, tidy, word_ends, word_starts
from corpusmill.session import discard, sized_join, written

#: Mean distance of anchors.
GAP = 48
_CONTEXT = 16
_ROLL = np.random.default_rng(20240229).integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: Positions whose windows are hashed in one numpy step.
_STEP = 1 << 17


def anchors(data: np.ndarray) -> np.ndarray:
    """Positions whose next 16 bytes hash under the bound."""
    found = [np.zeros(0, np.int64)]
    for a in range(0, len(data) - _CONTEXT + 1, _STEP):
        raw = data[a : a + _STEP + _CONTEXT - 1].tobytes()
        eight = np.ndarray((len(raw) - 7,), dtype="<u8", buffer=raw, strides=(1,)) * np.uint64(_BASES[0])
        both = (eight[:-8] ^ (eight[8:] >> np.uint64(29))) * np.uint64(_BASES[1])
        found.append(np.flatnonzero(both >> np.uint64(32) < np.uint64((1 << 32) // GAP)) + a)
    return np.concatenate(found)


_KEYS = ("k1", "k2")


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The table with the text as __text (never null) and its 128-bit key."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return df.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))).alias("id"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))


def phrases(src: DataFrame, length: int, words: int | None = None) -> DataFrame:
    """Per row of a long enough text: n, index of the first true anchor, phrase starts, phrase names; before: words that start up to each phrase's first byte and in all (empty without `words`)."""
    least = length if words is None else min(length, 2 * words - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, off = buffers(part.column("text"))
                at = anchors(raw)
                of = np.searchsorted(off, at, "right") - 1
                inside = at + _CONTEXT <= off[of + 1]
                at, of = at[inside], of[inside]
                first = np.ones(len(part), np.int32)
                first[of[at == off[of]]] = 0
                starts = np.sort(np.concatenate([off[:-1][first == 1], at]))
                of = np.searchsorted(off, starts, "right") - 1
                ends = np.minimum(np.append(starts[1:], off[-1]) + _CONTEXT, off[of + 1])
                body = raw.tobytes()
                names = np.fromiter((xxhash.xxh3_64_intdigest(body[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
                cut = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(part)))])
                cut_w, before = np.zeros(len(cut), np.int64), np.zeros(0, np.int32)
                if words:
                    first_byte = word_starts(raw, off)
                    base = np.searchsorted(first_byte, off)
                    before = np.empty(len(starts) + len(part), np.int32)
                    before[np.arange(len(starts)) + of] = np.searchsorted(first_byte, starts, "right") - base[of]
                    before[cut[1:] + np.arange(len(part))] = np.diff(base)
                    cut_w = cut + np.arange(len(cut))
                cut, cut_w = (pa.array(x.astype(np.int32)) for x in (cut, cut_w))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("id", *_KEYS)), pa.array(np.diff(off).astype(np.int32)), pa.array(first), pa.ListArray.from_arrays(cut, pa.array((starts - off[of]).astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(names.view(np.int64))), pa.ListArray.from_arrays(cut_w, pa.array(before))],
                    names=["id", *_KEYS, "n", "first", "starts", "names", "before"],
                )

    return src.where(F.octet_length("text") >= least).mapInArrow(tidy(run), "id long, k1 long, k2 long, n int, first int, starts array<int>, names array<bigint>, before array<int>")


def rerank(rows: DataFrame, by: list[str], label: str) -> DataFrame:
    """Rows whose `by` values occur at two positions or more, with their common rank r: the least position; many: at three or more; written.

    Values met in very many texts are dealt by position, so that no task gets all rows of a common passage.
    """
    pos = F.xxhash64(*_KEYS, "j")
    named = rows.groupBy(*by).agg(F.min(pos).alias("r"), F.max(pos).alias("last"), (F.count("*") > 2).alias("many")).where("r < last").drop("last")
    large = sampled(rows, by, F.col("k1"))
    out = written(dealt_join(rows, named, by, "inner", large, pos, alike=True).select(*_KEYS, "j", "e", "r", "many"), label)
    discard(large)
    return out


class Phrases:
    """The phrases of a batch's texts in one sequence, in which each text ends with an entry for its end.

    at: place in the batch's bytes, where texts lie apart; of: the text; word: words of the batch that start up to there.
    """

    def __init__(self, batch: pa.RecordBatch) -> None:
        starts, before = batch.column("starts"), batch.column("before")
        self.n = batch.column("n").to_numpy().astype(np.int64)
        count = pc.list_value_length(starts).to_numpy().astype(np.int64)
        self.texts = np.arange(len(batch))
        self.head = np.concatenate([[0], np.cumsum(count + 1)])
        self.base = np.concatenate([[0], np.cumsum(self.n + 1)])
        self.of = np.repeat(self.texts, count + 1)
        self.end = self.head[1:] - 1
        self.inner = np.ones(len(self.of), bool)
        self.inner[self.end] = False
        self.place = np.empty(len(self.of), np.int64)
        self.place[self.inner] = starts.flatten().to_numpy()
        self.place[self.end] = self.n
        self.at = self.place + self.base[self.of]
        self.first = batch.column("first").to_numpy().astype(np.int64)
        self.before = before.flatten().to_numpy().astype(np.int64)
        self.words = self.before[self.end] if len(self.before) else np.zeros(len(batch), np.int64)
        if len(self.before):
            self.word = self.before + np.concatenate([[0], np.cumsum(self.words + 1)])[self.of]

    def spread(self, values: np.ndarray) -> np.ndarray:
        """Values of the phrases, and 0 at ends of texts."""
        out = np.zeros(len(self.of), values.dtype)
        out[self.inner] = values
        return out


def _list_of(counts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), values)


def marked(texts: DataFrame, ranks: DataFrame, length: int, words: int | None) -> DataFrame:
    """Per text: times (0: the phrase stands once; 2: at three places or more), names (0 where it stands once), and runs of phrases j..e-1 that stand twice each, with two hashes of their names.

    From every phrase start the runs that hold its windows: those from `length` bytes up to where every window that starts in the phrase lies inside, and the one that holds
    every string of `words` words that starts in it. Both follow from the run's own bytes, so equal runs are taken everywhere. Each phrase ends two runs' ranges on average.
    """
    per_text = ranks.groupBy(*_KEYS).agg(F.collect_list(F.shiftleft(F.col("j").cast("long"), 1).bitwiseOR(F.col("many").cast("long"))).alias("ranks"))
    rows = texts.join(per_text, list(_KEYS), "left")
    roller = Roller()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _nested(whole, "starts", "ranks")):
            if not len(batch):
                continue
            seq, ranked = Phrases(batch), batch.column("ranks")
            entries = ranked.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            of = np.repeat(seq.texts, pc.fill_null(pc.list_value_length(ranked), 0).to_numpy())
            times = np.zeros(len(seq.of), np.int8)
            times[seq.head[of] + (entries >> 1)] = 1 + (entries & 1)
            names = np.where(times > 0, seq.spread(batch.column("names").flatten().to_numpy().view(np.uint64)), np.uint64(0))
            rare, j = np.flatnonzero(times == 0), np.flatnonzero(times)
            most = rare[np.searchsorted(rare, j)]
            near = np.searchsorted(seq.at, seq.at[j] + length)
            far = np.searchsorted(seq.at, seq.at[j + 1] - 1 + length)
            count = np.maximum(np.minimum(far, most) - near + 1, 0)
            b = np.repeat(j, count)
            e = np.repeat(near, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            if words is not None:
                ends = np.searchsorted(seq.word, seq.word[j + 1] + words)
                own = (ends <= most) & ((ends < near) | (ends > far))
                b, e = np.concatenate([b, j[own]]), np.concatenate([e, ends[own]])
                order = np.argsort(b, kind="stable")
                b, e = b[order], e[order]
            h1, h2 = roller.runs(names, b, e)
            head = seq.head[seq.of[b]]
            counts, inner = np.bincount(seq.of[b], minlength=len(batch)), np.diff(seq.head) - 1
            lists = [_list_of(inner, pa.array(times[seq.inner])), _list_of(inner, pa.array(names[seq.inner].view(np.int64))), *(_list_of(counts, pa.array(x)) for x in ((b - head).astype(np.int32), (e - head).astype(np.int32), h1.view(np.int64), h2.view(np.int64)))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *lists], names=[*kept, "times", "names", "j", "e", "h1", "h2"])

    kept = ["id", "copies", *_KEYS, "n", "first", "starts", "before"]
    return rows.select(*kept, "names", "ranks").mapInArrow(tidy(run), "id long, copies long, k1 long, k2 long, n int, first int, starts array<int>, before array<int>, times array<tinyint>, names array<bigint>, j array<int>, e array<int>, h1 array<bigint>, h2 array<bigint>")


def ranked_runs(texts: DataFrame, length: int, words: int | None = None) -> tuple[DataFrame, DataFrame]:
    """`marked` texts, and the repeated ones of their runs with their ranks; both written."""
    start = texts.select(*_KEYS, F.posexplode("names").alias("j", "name")).withColumn("e", F.col("j") + 1)
    single_ranks = rerank(start, ["name"], "ranks")
    found = written(marked(texts, single_ranks, length, words), "marked")
    runs = found.select(*_KEYS, F.explode(F.arrays_zip("j", "e", "h1", "h2")).alias("x")).select(*_KEYS, "x.*")
    ranks = rerank(runs, ["h1", "h2"], "run-ranks")
    discard(single_ranks)
    return found, ranks


def _runs(seq: Phrases, times: np.ndarray, hashed, long: tuple[np.ndarray, np.ndarray, np.ndarray], length: int):
    """Window starts of a batch's texts, in intervals with the same anchors: (sure: text, lo, hi), (to compare: text, lo, hi, open, key, first anchor).

    long: phrases j, e and rep of the repeated runs. hashed: names the phrases from j to e.
    """
    last = seq.n - length
    true = np.flatnonzero(seq.inner & (np.arange(len(seq.of)) - seq.head[seq.of] >= seq.first[seq.of]))
    anchor, of = seq.at[true], seq.of[true]
    fits = np.flatnonzero(last >= 0)
    cuts = [seq.base[fits]]
    for place, t in ((anchor, of), (anchor + 1, of), (anchor - (length - _CONTEXT), of), (seq.at - (length - 1), seq.of)):
        own = place - seq.base[t]
        cuts.append(place[(own >= 0) & (own <= last[t])])
    lo = np.unique(np.concatenate(cuts))
    t = np.searchsorted(seq.base, lo, "right") - 1
    hi = np.minimum(np.append(lo[1:] - 1, np.iinfo(np.int64).max), seq.base[t] + last[t])
    i1 = np.searchsorted(anchor, lo)
    n_phr = np.searchsorted(anchor, lo + (length - _CONTEXT), "right") - 1 - i1
    some = n_phr >= 1
    q = np.concatenate([true, [0]])[i1]
    known = np.concatenate([[0], np.cumsum(times > 0)])
    ahead = np.where(some, q + n_phr, q)
    ranked = some & (known[ahead] - known[q] == n_phr)
    key = np.zeros(len(lo), np.uint64)
    key[ranked] = hashed(q[ranked], ahead[ranked])[0] | np.uint64(1)
    j, e, is_rep = long
    a, b = seq.at[j], seq.at[e]
    wide = b - a >= length
    cover = []
    for pick in (wide, wide & is_rep):
        x, y = np.searchsorted(lo, a[pick]), np.searchsorted(lo, b[pick] - length, "right")
        cover.append(np.cumsum(np.bincount(x, minlength=len(lo) + 1) - np.bincount(y, minlength=len(lo) + 1))[:-1] > 0)
    sure, by_rep = cover
    compare = (ranked | ~some) & (~sure | by_rep)
    p = np.where(n_phr >= 0, seq.place[q], -1)
    # Neighbouring sure intervals are one.
    s = np.flatnonzero(sure)
    new = np.ones(len(s), bool)
    new[1:] = (lo[s[1:]] != hi[s[:-1]] + 1) | (t[s[1:]] != t[s[:-1]])
    heads, tails = s[new], s[np.append(new[1:], True)] if len(s) else s
    base = seq.base[t]
    return (t[heads], (lo - base)[heads], (hi - base)[tails]), (t[compare], (lo - base)[compare], (hi - base)[compare], ~sure[compare], key[compare], p[compare])


#: Kinds of byte ranges that a search of passages gets: stretches without a phrase that stands once (twice at most), and runs with a rank that are (not) its representative.
_LOOK, _COMMON, _COPY, _REP = range(4)


def _stretches(seq: Phrases, times: np.ndarray, long: tuple[np.ndarray, np.ndarray, np.ndarray], words: int):
    """Byte ranges of a batch's texts (text, lo, hi, kind) that can hold `words` words."""
    enough = seq.words >= words
    # The first phrase may start, and the last one ends, where other texts have no anchor.
    inner = seq.inner & (np.arange(len(seq.of)) - seq.head[seq.of] >= seq.first[seq.of])
    inner[seq.end - 1] = False
    out, looked = [], enough
    for kind in (_LOOK, _COMMON):
        at = np.flatnonzero(inner & (times <= kind) & looked[seq.of])
        of = seq.of[at]
        texts = np.flatnonzero(looked)
        # Of every text a stretch before its first rare phrase and one after each.
        t, lo, low = (np.concatenate(x) for x in zip((texts, np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)), (of, seq.place[at] + 1, seq.before[at]), strict=True))
        u, hi, high = (np.concatenate(x) for x in zip((of, np.minimum(seq.place[at + 1] + _CONTEXT - 1, seq.n[of]), seq.before[at + 1] + _CONTEXT // 2), (texts, seq.n[texts], seq.words[texts]), strict=True))
        front, back = np.argsort(t, kind="stable"), np.argsort(u, kind="stable")
        t, lo, hi = t[front], lo[front], hi[back]
        # A word starts at most at every other byte of the context.
        most = high[back] - low[front] >= words
        out.append((t[most], lo[most], hi[most], np.full(most.sum(), kind)))
        if kind == _LOOK:
            looked = np.zeros(len(enough), bool)
            looked[t[most]] = True
    j, e, is_rep = long
    some = looked[seq.of[j]] & (seq.before[e] - seq.before[j] >= words) if len(j) else np.zeros(0, bool)
    for kind in (_COPY, _REP):
        pick = some & (is_rep == (kind == _REP))
        a, b = seq.at[j[pick]], seq.at[e[pick]]
        t = seq.of[j[pick]]
        # Of runs that lie in another one, the other suffices.
        order = np.lexsort((-b, a))
        t, a, b = t[order], a[order], b[order]
        outer = np.ones(len(a), bool)
        outer[1:] = b[1:] > np.maximum.accumulate(b)[:-1]
        t = t[outer]
        out.append((t, a[outer] - seq.base[t], b[outer] - seq.base[t], np.full(len(t), kind)))
    t, lo, hi, kind = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(t, kind="stable")
    return t[order], lo[order], hi[order], kind[order]


#: Entries of nested lists that one numpy step works on.
_ENTRIES = 1 << 17


def _nested(batch: pa.RecordBatch, *cols: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose list columns hold about _ENTRIES entries each."""
    size = sum(pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy().astype(np.int64) for c in cols)
    for a, b in steps(size, _ENTRIES):
        yield batch.slice(a, b - a)


def settle(found: DataFrame, ranks: DataFrame, length: int, words: int | None = None) -> DataFrame:
    """Per text: intervals of window starts surely repeated (sure), and runs of starts to compare (runs); byte ranges for passages of `words` words (look) and whether there are so many (enough)."""
    rep = (F.col("r") == F.xxhash64(*_KEYS, "j")).cast("long")
    place = F.shiftleft(F.col("j").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("e").cast("long"), 1)).bitwiseOR(rep)
    per_text = ranks.groupBy(*_KEYS).agg(F.collect_list(place).alias("ranks"))
    rows = found.select("id", "copies", *_KEYS, "n", "first", "starts", "before", "times", "names").join(per_text, list(_KEYS), "left")
    roller = Roller()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _nested(whole, "starts", "ranks")):
            if not len(batch):
                continue
            seq, ranked = Phrases(batch), batch.column("ranks")
            times = seq.spread(batch.column("times").flatten().to_numpy())
            names = seq.spread(batch.column("names").flatten().to_numpy().view(np.uint64))
            entries = ranked.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            head = seq.head[np.repeat(seq.texts, pc.fill_null(pc.list_value_length(ranked), 0).to_numpy())]
            long = head + (entries >> 32), head + ((entries & 0xFFFFFFFF) >> 1), (entries & 1).astype(bool)
            sure, runs = _runs(seq, times, lambda j, e, names=names: roller.runs(names, j, e), long, length)
            enough = np.full(len(batch), words is not None) & (seq.words >= (words or 0))
            none = np.zeros(0, np.int64)
            look = _stretches(seq, times, long, words) if words is not None else (none,) * 4

            def lists(parts: tuple, kinds: list, names: list[str], size: int = len(batch)) -> pa.Array:
                cols = [pa.array(x.astype(k) if k is not np.int64 else x.view(np.int64)) for x, k in zip(parts[1:], kinds, strict=True)]
                return _list_of(np.bincount(parts[0], minlength=size), pa.StructArray.from_arrays(cols, names=names))

            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "copies", *_KEYS, "n")), lists(sure, [np.int32, np.int32], ["lo", "hi"]), lists(runs, [np.int32, np.int32, bool, np.int64, np.int32], ["lo", "hi", "open", "key", "p"]), lists(look, [np.int32] * 3, ["lo", "hi", "p"]), pa.array(enough)], names=["id", "copies", *_KEYS, "n", "sure", "runs", "look", "enough"])

    return rows.mapInArrow(tidy(run), "id long, copies long, k1 long, k2 long, n int, sure array<struct<lo:int,hi:int>>, runs array<struct<lo:int,hi:int,open:boolean,key:bigint,p:int>>, look array<struct<lo:int,hi:int,p:int>>, enough boolean")


class Roller:
    """Two rolling hashes of the windows of a byte range."""

    def __init__(self) -> None:
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in _BASES]

    def _grow(self, n: int) -> None:
        for i, base in enumerate(_BASES):
            if len(self.powers[i][0]) < n:
                size = max(n, 1 << 16)
                self.powers[i] = tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (base, pow(base, -1, 1 << 64)))

    def at(self, data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the strings of `length` bytes at sorted starts; neighbours are rolled over together."""
        h1, h2 = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        if not len(starts):
            return h1, h2
        heads = np.flatnonzero(np.concatenate([[True], np.diff(starts) > length]))
        tails = np.append(heads[1:], len(starts))
        for a, b in zip(heads.tolist(), tails.tolist(), strict=True):
            for c in range(int(starts[a]), int(starts[b - 1]) + 1, _STEP):
                d = min(c + _STEP, int(starts[b - 1]) + 1)
                x, y = np.searchsorted(starts[a:b], [c, d]) + a
                w1, w2 = self.windows(data, c, d - 1, length)
                h1[x:y], h2[x:y] = w1[starts[x:y] - c], w2[starts[x:y] - c]
        return h1, h2

    def windows(self, data: np.ndarray, lo: int, hi: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the strings of `length` bytes that start at lo..hi."""
        part = data[lo : hi + length]
        self._grow(len(part) + 1)
        out = []
        for (up, down), table in zip(self.powers, _ROLL, strict=True):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[part] * up[: len(part)], dtype=np.uint64)])
            out.append(mix((total[length:] - total[:-length]) * down[: hi - lo + 1]))
        return out[0], out[1]

    def runs(self, names: np.ndarray, j: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the names from j to e."""
        self._grow(len(names) + 1)
        out = []
        for up, down in self.powers:
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(names * up[: len(names)], dtype=np.uint64)])
            out.append(mix((total[e] - total[j]) * down[j] + (e - j).astype(np.uint64)))
        return out[0], out[1]

    def strings(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the strings from starts to stops, both sorted."""
        h1, h2 = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
        a = 0
        while a < len(starts):
            base = int(starts[a])
            b = int(np.searchsorted(starts, base + _STEP))
            part = data[base : int(stops[b - 1])]
            self._grow(len(part) + 1)
            x, y = starts[a:b] - base, stops[a:b] - base
            for out, (up, down), table in zip((h1, h2), self.powers, _ROLL, strict=True):
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[part] * up[: len(part)], dtype=np.uint64)])
                out[a:b] = mix(mix((total[y] - total[x]) * down[x]) + (y - x).astype(np.uint64))
            a = b
        return h1, h2


#: Starts that are settled together.
_GROUP = 8


def _per_text(src: DataFrame, wanted: DataFrame, wanted_bytes: int, fields: list[str], schema: str, of) -> DataFrame:
    """Run `of(data, *fields of the text's sorted runs)` over every wanted text; it gives one array a column of `schema` after k1 and k2."""
    rows = sized_join(src, wanted, ["id", *_KEYS], "inner", wanted_bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, off = buffers(part.column("text"))
                runs = part.column("runs")
                r_off = runs.offsets.to_numpy()
                where, what = runs.values.to_numpy(zero_copy_only=False), part.column("about").values.to_numpy(zero_copy_only=False)
                unpacked = {"lo": where >> 32, "hi": where & 0xFFFFFFFF, "open": (what & 1).astype(bool), "p": what >> 1}
                values = [unpacked[x] for x in fields]
                k1, k2 = part.column("k1").to_numpy(), part.column("k2").to_numpy()
                made = []
                for i in range(len(part)):
                    own = [v[r_off[i] : r_off[i + 1]] for v in values]
                    order = np.argsort(own[0], kind="stable")
                    cols = of(raw[off[i] : off[i + 1]], *[v[order] for v in own])
                    made.append((np.full(len(cols[0]), k1[i]), np.full(len(cols[0]), k2[i]), *cols))
                if made:
                    arrays = [np.concatenate(c) for c in zip(*made, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["k1", "k2", *(f.split()[0] for f in schema.split(", "))])

    return rows.select("k1", "k2", "text", "runs", "about").mapInArrow(tidy(run), f"k1 long, k2 long, {schema}")


def grouped(src: DataFrame, wanted: DataFrame, wanted_bytes: int, length: int) -> DataFrame:
    """Groups of _GROUP starts of the runs that have an anchor p: at (the last start), inner and outer hash, open (any start is)."""
    roller = Roller()

    def of(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, is_open: np.ndarray, p: np.ndarray):
        some = p >= 0
        lo, hi, is_open, p = lo[some].astype(np.int64), hi[some].astype(np.int64), is_open[some].astype(bool), p[some].astype(np.int64)
        near, far = (p - hi) // _GROUP, (p - lo) // _GROUP
        count = far - near + 1
        step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(p - _GROUP * near, count) - _GROUP * step
        places, back = np.unique(at, return_inverse=True)
        opened = np.zeros(len(places), bool)
        np.logical_or.at(opened, back, np.repeat(is_open, count))
        inner, _ = roller.at(data, places, length - _GROUP + 1)
        fits = (places >= _GROUP - 1) & (places + length <= len(data))
        outer = np.zeros(len(places), np.uint64)
        outer[fits] = roller.at(data, places[fits] - _GROUP + 1, length + _GROUP - 1)[1] | np.uint64(1)
        return places.astype(np.int32), inner.view(np.int64), outer.view(np.int64), opened

    return _per_text(src, wanted, wanted_bytes, ["lo", "hi", "open", "p"], "at int, inner long, outer long, open boolean", of)


def single(src: DataFrame, wanted: DataFrame, wanted_bytes: int, length: int) -> DataFrame:
    """Hashes of the windows that start in the runs: lo, hi, h1, h2, open. Rows with hashed = false are starts repeated in their own text."""
    roller = Roller()

    def of(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, is_open: np.ndarray):
        lo, hi = np.maximum(lo.astype(np.int64), 0), np.minimum(hi.astype(np.int64), len(data) - length)
        count = np.maximum(hi - lo + 1, 0)
        every = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts, back = np.unique(every, return_inverse=True)
        needed = np.zeros(len(starts), bool)
        np.logical_or.at(needed, back, np.repeat(is_open.astype(bool), count))
        h1, h2 = roller.at(data, starts, length)
        _, one, back, times = np.unique(h1 ^ mix(h2), return_index=True, return_inverse=True, return_counts=True)
        # Repeated inside the text: settled here; one of them still stands for the others elsewhere.
        s, e = _intervals(starts[needed & (times > 1)[back]])
        none = np.zeros(len(s), np.int64)
        return (
            np.concatenate([starts[one], s]).astype(np.int32), np.concatenate([starts[one], e]).astype(np.int32), np.concatenate([h1[one].view(np.int64), none]), np.concatenate([h2[one].view(np.int64), none]),
            np.concatenate([needed[one] & (times == 1), none.astype(bool)]), np.concatenate([np.ones(len(one), bool), none.astype(bool)]),
        )

    return _per_text(src, wanted, wanted_bytes, ["lo", "hi", "open"], "lo int, hi int, h1 long, h2 long, open boolean, hashed boolean", of)


def passages(src: DataFrame, wanted: DataFrame, wanted_bytes: int, words: int) -> DataFrame:
    """Strings of `words` words in the stretches to look at: lo, stop, h1, h2; without hashes (hashed = false) ranges of such as are surely repeated."""
    roller = Roller()

    def of(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind: np.ndarray):
        first, end = word_ends(data)
        i = np.searchsorted(first, lo[kind == _LOOK])
        count = np.maximum(np.searchsorted(end, hi[kind == _LOOK], "right") - words + 1 - i, 0)
        at = np.unique(np.repeat(i, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
        start, stop = first[at], end[at + words - 1]

        def within(of_kind: int, more: int) -> np.ndarray:
            """Strings in a range of a kind, with `more` bytes on both sides: in a run, the white space that makes their words whole."""
            a, b = lo[kind == of_kind], hi[kind == of_kind]
            reach = np.concatenate([[-1], np.maximum.accumulate(b)])
            return stop + more <= reach[np.searchsorted(a, start - more, "right")]

        in_rep = within(_REP, 1)
        sure = in_rep | within(_COPY, 1)
        # What lies in a run is repeated. Where it can equal a string outside of runs, which is then its third place, its run's representative answers.
        ask = ~sure | in_rep & within(_COMMON, 0)
        h1, h2 = roller.strings(data, start[ask], stop[ask])
        # Neighbours overlap, but for single words.
        s, e = _intervals(at[sure]) if words > 1 else (at[sure], at[sure])
        none = np.zeros(len(s), np.int64)
        return (
            np.concatenate([start[ask], first[s]]).astype(np.int32), np.concatenate([stop[ask], end[e + words - 1]]).astype(np.int32),
            np.concatenate([h1.view(np.int64), none]), np.concatenate([h2.view(np.int64), none]), np.concatenate([np.ones(len(h1), bool), none.astype(bool)]),
        )

    return _per_text(src, wanted, wanted_bytes, ["lo", "hi", "p"], "lo int, stop int, h1 long, h2 long, hashed boolean", of)


def _intervals(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of consecutive numbers in a sorted array."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.diff(at) > 1) + 1
    return at[np.concatenate([[0], new])], at[np.concatenate([new - 1, [len(at) - 1]])]


def repeated_starts(src: DataFrame, length: int, words: int | None = None) -> DataFrame:
    """Per distinct text with something to remove: k1, k2, whole and clean_whole (all of it goes by the bytes, by bytes and words), and the byte ranges that go by the bytes (spans) and by bytes and words (both)."""
    found = phrases(src, length, words)
    texts = written(found.groupBy(*_KEYS).agg(F.min("id").alias("id"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("n", "first", "starts", "names", "before")]), "phrases")
    runs_of, ranks = ranked_runs(texts, length, words)
    settled = written(settle(runs_of, ranks, length, words), "settled")
    discard(texts, runs_of, ranks)
    spot = F.xxhash64(*_KEYS, "lo")
    run = F.struct("lo", "hi", "open", "p")
    runs = settled.select("id", *_KEYS, F.explode("runs").alias("x")).select("id", *_KEYS, "x.*")
    asked = runs.where("key != 0").groupBy("key").agg(F.max("open").alias("some"), F.min(spot).alias("first"), F.max(spot).alias("last")).where("some AND first < last").select("key")
    kept = runs.where("key != 0").join(asked, "key", "left_semi").select("id", *_KEYS, run.alias("run"))
    kept = kept.union(runs.where("key = 0").select("id", *_KEYS, run.alias("run")))
    wanted, weigh = _gathered(kept, "to-group")
    groups = written(grouped(src, wanted, weigh, length), "groups")
    place = F.xxhash64(*_KEYS, "at")
    twice = lambda rows, *by: rows.groupBy(*by).agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select(*by)
    # Equal outer strings have equal inner ones, so 127 bits of hash have to agree.
    both = twice(groups.where("outer != 0"), "outer", "inner")
    outer = groups.where("outer != 0 AND open").join(both, ["outer", "inner"], "left_semi").select(*_KEYS, "at")
    outer = written(outer, "outer-groups")
    open_groups = groups.where("open").select(*_KEYS, "at", "inner").join(outer, [*_KEYS, "at"], "left_anti")
    left = written(open_groups.join(twice(groups, "inner"), "inner", "left_semi"), "open-groups")
    # Every group with the inner string of an open one takes part; only open ones ask.
    part = groups.join(left.select("inner").distinct(), "inner", "left_semi").select(*_KEYS, "at")
    part = part.join(left.select(*_KEYS, "at", F.lit(True).alias("open")), [*_KEYS, "at"], "left").select(*_KEYS, "at", F.coalesce("open", F.lit(False)).alias("open"))
    ids = settled.select("id", *_KEYS)
    last = F.col("at")
    alone = part.join(ids, list(_KEYS)).select("id", *_KEYS, F.struct((last - (_GROUP - 1)).alias("lo"), last.alias("hi"), "open", F.lit(-1).alias("p")).alias("run"))
    bare = kept.where("run.p < 0").select("id", *_KEYS, "run")
    wanted_one, weigh_one = _gathered(alone.union(bare), "to-compare")
    hashed = written(single(src, wanted_one, weigh_one, length), "windows")
    again = hashed.where("hashed").groupBy("h1", "h2").agg(F.min(spot).alias("first"), F.max(spot).alias("last"), F.max("open").alias("some")).where("some AND first < last").select("h1", "h2")
    elsewhere = hashed.where("open AND hashed").join(again, ["h1", "h2"], "left_semi").select(*_KEYS, "lo", "hi")
    inside = hashed.where("NOT hashed").select(*_KEYS, "lo", "hi")
    sure = settled.select(*_KEYS, F.explode("sure").alias("x")).select(*_KEYS, "x.*")
    whole = outer.select(*_KEYS, (last - (_GROUP - 1)).alias("lo"), last.alias("hi"))
    ranges = sure.union(elsewhere).union(inside).union(whole).select(*_KEYS, "lo", (F.col("hi") + length).alias("stop"), F.lit(False).alias("worded"))
    tables = [settled, wanted, groups, outer, left, wanted_one, hashed]
    if words is not None:
        looks = settled.select("id", *_KEYS, F.explode("look").alias("x")).select("id", *_KEYS, F.struct("x.lo", "x.hi", F.lit(False).alias("open"), "x.p").alias("run"))
        wanted_words, weigh_words = _gathered(looks, "to-read")
        strings = written(passages(src, wanted_words, weigh_words, words), "passages")
        ranges = ranges.union(strings.where("NOT hashed").select(*_KEYS, "lo", "stop", F.lit(True)))
        strings_of = strings.where("hashed")
        twice_there = strings_of.groupBy("h1", "h2").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).where("first < last").select("h1", "h2")
        ranges = ranges.union(strings_of.join(twice_there, ["h1", "h2"], "left_semi").select(*_KEYS, "lo", "stop", F.lit(True)))
        tables += [wanted_words, strings]
    packed = F.shiftleft(F.col("lo").cast("long"), 32).bitwiseOR(F.col("stop").cast("long"))
    marks = ranges.groupBy(*_KEYS).agg(F.collect_list(F.when(~F.col("worded"), packed)).alias("marks"), F.collect_list(F.when(F.col("worded"), packed)).alias("worded"))
    long = (F.col("copies") > 1) & (F.col("n") >= length)
    out = settled.select(*_KEYS, long.alias("whole"), ((F.col("copies") > 1) & (F.col("enough") | long)).alias("clean_whole")).join(marks, list(_KEYS), "left").where("clean_whole OR marks IS NOT NULL")
    result = written(_spans(out), "spans")
    discard(*tables)
    return result


def _gathered(runs: DataFrame, label: str) -> tuple[DataFrame, int]:
    """Runs per text, packed in two arrays of long (place: lo, hi; about: p, open), written, and their size in bytes."""
    place = F.shiftleft(F.col("run.lo").cast("long"), 32).bitwiseOR(F.col("run.hi").cast("long"))
    about = F.shiftleft(F.col("run.p").cast("long"), 1).bitwiseOR(F.col("run.open").cast("long"))
    out = written(runs.groupBy("id", *_KEYS).agg(F.collect_list(place).alias("runs"), F.collect_list(about).alias("about")), label)
    return out, out.agg(F.sum(F.size("runs") * 16 + 96).alias("b")).first()["b"] or 0


def _merged(x: np.ndarray) -> np.ndarray:
    """Byte ranges, packed as start and stop in one long, merged into maximal ones."""
    x = np.sort(x)
    if not len(x):
        return x
    lo, stop = x >> 32, np.maximum.accumulate(x & 0xFFFFFFFF)
    new = np.flatnonzero(lo[1:] > stop[:-1]) + 1
    return (lo[np.concatenate([[0], new])] << 32) | stop[np.concatenate([new - 1, [len(lo) - 1]])]


def _spans(marks: DataFrame) -> DataFrame:
    """marks (ranges of repeated windows) merged into maximal byte ranges (spans), and together with those of words (both); empty where the whole text goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _nested(whole, "marks", "worded")):
            lists = []
            for name in ("marks", "worded"):
                col = batch.column(name)
                off = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy())])
                lists.append((off, col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)))
            (off, packed), (w_off, worded) = lists
            whole, clean_whole = (batch.column(c).to_pylist() for c in ("whole", "clean_whole"))
            spans, both = [], []
            for i in range(len(batch)):
                own, other = packed[off[i] : off[i + 1]], worded[w_off[i] : w_off[i + 1]]
                spans.append(_merged(own[:0] if whole[i] else own))
                both.append(own[:0] if clean_whole[i] else _merged(np.concatenate([own, other])) if len(other) else spans[-1])
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*_KEYS, "whole", "clean_whole")), pa.array(spans, kind), pa.array(both, kind)], names=[*_KEYS, "whole", "clean_whole", "spans", "both"])

    return marks.select(*_KEYS, "whole", "clean_whole", "marks", "worded").mapInArrow(tidy(run), "k1 long, k2 long, whole boolean, clean_whole boolean, spans array<bigint>, both array<bigint>")


def remove_repeats(df: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", spans_col: str = "removed", kept_col: str = "kept", words: int | None = None, clean_col: str = "clean_text") -> DataFrame:
    """The table with `spans_col`, the maximal removed byte ranges [start, stop), and `kept_col`, the remaining bytes.

    With `words`, also `clean_col`: the text without these ranges and without the passages of `words` words that are repeated; a character that loses a byte goes whole.
    """
    marks = repeated_starts(_source(df, id_col, text_col), length, words)
    weigh = marks.agg(F.sum((F.size("spans") + F.size("both")) * 8 + 64).alias("b")).first()["b"] or 0
    keep = [c for c in df.columns if c not in (spans_col, kept_col, *([] if words is None else [clean_col]))]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    # Only struct fields, so that no column of the table can clash with ours.
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), text.alias("text"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"))
    rows = sized_join(rows, marks, list(_KEYS), "left", weigh).select("row", "text", "whole", "clean_whole", "spans", "both")

    def left(data: bytes, cut: list[tuple[int, int]]) -> bytes:
        edges = [0, *[x for s in cut for x in s], len(data)]
        return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                whole, clean_whole, ranges, both = (part.column(c).to_pylist() for c in ("whole", "clean_whole", "spans", "both"))
                spans, kept, clean = [], [], []
                for i, text in enumerate(part.column("text")):
                    data = text.as_py().encode()
                    cut, cut_both = ([(0, len(data))] if all_of else [(x >> 32, x & 0xFFFFFFFF) for x in some or []] for all_of, some in ((whole[i], ranges[i]), (clean_whole[i], both[i])))
                    spans.append([{"start": a, "stop": b} for a, b in cut])
                    kept.append(left(data, cut))
                    clean.append(text.as_py() if not cut_both else left(data, cut_both).decode("utf-8", "ignore"))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                out = [part.column("row"), pa.array(spans, kind), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays([*out, pa.array(clean, pa.string())][: len(fields)], names=[f.name for f in fields])

    fields = [rows.schema["row"], T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))), T.StructField("kept", T.BinaryType())]
    fields += [] if words is None else [T.StructField("clean", T.StringType())]
    out = rows.mapInArrow(tidy(run), T.StructType(fields))
    extra = [] if words is None else [F.col("clean").alias(clean_col)]
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], F.col("spans").alias(spans_col), F.col("kept").alias(kept_col), *extra)
