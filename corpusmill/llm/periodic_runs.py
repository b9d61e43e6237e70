"""Periodic runs of words in a text: heavy/light lag counting, then island scans of the lags that can hold a run.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at least
max(min_words, min_repeats * q) words, that neither neighbour extends keeping period q. At lag q it is an island of
length - q matches in a row, so a lag is only looked at if it has that many matches in all. These counts are exact: words that
occur often are counted by the FFT autocorrelation of their places, the others by the differences of their pairs
of places. Matches of a run at multiples of its period are taken off those lags' counts, so a long run costs one scan.

Every text is worked on whole, in one task, with about 60 bytes a word at the peak and batches of about 2 MB of text else. No shuffle.

Defined results: a null, empty or blank text has no words, no runs and an empty `collapsed`; repeated rows are worked on each; other columns pass
through, those named as an added column are replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.bpe import slices
from corpusmill.llm.textbatch import tidy

WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("n_words", "runs", "collapsed")
#: Places of frequent words that one FFT call transforms.
FFT_CELLS = 1 << 20
#: Matches in a row that a block shows before its lag is scanned.
PROBES = 8


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """How many places i have ids[i] == ids[i + lag], for lag 0 to `most`; that of lag 0 is left at 0."""
    n = len(ids)
    freq = np.bincount(ids)
    frequent = freq > max(16, int(n**0.5))
    counts = np.zeros(most + 1, np.int64)
    order = np.argsort(ids, kind="stable")
    rare = order[(~frequent & (freq > 1))[ids[order]]]
    _add_pairs(ids, rare, counts, max(n, 1 << 16))
    if frequent.any():
        counts += _by_fft(ids, np.flatnonzero(frequent), most)
        counts[0] = 0
    return counts


def _add_pairs(ids: np.ndarray, at: np.ndarray, counts: np.ndarray, chunk: int) -> None:
    """Add the differences of all pairs of places of each word; `at` holds the places word by word, ascending."""
    word, most = ids[at], len(counts) - 1
    first, k = np.arange(len(at)), 1
    gaps: list[np.ndarray] = []
    held = 0
    while True:
        first = first[first + k < len(at)]
        first = first[word[first + k] == word[first]]
        gap = at[first + k] - at[first]
        near = gap <= most  # places ascend, so the next ones are further away
        first, gap = first[near], gap[near]
        if not len(first):
            break
        gaps.append(gap)
        held += len(gap)
        if held >= chunk:
            counts += np.bincount(np.concatenate(gaps), minlength=len(counts))
            gaps, held = [], 0
        k += 1
    if gaps:
        counts += np.bincount(np.concatenate(gaps), minlength=len(counts))


def _by_fft(ids: np.ndarray, words: np.ndarray, most: int) -> np.ndarray:
    """Autocorrelation of the words' places up to lag `most`, summed. Sums are whole numbers far below 2**53, so rounding gives them exactly."""
    size = _smooth(len(ids) + most)
    power = np.zeros(size // 2 + 1)
    step = max(1, FFT_CELLS // size)
    for s in range(0, len(words), step):
        places = (ids == words[s : s + step, None]).astype(np.float64)
        f = np.fft.rfft(places, size, axis=1)
        power += (f.real**2 + f.imag**2).sum(axis=0)
    return np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)


def _smooth(n: int) -> int:
    """The smallest of 2**k, 3 * 2**k and 5 * 2**k that is n or more."""
    return min(f << max(0, -(-n // f) - 1).bit_length() for f in (1, 3, 5))


def _has_block(ids: np.ndarray, lag: int, matches: int) -> bool:
    """Whether some block may be part of an island: an island of `matches` covers a whole block of half as many."""
    block = max(1, matches // 2)
    at = np.arange(0, len(ids) - lag - block + 1, block)
    for k in range(min(block, PROBES)):
        at = at[ids[at + k] == ids[at + k + lag]]
        if not len(at):
            return False
    return len(at) > 0


def find_runs(ids: np.ndarray, min_words: int = 24, min_repeats: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    if min_repeats < 2:
        raise ValueError("a run repeats its period twice at least")
    n, most = len(ids), len(ids) // min_repeats
    if n < min_words or most < 1:
        return []
    left, lags = lag_counts(ids, most), np.arange(most + 1)
    need = np.maximum(np.maximum(min_words - lags, (min_repeats - 1) * lags), 1)
    found: dict[tuple[int, int], int] = {}
    for lag in np.flatnonzero(left >= need).tolist():
        if lag == 0 or left[lag] < need[lag] or not _has_block(ids, lag, int(need[lag])):
            continue
        same = np.zeros(n - lag + 2, np.int8)
        same[1:-1] = ids[lag:] == ids[:-lag]
        edge = np.flatnonzero(np.diff(same))
        start, stop = edge[::2], edge[1::2]
        long = stop - start >= need[lag]
        for s, e in zip(start[long].tolist(), stop[long].tolist(), strict=True):
            length = e - s + lag
            # A stretch met before has a smaller period, which divides this lag.
            if (s, length) not in found:
                found[s, length] = lag
                times = np.arange(2 * lag, min(most, length) + 1, lag)
                left[times] -= length - times
    return sorted((s, length, q) for (s, length), q in found.items())


def kept_words(n: int, runs: Sequence[tuple[int, int, int]]) -> np.ndarray:
    """True for words that stay: no run holds them after its first period."""
    change = np.zeros(n + 1, np.int64)
    for s, length, q in runs:
        change[s + q] += 1
        change[s + length] -= 1
    return np.cumsum(change[:n]) == 0


def _of_text(text: str, min_words: int, min_repeats: int) -> tuple[int, list[tuple[int, int, int]], bytes]:
    words = text.encode().split()  # bytes split at \x20 and \x09-\x0D
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    runs = find_runs(ids, min_words, min_repeats)
    if runs:
        words = [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]
    return len(ids), runs, b" ".join(words)


def collapse(df: DataFrame, text_col: str = "text", min_words: int = 24, min_repeats: int = 3) -> DataFrame:
    """Add n_words, runs (structs of start, length and period in words, by start and period) and collapsed (the kept words joined by a space)."""
    keep = [c for c in df.columns if c not in ADDED]
    # Carried columns lie in a struct, so that none of them can clash with ours.
    row = F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    src = df.select(row.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    places = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                got = [_of_text(t.as_py(), min_words, min_repeats) for t in part.column("text")]
                runs = [[{"start": s, "length": m, "period": q} for s, m, q in r] for _, r, _ in got]
                made = [pa.array([n for n, _, _ in got], pa.int64()), pa.array(runs, pa.list_(places)), pa.array([w.decode() for _, _, w in got], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column("row"), *made], names=["row", *ADDED])

    place = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([src.schema["row"], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(place)), T.StructField("collapsed", T.StringType())])
    out = src.mapInArrow(tidy(run), schema)
    return out.select(*[F.col("row").getField(c).alias(c) for c in keep], *ADDED)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period; of equal ones that of the smallest start, then period. Null without runs."""
    # Exact: fractions are compared by products.
    more = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    none = F.element_at(F.slice(runs, 1, 1), 1)
    return F.when(F.size(runs) > 0, F.aggregate(runs, none, lambda best, r: F.when(more(r, best), r).otherwise(best)))


def listed(runs: Column) -> Column:
    """Every run as `start,length,period` and a line feed."""
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return F.array_join(F.transform(runs, line), "")


def plant(text: Column, doc_id: Column) -> Column:
    """The text with a periodic tail in about every tenth document with words, chosen and shaped by the CRC-32 of its id; other texts as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p))))

    whole = F.element_at(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(tail(w), " "))), 1)
    return F.when(h % 10 == 0, F.coalesce(whole, text)).otherwise(text)
