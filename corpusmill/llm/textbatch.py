"""Vectorised text primitives shared by the operators that work on Arrow batches."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of text that one numpy step works on; a longer single text is a step of its own.
STEP_BYTES = 2 << 20



#: Rows of an Arrow batch; the session's default of 10000 long texts would not fit a task's memory.
BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Set the rows of an Arrow batch to BATCH_ROWS, unless the session has chosen a number itself."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, str(BATCH_ROWS))


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def tidy(run: Callable) -> Callable:
    """A mapInArrow function that gives freed memory back to the system when a task ends.

    Python workers stay for the tasks to come; without this an idle one keeps the peak of what it last did.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return whole


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift-multiply); a bijection of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def steps(sizes: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about `most`; every range has a row at least."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a null-free string array and the offsets of its rows in them, starting at 0."""
    wide = isinstance(texts, (pa.LargeStringArray, pa.LargeBinaryArray))
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def word_ends(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the words `[^\\x20\\x09-\\x0D]+` of one text."""
    space = np.ones(len(data) + 2, dtype=bool)
    space[1:-1] = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[::2], edges[1::2]


def word_starts(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Places at which the words of consecutive texts start."""
    word = ~_SPACE[raw]
    first = word.copy()
    first[1:] &= ~word[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = word[heads]
    return np.flatnonzero(first)


class Words:
    """Words `[^\\x20\\x09-\\x0D]+` of consecutive texts: hash of each word and the first word of each text."""

    def __init__(self, raw: np.ndarray, off: np.ndarray, lower: bool = True) -> None:
        n = len(raw)
        space = _SPACE[raw]
        word = ~space
        first = word.copy()
        first[1:] &= space[:-1]
        starts_at = off[:-1][(off[:-1] < off[1:])]
        first[starts_at] = word[starts_at]
        last = word.copy()
        if n:
            last[:-1] &= space[1:]
            ends_at = off[1:][(off[:-1] < off[1:])] - 1
            last[ends_at] = word[ends_at]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.first_word = np.searchsorted(self.start, off)
        folded = _LOWER[raw] if lower else raw
        self.hash = self._hashes(folded)

    def _hashes(self, folded: np.ndarray) -> np.ndarray:
        """Per word: sum of mixed (byte, place) values, so equal words have equal hashes wherever they stand."""
        length = self.end - self.start
        h = mix(length.astype(np.uint64) + np.uint64(1))
        active, k = np.arange(len(length)), 0
        # Eight bytes of every word at once; few words are longer than three such blocks.
        padded = np.concatenate([folded, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded.tobytes(), strides=(1,))
        while len(active):
            left = length[active] - 8 * k
            v = eight[self.start[active] + 8 * k]
            short = left < 8
            cut = np.where(short, np.uint64(1) << (np.minimum(left, 8) * 8 % 64).astype(np.uint64), np.uint64(0)) - np.uint64(1)
            h[active] = mix((h[active] ^ (v & cut)) * _MULT + np.uint64(k))
            active = active[left > 8]
            k += 1
        return h


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words and the first of each text. A shorter text with a word is one run; one without has none."""
    first, h = words.first_word, words.hash
    counts = np.diff(first)
    m = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_off = np.concatenate([[0], np.cumsum(m)])
    doc = np.repeat(np.arange(len(counts)), m)
    at = np.arange(out_off[-1]) - out_off[doc] + first[:-1][doc]
    have = np.minimum(size, counts)[doc]
    out = mix(have.astype(np.uint64))
    for k in range(size):
        inside = have > k
        nxt = h[np.minimum(at + k, max(len(h) - 1, 0))] if len(h) else np.zeros(len(at), np.uint64)
        out = np.where(inside, mix((out ^ nxt) * _MULT + np.uint64(k + 1)), out)
    return out, out_off
