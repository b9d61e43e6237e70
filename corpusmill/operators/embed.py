"""Embedding providers: a protocol, a deterministic feature-hash provider, and the column they fill."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from functools import lru_cache
from typing import Protocol, TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.errors import DEFAULT_DELAY, retryable_one
from corpusmill.functions.text import WHITE


R = TypeVar("R")


class EmbeddingProvider(Protocol):
    """Anything that turns texts into vectors; it is sent to executors, so it has to pickle."""

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...
    def model_name(self) -> str: ...
    def dimensions(self) -> int: ...


class _Features(dict):
    """Words to their places, ~place for those of negative sign; emptied when it holds more than MOST words."""

    MOST = 200_000

    def __init__(self, dim: int) -> None:
        super().__init__()
        self.dim = dim

    def __missing__(self, word: str) -> int:
        h = hashlib.md5(word.encode(), usedforsecurity=False).digest()
        at = int.from_bytes(h[:4], "big") % self.dim
        self[word] = at = at if h[4] < 128 else ~at
        return at

    def trim(self) -> None:
        if len(self) > self.MOST:
            self.clear()


_features = lru_cache(maxsize=8)(_Features)


class HashEmbedding:
    """Signed feature hashing of lower-cased words, normalised. Deterministic; no claim of meaning."""

    def __init__(self, dim: int = 64, normalize: bool = True) -> None:
        self.dim, self.normalize = dim, normalize

    def embed(self, text: str) -> list[float]:
        return self.embed_batch([text])[0]

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        seen, signed, sizes = _features(self.dim), [], []
        for t in texts:
            words = t.lower().split()
            signed += map(seen.__getitem__, words)
            sizes.append(len(words))
        seen.trim()
        at = np.array(signed, np.int64)
        # A word is its place, or ~place where its sign is negative.
        place = np.where(at < 0, ~at, at) + np.repeat(np.arange(len(texts)) * self.dim, sizes)
        v = np.bincount(place, np.where(at < 0, -1.0, 1.0), len(texts) * self.dim).reshape(len(texts), self.dim)
        n = np.sqrt((v**2).sum(axis=1, keepdims=True))
        return (np.divide(v, n, out=v, where=n > 0) if self.normalize else v).tolist()

    def model_name(self) -> str:
        return f"feature-hash-{self.dim}"

    def dimensions(self) -> int:
        return self.dim


class RateLimited(Exception):
    """A provider asks to wait; `delay` in seconds, or None."""

    def __init__(self, message: str = "rate limit", delay: float | None = None) -> None:
        super().__init__(message)
        self.delay = delay


class ProviderError(Exception):
    """A provider's call failed; `status` is the HTTP status where there was a response."""

    def __init__(self, message: str, status: int | None = None) -> None:
        super().__init__(message)
        self.status = status


def with_backoff(call: Callable[[], R], most: int = 3, first: float = 1.0, sleep: Callable[[float], None] = time.sleep, waits_itself: tuple[type[Exception], ...] = ()) -> R:
    """The result of `call`, tried again up to `most` times after failures that may pass, each wait twice the one before.

    Exceptions of `waits_itself` go to the caller at once, as do those that a retry cannot mend.
    """
    wait = first
    for left in range(most, -1, -1):
        try:
            return call()
        except waits_itself:
            raise
        except Exception as e:
            limited = isinstance(e, RateLimited)
            if not left or not (limited or retryable_one(getattr(e, "status", None), str(e))):
                raise
        sleep(wait)
        wait *= 2
    raise AssertionError("unreachable")


class BackingOff:
    """Wraps an embedding provider: broken connections and server errors are tried again; a rate limit is left to Retrying."""

    def __init__(self, provider: EmbeddingProvider, most: int = 3, first: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> None:
        self.provider, self.most, self.first, self.sleep = provider, most, first, sleep

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return with_backoff(lambda: self.provider.embed_batch(texts), self.most, self.first, self.sleep, (RateLimited,))

    def model_name(self) -> str:
        return self.provider.model_name()

    def dimensions(self) -> int:
        return self.provider.dimensions()


class Retrying:
    """Wraps a provider: waits out rate limits, `most` times and `total` seconds a batch at most."""

    def __init__(self, provider: EmbeddingProvider, most: int = 5, total: float = 300.0, sleep=time.sleep) -> None:
        self.provider, self.most, self.total, self.sleep = provider, most, total, sleep

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        waited = 0.0
        for attempt in range(self.most + 1):
            try:
                return self.provider.embed_batch(texts)
            except RateLimited as e:
                delay = DEFAULT_DELAY if e.delay is None else e.delay
                if attempt == self.most or waited + delay > self.total:
                    raise
                self.sleep(delay)
                waited += delay
        raise AssertionError("unreachable")

    def model_name(self) -> str:
        return self.provider.model_name()

    def dimensions(self) -> int:
        return self.provider.dimensions()


def embed(text: Column, provider: EmbeddingProvider, batch_size: int = 100, kind: str = "double") -> Column:
    """Vectors of a text column; blank text gives the zero vector; a wrong dimension is an error."""

    @F.arrow_udf(T.ArrayType(T.DoubleType() if kind == "double" else T.FloatType()))
    def run(texts: pa.Array) -> pa.Array:
        dim = provider.dimensions()
        values = [t or "" for t in texts.to_pylist()]
        out = np.zeros((len(values), dim), np.float64 if kind == "double" else np.float32)
        full = [i for i, t in enumerate(values) if t.strip(WHITE)]
        for a in range(0, len(full), batch_size):
            part = full[a : a + batch_size]
            got = provider.embed_batch([values[i] for i in part])
            if len(got) != len(part):
                raise ValueError(f"provider gave {len(got)} vectors for {len(part)} texts")
            wrong = [len(v) for v in got if len(v) != dim]
            if wrong:
                raise ValueError(f"provider gave {wrong[0]} components, not {dim}")
            out[part] = got
        offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * dim)
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return run(text)
