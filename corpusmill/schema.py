"""Schemas of the data model and configuration with its checks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "floats": T.ArrayType(T.FloatType()), "texts": T.MapType(T.StringType(), T.StringType())}


def _struct(**fields: str) -> T.StructType:
    """A schema by type names; built without a session, so that this module can be imported before there is one."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in fields.items()])


_CHUNK = {"id": "string", "url": "string", "title": "string", "content": "string", "chunkIndex": "int", "totalChunks": "int", "startOffset": "int", "endOffset": "int"}
WEB_PAGE = _struct(url="string", title="string", html="string")
PROCESSED_PAGE = _struct(url="string", title="string", content="string")
CHUNK = _struct(**_CHUNK)
VECTOR_ROW = _struct(**_CHUNK, embedding="floats")
PAGE_RESULT = _struct(url="string", success="boolean", stage="string", chunks="int", failureReason="string")
PROGRESS_EVENT = _struct(seq="long", stage="string", message="string", details="texts")
SOURCE = _struct(title="string", url="string", chunkNumber="int", totalChunks="int", distance="double")

#: Stages a page can fail in, and stages of progress events.
FAILURE_STAGES = ("crawl", "extract", "chunk", "embed", "store")
EVENT_STAGES = ("initialize", "validate", "crawl", "extract", "chunk", "embed", "store", "complete", "cancel")
UNTITLED = "Untitled Page"


@dataclass(frozen=True)
class CrawlConfig:
    max_pages: int = 20
    max_depth: int = 3
    user_agent: str = "corpusmill"


@dataclass(frozen=True)
class ChunkConfig:
    """Window size and overlap in characters."""

    size: int = 1000
    overlap: int = 200

    def __post_init__(self) -> None:
        if self.size <= 0:
            raise ValueError("chunk size must be over 0")
        if self.overlap < 0:
            raise ValueError("chunk overlap must be 0 or more")
        if self.overlap >= self.size:
            raise ValueError("chunk overlap must be smaller than the chunk size")


@dataclass(frozen=True)
class IndexConfig:
    """Limits of an indexing run. max_depth is honoured by the crawl. replace_pages: a page's stored chunks go when it is indexed again, in one version with the new ones."""

    max_pages: int = 10
    max_depth: int = 3
    chunk: ChunkConfig = ChunkConfig(800, 150)
    batch_size: int = 50
    min_chars: int = 100
    clear_existing: bool = False
    replace_pages: bool = False

    def __post_init__(self) -> None:
        if self.max_pages <= 0:
            raise ValueError("max_pages must be over 0")
        if self.max_depth < 0:
            raise ValueError("max_depth must be 0 or more")
        if self.batch_size <= 0:
            raise ValueError("batch_size must be over 0")
