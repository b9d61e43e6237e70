"""The store that the session's settings name."""

from __future__ import annotations

from pyspark.sql import SparkSession

from corpusmill.schema import VECTOR_ROW
from corpusmill.session import shared_root
from corpusmill.sources.store import VectorStore

KIND, PATH, DIMENSION = "spark.corpusmill.store", "spark.corpusmill.store.path", "spark.corpusmill.store.dimension"
#: The length of vectors where the settings give none.
DEFAULT_DIMENSION = 768


def open_store(spark: SparkSession, name: str = "chunks") -> VectorStore:
    """The store of that name, initialized. Kind `shared` (the default) lies in the shared folder, kind `path` under the path of its own setting."""
    kind, dimension = spark.conf.get(KIND, "shared").lower(), int(spark.conf.get(DIMENSION, str(DEFAULT_DIMENSION)))
    if kind == "shared":
        root = f"{shared_root(spark)}/corpusmill-stores"
    elif kind == "path":
        root = spark.conf.get(PATH, None)
        if not root:
            raise ValueError(f"a store of kind path needs {PATH}")
    else:
        raise ValueError(f"unknown kind of store {kind!r} in {KIND}")
    store = VectorStore(spark, f"{root.rstrip('/')}/{name}", dimension, VECTOR_ROW)
    store.initialize()
    return store
