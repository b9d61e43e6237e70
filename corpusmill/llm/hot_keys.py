"""Joins with one row a key, in which the rows of a large key are dealt to several tasks.

Defined results: those of the plain join. Null keys match nothing, repeated rows stay, an empty table of large keys means the plain join, and
columns named `blocks` or `deal` must not be among the rows'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import sized_join, written

#: Rows of a large key that one block holds, about.
BLOCK_ROWS = 1024
#: Rows from which a key is large.
LARGE = 4096
#: One row in SAMPLE (by `part`) tells which keys are large.
SAMPLE = 64


def sampled(rows: DataFrame, by: list[str], part: Column) -> DataFrame:
    """Keys that a sample of the rows finds large, with their number of blocks, written. `part` is a hash of what the sample takes whole.

    The sample decides about the dealing only; no result depends on it.
    """
    taken = rows.where(F.pmod(part, F.lit(SAMPLE)) == 0)
    return counted(taken.groupBy(*by).agg((F.count("*") * SAMPLE).alias("times")), by, "times")


def counted(keys: DataFrame, by: list[str], times: str) -> DataFrame:
    """The large keys of a table that knows how many rows each has, with their number of blocks, written."""
    large = keys.where(F.col(times) >= LARGE)
    return written(large.select(*by, F.ceil(F.col(times) / BLOCK_ROWS).cast("int").alias("blocks")), "large-keys")


def dealt_join(rows: DataFrame, keys: DataFrame, by: list[str], how: str, large: DataFrame, spot: Column, alike: bool = False) -> DataFrame:
    """rows.join(keys, by, how), where keys has one row a key at most and none of its columns is null.

    Rows of the keys in `large` (by, blocks; written) go to a block by the hash `spot`, and these keys' rows to every block. The join
    that looks up the blocks broadcasts them behind a check of their size; beyond it both its sides are plain shuffles that AQE can split.
    alike: the plan has the same form where no key is large, so that its figures can be compared between inputs.
    """
    n = large.count()
    if not n and not alike:
        return rows.join(keys, by, how)
    size = 40 * n
    rows = sized_join(rows, large, by, "left", size)
    rows = rows.withColumn("deal", F.when(F.col("blocks").isNull(), 0).otherwise(F.pmod(spot, F.col("blocks"))).cast("int")).drop("blocks")
    keys = sized_join(keys, large, by, "left", size)
    keys = keys.withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    return rows.join(keys, [*by, "deal"], how).drop("deal")
