"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Targets. A budget (share of all words) is dealt to the sources by weight; a source never gets
more than `max_epochs` times its size, and what it cannot take is dealt to the others by weight.
With sources sorted by cap / weight the fixed point is closed: the level is that of the first source
whose cap is not under the level left after the sources before it were capped.

Sampling. A source with target t and size s repeats every document floor(t / s) times; the
remainder is taken from the documents in a seeded order until it is used up, the last
one in part. So each source's taken words are its target rounded down, no document
exceeds max_epochs times its size, and a rerun gives the same rows.
The order is that of a hash of the id. A source's sums by hash bucket (BUCKETS of them) tell in which bucket the
remainder ends; only that bucket's rows are ordered one by one, and the place where it ends (one
row a source) then decides for every row. Texts are never shuffled or sorted, however large a source is. What is
one row a source or bucket passes through windows of one task: some hundred bytes a source.

Built-in DataFrame functions only. Defined results: null text has size 0; a size-0 document takes 0 words; null is a
source of its own, last; an empty table gives an empty table; repeated ids are ordered by size and text, and rows equal
in all three are taken alike. Columns of the table named like an added one are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import sized_join, written

#: Buckets of the seeded order in each source: three hexadecimal digits.
BUCKETS = 16**3
WEIGHTS = (3, 1, 2)
SEED = "mix-1"

ADDED = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """From one row a source (source, source_size): its target. Weights repeat over the sources in code point order, null last."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights))
    caps = sizes.select("source", "source_size", weight.alias("w"), (F.lit(float(max_epochs)) * F.col("source_size")).alias("cap"))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, onward, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.lit(float(share)) * F.sum("source_size").over(everything)
    levels = caps.select("*", ((budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(onward)).alias("level"))
    fits = F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(everything)
    return levels.select("source", "source_size", F.least("cap", F.coalesce(F.col("w") * level, F.col("cap"))).alias("target"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, max_epochs: float = 2.0, seed: str = SEED, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The table with size, source_size, target and taken. `keep` names the columns to carry (all by default).

    No row is shuffled: bucket sums give each source the bucket in which its remainder ends, the rows of that
    bucket alone are put in order, and one cut a source then decides for every row by its own values.
    """
    cols = [c for c in (keep if keep is not None else df.columns) if c not in ADDED]
    rank = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))).cast("binary"))
    # Carried columns lie in a struct, so that none of them can clash with ours; a null source is a key of its own.
    rows = df.select(
        (F.struct(*[F.col(f"`{c}`") for c in cols]) if cols else F.lit(None)).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source_col}`").cast("string")), F.lit("")).alias("key"),
        rank.alias("rank"),
        word_count(F.col(f"`{text_col}`")).alias("size"),
        F.coalesce(F.xxhash64(F.col(f"`{text_col}`")), F.lit(0)).alias("tie"),
    ).withColumn("bucket", F.substring("rank", 1, 3))
    if text_col not in cols:
        rows = written(rows, "mix-sizes")  # narrow, so that texts are read once
    buckets = written(rows.groupBy("key", "bucket").agg(F.sum("size").alias("n")), "mix-buckets")
    cuts = written(_cuts(rows, buckets, weights, share, max_epochs), "mix-cuts")
    weigh = cuts.agg(F.sum(F.octet_length("key") + 120).alias("b")).first()["b"] or 0
    joined = sized_join(rows, cuts, ["key"], "inner", weigh)
    place, cut = F.struct("rank", "size", "tie"), F.struct("cut_rank", "cut_size", "cut_tie")
    extra = F.when(F.col("cut_rank").isNull(), 0).when(place < cut, F.col("size")).when(place == cut, F.col("cut_share")).otherwise(0)
    taken = (F.col("whole") * F.col("size") + extra).cast("long")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in cols], "size", "source_size", "target", taken.alias("taken"))


def _cuts(rows: DataFrame, buckets: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Per source key: source_size, target, whole repetitions, and the place in the seeded order at which its remainder ends."""
    name = F.when(F.col("key") != "", F.substr("key", F.lit(2))).alias("source")
    by_source = buckets.groupBy("key").agg(F.sum("n").alias("source_size")).select(name, "source_size")
    aims = targets(by_source, weights, share, max_epochs).withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))
    whole = F.coalesce(F.expr("try_divide(floor(target) - floor(target) % source_size, source_size)").cast("long"), F.lit(0))
    aims = aims.select("key", "source_size", "target", whole.alias("whole"), (F.floor("target").cast("long") - whole * F.col("source_size")).alias("left"))
    in_source = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("key", "bucket", "n", F.coalesce(F.sum("n").over(in_source), F.lit(0)).alias("start"))
    ends_in = starts.join(aims, "key").where("start <= left AND left < start + n").select("key", "bucket", (F.col("left") - F.col("start")).alias("left"))
    # One bucket a source: a part in BUCKETS of its rows.
    near = rows.select("key", "bucket", "rank", "size", "tie").join(F.broadcast(ends_in) if _few(ends_in) else ends_in, ["key", "bucket"])
    equal = near.groupBy("key", "left", "rank", "size", "tie").agg(F.count("*").alias("times"))
    order = Window.partitionBy("key").orderBy("rank", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = equal.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("times")).over(order), F.lit(0)))
    at = placed.where("before <= left AND left < before + size * times")
    # Equal rows at the cut share what is left evenly; rounding down leaves less than a word a row.
    at = at.select("key", F.col("rank").alias("cut_rank"), F.col("size").alias("cut_size"), F.col("tie").alias("cut_tie"), F.expr("(left - before) div times").alias("cut_share"))
    return aims.join(at, "key", "left").select("key", "source_size", "target", "whole", "cut_rank", "cut_size", "cut_tie", "cut_share")


def _few(per_source: DataFrame, most: int = 100_000) -> bool:
    """Whether a table of one row a source at most may be broadcast."""
    return per_source.limit(most + 1).count() <= most


def materialise(mixed: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents as the mix takes them: whole copies, and where words are left over, the document up to that word.

    Drops the four added columns; a document of which nothing is taken goes.
    """
    cols = [c for c in mixed.columns if c not in ADDED]
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size")).cast("int")).otherwise(F.lit(0))
    rest = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(F.lit(0)).cast("int")
    parts = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    out = mixed.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("row"), F.explode(parts).alias("part"))
    text, value = F.col("row").getField(text_col), lambda c: F.col("row").getField(c)
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.greatest(F.col("part"), F.lit(0))), "")
    return out.select(*[(F.when(F.col("part") < 0, text).otherwise(head) if c == text_col else value(c)).alias(c) for c in cols])


RESULT = ("doc_id", *ADDED)


def oracle(table: str = "documents") -> str:
    """op6 as DuckDB SQL."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  md5('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS r FROM {table}),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([3.0, 1.0, 2.0])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT min_by(level, cap / w) FILTER (WHERE cap / w >= level) AS level FROM l),
t AS (SELECT source, source_size, least(cap, coalesce(w * f.level, cap)) AS target FROM l, f),
j AS (SELECT d.*, t.source_size, t.target, floor(t.target)::BIGINT AS aim,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY r, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN aim // source_size ELSE 0 END AS whole FROM j)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, aim - whole * source_size - before)))::BIGINT AS taken FROM k"""
