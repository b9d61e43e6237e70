"""A corpus pipeline of five stages over `documents`.

quality rules -> n-gram Jaccard join -> suffix-array dedup -> mixing to target weights -> BPE encoding and decoding.
Every stage reads all that the one before kept; run() writes each stage as Parquet under the shared folder and
rereads it, so a lost executor costs one stage at most. ORACLE_SQL is None: the third stage (repeated byte
strings) and the last (BPE) have no SQL form; tests hold the stages against brute force.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, mixing, ngram_join, quality_rules, suffix_dedup
from corpusmill.llm.textbatch import bounded_batches
from corpusmill.session import sized_join, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A null, empty or short text fails the base rules; equal rows are judged alike, each by itself; an empty table stays one."""
    bounded_batches(spark)
    return quality_rules.judge(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked at 5 words and 0.8 stays, that of the smallest id (null last)."""
    bounded_batches(spark)
    docs = docs.select(*COLUMNS)
    again = written(docs.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select(F.col("doc_id").alias("id")), "repeated-ids")
    n = again.count()
    if n:
        return _near_copies_of_repeated_ids(docs, again, n)
    groups = ngram_join.linked_components(docs, size=5, percent=80)
    gone = written(groups.where("doc_id != component_id").select("doc_id"), "near-copies")
    # Ids of the documents that go; broadcast only while they are few, so that texts need not be shuffled.
    return sized_join(docs, gone, ["doc_id"], "left_anti", 16 * gone.count()).select(*COLUMNS)


def _near_copies_of_repeated_ids(docs: DataFrame, again: DataFrame, n: int) -> DataFrame:
    """near_copies where ids are null or repeat. Such rows go by a 64-bit hash of id and text, so other texts of an id are other documents."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    again = again.select(name("id").alias("name"), F.lit(True).alias("again"))
    with_again = sized_join(docs.withColumn("name", name("doc_id")), again, ["name"], "left", 32 * n)
    hashed = F.xxhash64("name", F.coalesce("text", F.lit("")))
    keyed = with_again.select(*COLUMNS, F.coalesce("again", F.lit(False)).alias("again"), F.when(F.col("again"), hashed).otherwise(F.col("doc_id")).alias("row"))
    # Equal rows have equal keys; one of them stays.
    one = keyed.where("again").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("r")).select("r.*", "row")
    rows = written(keyed.where("NOT again").select(*COLUMNS, "row").union(one), "rows")
    groups = ngram_join.linked_components(rows, id_col="row", size=5, percent=80).withColumnRenamed("doc_id", "row")
    by_id = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = groups.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(by_id).getField("row").alias("row"))
    gone = written(groups.select("row").join(first, "row", "left_anti"), "near-copies")
    return sized_join(rows, gone, ["row"], "left_anti", 16 * gone.count()).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings of 400 bytes or of 50 words that occur twice go; a character that loses a byte goes whole. A text with nothing left goes, null and empty ones too.

    Rows with equal texts lose all of them where these are long enough; null and repeated ids do not matter.
    """
    bounded_batches(spark)
    out = suffix_dedup.remove_repeats(docs.select(*COLUMNS), length=400, words=50).select("doc_id", F.col("clean_text").alias("text"), "lang", "source")
    return out.where("text != ''").select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one document a source takes in part is cut after its last word taken.

    A null source is a source, a text without words is never taken, and the seeded order of equal rows is that of their ids, sizes and texts: equal rows share evenly.
    """
    bounded_batches(spark)
    mixed = mixing.materialise(mixing.mix(docs.select(*COLUMNS)))
    return mixed.select("doc_id", "text", "lang", "source", F.char_length("text").cast("long").alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of the bytes they decode to. A null text is an empty one, without ids; repeated rows are encoded each; an empty table stays one."""
    bounded_batches(spark)
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.decode(bpe.encode(docs.select("doc_id", "source", "text"), path, pattern).drop("text"), path, pattern)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality),
    ("n-gram jaccard join", near_copies),
    ("suffix-array dedup", repeated_passages),
    ("mixing sources", mix_sources),
    ("byte-level bpe", encode),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
