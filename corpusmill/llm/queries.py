"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import bpe, conversation_repair, fingerprints, language_id, mixing, ngram_join, periodic_runs, quality_classifier, quality_rules, suffix_dedup, token_counts, token_output, url_filter
from corpusmill.llm.textbatch import bounded_batches
from corpusmill.session import scratch, sized_join, table, written


URL_RULES = (
    url_filter.Rule("allow", "com/"),
    url_filter.Rule("block", "example.com/en/"),
    url_filter.Rule("allow", "www.example.com/en/"),
    url_filter.Rule("block", "net/es/"),
    url_filter.Rule("block", "net/fr/"),
)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without doc_id is not held out; a label without one is not learned from."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = quality_classifier.train(docs, labels.where(fold != 0), label_col="quality")
    return quality_classifier.score(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, path, pattern).drop("text"), path, pattern)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*quality_rules.RESULT)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked_components(table(spark, sf_dir, "documents"), size=3, percent=90)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables label no URLs, so the training URLs are labelled by seed terms in their hosts."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(url_filter.seed_labels(pages))
    return url_filter.judge(pages, model, URL_RULES).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), keep=("doc_id",)).select(*mixing.RESULT)


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_group: the smallest doc_id that verified likeness of 0.8 reaches, from the signatures' bands."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    near = fingerprints.near_duplicates(docs, percent=80, perms=128, size=5).groupBy("doc_id").agg(F.min("component_id").alias("near_group"))
    near = written(near, "near-groups")
    out = fingerprints.compare_with_next(docs, perms=128, size=5)
    out = out.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
    return sized_join(out, near, ["doc_id"], "left", 16 * near.count())


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), length=400, words=50)
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])
    digest = ((F.octet_length("kept") + lost).cast("long").alias("n_bytes"), lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    # Beyond the digests: bytes kept, and the text that is left once repeated passages of 50 words go too, which may have less than 400 bytes (a character that loses a byte goes whole).
    return out.select("doc_id", *digest, F.octet_length("kept").cast("long").alias("n_kept"), "clean_text", F.octet_length("clean_text").cast("long").alias("n_clean"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "tokens")
    token_output.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out, end_id=2)
    return token_output.read_tokens(spark, out)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row without doc_id is not held out, nor learned from."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    model = language_id.train(docs.where(fold != 0))
    out = language_id.label(docs.select("doc_id", "text"), model, spans=False)
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation of which no turn is left has zeros, no edits and the digest of nothing."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.report(conversation_repair.damage(turns)).withColumnRenamed("conv_id", "id")
    every = turns.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    nothing = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(b""), 256)}
    return out.select("conv_id", *[F.coalesce(c, nothing.get(c, F.lit(0))).alias(c) for c in conversation_repair.REPORT])


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = periodic_runs.collapse(docs.withColumn("text", periodic_runs.plant(F.col("text"), F.col("doc_id"))))
    best = periodic_runs.strongest(F.col("runs"))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), periodic_runs.listed(F.col("runs")).alias("listed"), "collapsed")
    digests = (F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.*", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"), *digests)


_ALL = (op1_quality_classifier, op2_bpe, op3_quality_rules, op4_ngram_jaccard, op5_url_filter, op6_source_mixing, op7_minhash, op8_suffix_dedup, op9_token_files, op10_token_counts, op11_language_id, op12_conversation_repair, op13_periodic_runs)


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: _bounded(q) for q in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_rules.oracle(), "op6_source_mixing": mixing.oracle()}
