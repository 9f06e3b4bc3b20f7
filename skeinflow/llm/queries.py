"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm._shared import table
from skeinflow.llm import line_dedup, near_dedup, pii_surrogates, quality_classifier, quality_rules, secret_scan, source_mixing, substring_dedup, warc_revisits
from skeinflow.llm.decontamination import find_contamination, items_digest
from skeinflow.llm.sql import ORACLE_SQL as ORACLE_SQL


def _equals(value: str):
    return lambda x: x == value


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter(F.col("secrets.kind"), _equals(k))).cast("long").alias(f"n_{secret_scan.KINDS[k]}") for k in range(4)]
    base = secret_scan.span_list(F.filter("secrets", lambda s: s["kind"] < 3))
    return found.select("doc_id", *counts[:3], F.sha2(base.cast("binary"), 256).alias("base_sha256"), secret_scan.span_list(F.col("secrets")).alias("spans"), counts[3])


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


#: The key's setting, and the key where it is unset: a public one, for the synthetic tables only.
PII_KEY = ("spark.skeinflow.pii.key", "for synthetic tables only")


def op5_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_surrogates.replace_pii(docs, spark.conf.get(*PII_KEY).encode())
    counts = [F.size(F.filter(F.col("entities.kind"), _equals(k))).cast("long").alias(f"n_{k}") for k in pii_surrogates.KINDS]
    spans = F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["kind"], e["start"], e["end"])), ",")
    return found.select("doc_id", *counts, spans.alias("spans"), "text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", *(f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")), F.round("quality.score", 9).alias("score"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_revisits.captures(table(spark, sf_dir, "pages"))
    found = warc_revisits.resolve_revisits(records)
    return found.select(
        "page_id", warc_revisits.canonical_url("url").alias("canonical_url"), F.substring("refers_to", 2, 20).cast("long").alias("refers_to_page"), "outcome", F.col("status").cast("int").alias("status"),
        F.element_at("headers", "content-type").alias("content_type"), F.element_at("headers", "date").alias("date"), F.sha2(F.coalesce("payload", F.lit("").cast("binary")), 256).alias("payload_sha256"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return source_mixing.mix(docs).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest(F.col("items")).alias("items_sha256"), "contaminated")


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_quality_rules": op6_quality_rules,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_quality_classifier": op8_quality_classifier,
    "op9_source_mixing": op9_source_mixing,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
}
