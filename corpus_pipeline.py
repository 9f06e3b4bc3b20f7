"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the
columns of documents; the last adds what the mix takes of each. Between stages the
documents are written as Parquet into the shared folder and read again; what a stage wrote
on its way is deleted once the next stage's documents are there.

Null and empty texts fail the quality rules. Rows that repeat a doc_id are judged by their
own texts, but stay or go together in near-dedup. Empty tables give empty results, and
further columns pass through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.llm import decontamination, line_dedup, near_dedup, quality_rules, source_mixing
from skeinflow.llm._shared import mark, materialise, sweep, table

#: SQL can't express the quality score, the signatures or the seeded order at this size; tests use brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the likelihood ratio rejects go."""
    return quality_rules.drop_low_quality(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; documents that lose all their words go."""
    own = docs.columns
    found = line_dedup.dedup_lines(docs)
    removed = F.col(found.columns[-1])
    left = found.where((removed == 0) | F.col("text").rlike(r"[^ \x09-\x0D]"))
    if "n_chars" in own:
        left = left.withColumn("n_chars", F.when(removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return left.select(*(f"`{c}`" for c in own))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return near_dedup.drop_near_duplicates(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes a word, with size, source_size, target and taken."""
    found = source_mixing.mix(docs)
    return found.where(F.col(found.columns[-1]) > 0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark),
    ("mixing", mixture),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    since = mark()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs)
            sweep(spark, since, keep_last=True)
    return docs
