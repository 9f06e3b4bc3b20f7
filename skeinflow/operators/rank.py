"""Ranking, budgets and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.sources.storage import materialise

MAX_TOKENS, ALPHA, MIN_PAGE = 4000, 0.7, 700


def token_budget(index: Column | str, max_tokens: int = MAX_TOKENS, alpha: float = ALPHA, least: int = MIN_PAGE) -> Column:
    """Tokens of the index-th page, decaying; null below the minimum; unlimited (0) where there is no limit."""
    if max_tokens <= 0:
        return F.lit(0)
    index = F.col(index) if isinstance(index, str) else index
    budget = F.floor(F.lit(float(max_tokens)) / F.greatest(F.lit(1.0), F.pow(index.cast("double"), F.lit(alpha)))).cast("int")
    return F.when(budget >= least, budget)


def top_k(df: DataFrame, k: int, score: Column, *ties: str) -> DataFrame:
    """The k best rows; null scores last."""
    return df.withColumn("_s", score).orderBy(F.col("_s").desc_nulls_last(), *ties).limit(k).drop("_s")


def top_k_by(df: DataFrame, group: list[str], k: int, score: str, *ties: str) -> DataFrame:
    """The k best rows of each group, with rank from 1; Spark prunes each map task to k rows a group."""
    window = Window.partitionBy(*group).orderBy(F.col(score).desc_nulls_last(), *ties)
    return df.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def within_budget(df: DataFrame, order: list[str], tokens: str, limit: int) -> DataFrame:
    """Rows in order until their tokens reach the limit; the row that crosses it stays; with used_before.

    Sums of range partitions are carried over, so no task sees all rows, and only partitions
    that begin within the limit are sorted.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialise(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy("_part").agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    near = dealt.join(F.broadcast(before.where(F.col("_before") < limit)), "_part")  # one row a partition at most
    own = F.coalesce(F.sum(tokens).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return near.withColumn("used_before", (F.col("_before") + own).cast("long")).where(F.col("used_before") < limit).drop("_part", "_before")


def batches_within_budget(df: DataFrame, batch: str, tokens: str, limit: int) -> DataFrame:
    """Whole batches in order until their tokens reach the limit; the batch that crosses it stays. Batches are numbers, one row each when summed."""
    sums = df.groupBy(F.col(batch).alias("_b")).agg(F.coalesce(F.sum(tokens), F.lit(0)).cast("long").alias("_t"))
    placed = within_budget(sums, ["_b"], "_t", limit)
    return df.join(placed.select(F.col("_b").alias(batch), "used_before"), batch)


def user_first(df: DataFrame, is_user: str, order: str, limit: int) -> DataFrame:
    """At most ``limit`` rows (0: all), the user's before others."""
    ordered = df.orderBy(F.col(is_user).desc(), order)
    return ordered.limit(limit) if limit else ordered


def media_markdown(media: DataFrame, proxy: str, size: int, limit: int = 5) -> DataFrame:
    """One row of Markdown thumbnails of the first media (0: of all)."""
    from skeinflow.functions.url import thumbnail

    first = media.orderBy("ord").limit(limit) if limit else media
    line = F.concat(F.lit("[!["), F.col("title"), F.lit("]("), thumbnail("url", proxy, size), F.lit(")]("), F.col("url"), F.lit(")"))
    rows = first.agg(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))).alias("r"))
    return rows.select(F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("markdown"))
