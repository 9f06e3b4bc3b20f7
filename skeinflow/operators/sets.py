"""Unions, dedup and joins by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions import url as U
from skeinflow.sources.storage import materialise


def first_by(df: DataFrame, key: list[str], *order: str) -> DataFrame:
    """The first row of each key. An aggregation, so a frequent key is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    ranked = F.struct(*(F.col(c) for c in order), *(F.col(c).alias(f"_{c}") for c in rest))
    least = df.groupBy(*key).agg(F.min(ranked).alias("_r"))
    return least.select(*key, *(F.col(f"_r._{c}").alias(c) for c in rest)).select(*df.columns)


def union_first(tables: list[DataFrame], key: str, *order: str) -> DataFrame:
    """Rows of all tables, one a key; earlier tables first."""
    whole = None
    for i, df in enumerate(tables):
        df = df.withColumn("_table", F.lit(i))
        whole = df if whole is None else whole.unionByName(df)
    return first_by(whole, [key], "_table", *order).drop("_table")


def wikipedia_once(results: DataFrame, language: str = "en", url: str = "url", order: str = "ord") -> DataFrame:
    """One result an article, in the user's language if there is one, else the first; others untouched.

    position tells the order: other results first, then articles as they first appeared.
    """
    title, lang = U.wikipedia_title(url), U.wikipedia_language(url)
    marked = results.withColumns({"_title": F.when(title != "", title), "_lang": lang})
    other = marked.where("_title is null").drop("_title", "_lang").withColumn("position", F.struct(F.lit(0).alias("kind"), F.col(order).alias("ord")))
    rank = F.struct((F.col("_lang") != language).alias("foreign"), F.col(order).alias("o"))
    own = [c for c in results.columns]
    best = marked.where("_title is not null").groupBy("_title").agg(F.min_by(F.struct(*own), rank).alias("r"), F.min(order).alias("first"))
    best = best.select("r.*", F.struct(F.lit(1).alias("kind"), F.col("first").alias("ord")).alias("position"))
    return other.unionByName(best)


def media_once(media: DataFrame, url: str = "url", order: str = "ord") -> DataFrame:
    """The first of media that differ only in their query."""
    keyed = media.withColumn("media_key", U.media_key(url))
    return first_by(keyed, ["media_key"], order)


def greedy_independent(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Keep a node unless a smaller kept node is its neighbour: what a loop in key order would keep.

    ``edges`` (a, b), a < b. Each round keeps undecided nodes without undecided smaller
    neighbours and drops the neighbours of kept ones. Rounds are as many as the longest chain of
    ever larger neighbours, about the logarithm of the nodes when keys are in random order, and up
    to half the nodes of a path that is in key order.
    """
    undecided = materialise(nodes.select(F.col(key).alias("n")))
    live, kept = materialise(edges.select("a", "b").distinct()), None
    while True:
        blocked = live.select(F.col("b").alias("n")).distinct()
        new = materialise(undecided.join(blocked, "n", "left_anti"))
        kept = new if kept is None else kept.union(new)
        gone = live.join(new.withColumnRenamed("n", "a"), "a", "left_semi").select(F.col("b").alias("n")).distinct()
        undecided = materialise(undecided.join(new, "n", "left_anti").join(gone, "n", "left_anti"))
        if undecided.isEmpty():
            return nodes.join(kept.withColumnRenamed("n", key), key, "left_semi")
        open_ = undecided.withColumnRenamed("n", "a")
        live = materialise(live.join(open_, "a", "left_semi").join(open_.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b"))


def unchanged(new: DataFrame, stored: DataFrame, key: str, text: Column) -> DataFrame:
    """Rows of ``new`` whose content hash is not stored under their key."""
    hashed = new.withColumn("content_hash", F.sha2(text.cast("binary"), 256))
    return hashed.join(stored.select(key, "content_hash").distinct(), [key, "content_hash"], "left_anti")


def earlier_copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """``df`` with content_hash and copy_of: the first row of equal content, null for that row."""
    hashed = df.withColumn("content_hash", F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    first = hashed.groupBy("content_hash").agg(F.min(key).alias("_first"))
    return hashed.join(first, "content_hash").withColumn("copy_of", F.when(F.col("_first") < F.col(key), F.col("_first"))).drop("_first")


def zip_positions(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Rows of both tables at the same position; the shorter one ends it."""
    return left.join(right, on, "inner")


def titled(urls: DataFrame, titles: DataFrame, key: str = "url") -> DataFrame:
    return urls.join(titles, key, "left").withColumn("title", F.coalesce("title", F.lit("N/A")))
