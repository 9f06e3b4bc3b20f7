"""Caches as tables: upserts, expiry, splits, and the replay of an LRU cache."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.text import chunks
from skeinflow.operators.sets import first_by, unchanged

TTL = 6 * 3600


def upsert(stored: DataFrame, new: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The newest row of each key; at equal times the new table's."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return first_by(both.withColumn("_age", -F.col(ts).cast("double")).withColumn("_old", -F.col("_new")), [key], "_age", "_old").drop("_new", "_old", "_age")


def latest(df: DataFrame, key: list[str], ts: str, *ties: str) -> DataFrame:
    """The newest row of each key; ties by the largest tie columns."""
    rest = [c for c in df.columns if c not in key]
    most = df.groupBy(*key).agg(F.max(F.struct(F.col(ts).alias("_ts"), *(F.col(t).alias(f"_t{i}") for i, t in enumerate(ties)), *(F.col(c).alias(f"_{c}_") for c in rest))).alias("_m"))
    return most.select(*key, *(F.col(f"_m._{c}_").alias(c) for c in rest)).select(*df.columns)


def delete(stored: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return stored.join(keys, key, "left_anti")


def is_expired(ts: Column, now: Column, ttl: float) -> Column:
    """Older than ttl seconds; ttl 0 never expires."""
    return F.lit(False) if ttl == 0 else (now.cast("double") - ts.cast("double")) > ttl


def valid_groups(rows: DataFrame, key: str | list[str], ts: str, now: Column, ttl: float = TTL) -> DataFrame:
    """Rows of keys whose newest row has not expired."""
    alive = rows.groupBy(key).agg(F.max(ts).alias("_m")).where(~is_expired(F.col("_m"), now, ttl)).select(key)
    return rows.join(alive, key, "left_semi")


def excluded(rows: DataFrame, key: str | list[str], ts: str, now: Column, ttl: float = TTL) -> DataFrame:
    """Keys with a row that is at most ttl seconds old."""
    return rows.groupBy(key).agg(F.max(ts).alias("_m")).where(~is_expired(F.col("_m"), now, ttl)).select(key)


def split(urls: DataFrame, cached: DataFrame, key: str = "url") -> DataFrame:
    """urls with cached: is there a valid row under the key."""
    return urls.join(cached.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left").withColumn("cached", F.coalesce("_hit", F.lit(False))).drop("_hit")


def page_chunks(pages: DataFrame, stored: DataFrame, url: str, text: str, ts: Column) -> DataFrame:
    """The page cache after a crawl: changed pages replace their chunks, unchanged ones keep theirs.

    Both tables (url, chunk_index, chunk, content_hash, ts, relevant).
    """
    changed = unchanged(pages, stored, url, F.col(text))
    fresh = changed.select(F.col(url), F.col("content_hash"), F.posexplode(chunks(F.col(text))).alias("chunk_index", "chunk"), ts.cast("double").alias("ts"), F.lit(None).cast("boolean").alias("relevant"))
    kept = stored.join(changed.select(url), url, "left_anti")
    return kept.unionByName(fresh.select(*kept.columns))


def mark_relevant(cache: DataFrame, decisions: DataFrame) -> DataFrame:
    """Chunks with the decisions' relevant flag where there is one."""
    new = decisions.select("url", "chunk_index", F.col("relevant").alias("_r"))
    return cache.join(new, ["url", "chunk_index"], "left").withColumn("relevant", F.coalesce("_r", "relevant")).drop("_r")


def exclusions_after(cache: DataFrame, excluded_urls: DataFrame, now: Column) -> DataFrame:
    """Pages without a relevant chunk become excluded, pages with one are no longer."""
    judged = cache.groupBy("url").agg(F.count_if(F.coalesce("relevant", F.lit(True))).alias("n"))
    rest = excluded_urls.join(judged, "url", "left_anti")
    return rest.unionByName(judged.where("n = 0").select("url", now.cast("double").alias("ts")))


def usable_chunks(cache: DataFrame, words: Column) -> DataFrame:
    """Relevant chunks that are no page furniture."""
    from skeinflow.functions.text import is_noise

    return cache.where(F.coalesce("relevant", F.lit(True)) & ~is_noise("chunk", words))


class LRU:
    """An LRU cache with expiry: a hit moves its key to the end and keeps its time; the oldest goes when a new key comes."""

    def __init__(self, size: int, ttl: float, entries: Iterable[tuple] = ()) -> None:
        self.size, self.ttl, self.entries = size, ttl, OrderedDict((k, (v, t)) for k, v, t in entries)

    def get(self, key, now: float):
        if key not in self.entries:
            return None
        value, ts = self.entries[key]
        if self.ttl and now - ts > self.ttl:
            del self.entries[key]
            return None
        self.entries.move_to_end(key)
        return value

    def put(self, key, value, now: float) -> None:
        if key in self.entries:
            self.entries.move_to_end(key)
        elif self.size and len(self.entries) >= self.size:
            self.entries.popitem(last=False)
        self.entries[key] = (value, now)


def replay(operations: DataFrame, size: int, ttl: float) -> DataFrame:
    """hit of every get in a log of operations (cache, ord, op get or put, key, value, ts), each cache replayed in order.

    A cache is one sequence, so its operations are one group; many caches are many groups.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cache, out = LRU(size, ttl), []
        for row in pdf.sort_values("ord").itertuples():
            if row.op == "put":
                cache.put(row.key, row.value, row.ts)
            else:
                value = cache.get(row.key, row.ts)
                out.append((row.cache, row.ord, row.key, value is not None, value))
        return pd.DataFrame(out, columns=["cache", "ord", "key", "hit", "value"])

    return operations.groupBy("cache").applyInPandas(run, "cache string, ord long, key string, hit boolean, value string")
