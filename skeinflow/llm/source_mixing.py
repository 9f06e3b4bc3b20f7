"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources, in code point order with null last, weigh 1, 2, 3, 1, 2, 3, ... and share the
corpus's words by weight; a target stops at three times its source's words and the
excess is shared again, which is water-filling. Blocks of equal size are dealt to sources
by highest quotients target / (2k + 1), and each source's blocks to its shards likewise
by their words, giving an integer quota for every (source, shard). Within a shard the
documents stand in a seeded order; the quota takes the first blocks of that order, in
whole passes and a rest, so a document is taken at most three times and the last one of a
rest in part.

Shards hold about ``shard_docs`` documents by a hash, so a source with a third of all rows is
many groups. Quotients are only made in the range that a quota can have, about five rows
a unit.

Defined results: null and empty texts have size 0 and are taken 0 words; repeated rows
are each documents of their own; null is a source; an empty table gives an empty result;
further columns pass through.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.llm._shared import SEPARATORS, unused

WEIGHTS = (1, 2, 3)
#: A target is at most so many times its source; so is what is taken of a document.
CAP = 3
#: Words of a block.
BLOCK = 64
#: Documents that a shard should hold.
SHARD_DOCS = 1000
#: Shards at most, as one task sorts those of a source; beyond, shards hold more documents.
MAX_SHARDS = 1 << 20
SEED = "mix-1"


def apportion(units: DataFrame, group: list[str], weight: str, seats: str, key: list[str], name: str) -> DataFrame:
    """``units`` with ``name``: the seats of each group, dealt to its units by Sainte-Lague; ties by ``key``."""
    of = Window.partitionBy(*group)
    total, n = F.sum(weight).over(of), F.count("*").over(of)
    quota = F.when(total > 0, F.col(seats) * F.col(weight) / total).otherwise(0.0)
    slack = F.when(F.col(seats) > 0, quota * n / F.col(seats)).otherwise(0.0)
    low = F.greatest(F.lit(0).cast("long"), F.floor(quota - 1 - slack))
    high = F.when(quota > 0, F.ceil(quota + 1 + slack)).otherwise(F.lit(0)).cast("long")
    ranged = units.withColumns({"_low": low, "_high": high})
    ranged = ranged.withColumn("_left", F.col(seats) - F.sum("_low").over(of))
    tried = ranged.withColumn("_k", F.explode(F.sequence("_low", "_high")))
    best = Window.partitionBy(*group).orderBy((F.col(weight) / (2 * F.col("_k") + 1)).desc(), *(F.col(k).asc_nulls_last() for k in key), "_k")
    tried = tried.withColumn("_won", ((F.row_number().over(best) <= F.col("_left")) & (F.col(weight) > 0)).cast("long"))
    own = units.columns
    return tried.groupBy(*own).agg((F.min("_low") + F.sum("_won")).alias(name))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources (source, source_size) with target, by water-filling; one row a source, so one task is enough."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    listed = sources.withColumn("_w", F.array(*map(F.lit, weights))[(F.row_number().over(order) - 1) % len(weights)])
    fill = Window.orderBy((cap * F.col("source_size") / F.col("_w")), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    from_here = fill.rowsBetween(0, Window.unboundedFollowing)
    all_rows = Window.partitionBy()
    capped = F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))
    level = (F.sum("source_size").over(all_rows) - capped) / F.sum("_w").over(from_here)
    listed = listed.withColumns({"_level": level, "_at": F.row_number().over(fill)})
    fits = F.when(F.col("_level") * F.col("_w") <= cap * F.col("source_size"), F.struct("_at", "_level"))
    listed = listed.withColumn("_found", F.min(fits).over(all_rows))
    return listed.select("source", "source_size", F.least(F.col("_found._level") * F.col("_w"), (cap * F.col("source_size")).cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, shard_docs: int = SHARD_DOCS, seed: str = SEED) -> DataFrame:
    """``docs`` with size, source_size, target (of the source) and taken: the words that the mix takes of the document."""
    size, source_size, target, taken = unused(docs, "size", "source_size", "target", "taken")
    shard, order, own_source, start, quota, shard_size, shard_of = unused(docs, "m_shard", "m_order", "m_source", "m_start", "m_quota", "m_words", "m_shard_of")
    shards = min(MAX_SHARDS, max(1, -(-docs.count() // shard_docs)))
    digest = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))).cast("binary"))
    sized = docs.withColumns(
        {
            size: F.coalesce(F.regexp_count("text", F.lit(f"[^{SEPARATORS}]+")), F.lit(0)).cast("long"),
            shard: F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % shards,
            order: digest,
        }
    )
    parts = sized.groupBy("source", shard).agg(F.sum(size).alias("words")).withColumnRenamed(shard, "shard")
    sources = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    sources = sources.withColumn("_all", F.ceil(F.sum("source_size").over(Window.partitionBy()) / block))
    sources = apportion(sources, [], "target", "_all", ["source"], "_blocks")
    named = sources.withColumnRenamed("source", "_source")
    parts = parts.join(named, parts["source"].eqNullSafe(named["_source"])).drop("_source", "_all")
    parts = apportion(parts, ["source"], "words", "_blocks", ["shard"], "_quota")
    few = parts.select(F.col("source").alias(own_source), F.col("shard").alias(shard_of), F.col("source_size").alias(source_size), F.col("target").alias(target), F.col("words").alias(shard_size), F.least(F.col("_quota") * block, cap * F.col("words")).alias(quota))
    joined = sized.join(few, sized["source"].eqNullSafe(few[own_source]) & (sized[shard] == few[shard_of]))
    place = Window.partitionBy("source", shard).orderBy(order, size).rowsBetween(Window.unboundedPreceding, -1)
    joined = joined.withColumn(start, F.coalesce(F.sum(size).over(place), F.lit(0)))
    passes = F.when(F.col(shard_size) > 0, F.floor(F.col(quota) / F.col(shard_size))).otherwise(0)
    rest = F.col(quota) - passes * F.col(shard_size)
    part = F.least(F.greatest(rest - F.col(start), F.lit(0)), F.col(size))
    words = (passes * F.col(size) + part).cast("long")
    return joined.select(*(sized[f"`{c}`"] for c in docs.columns), F.col(size), F.col(source_size), F.col(target), words.alias(taken))


def reference(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> dict[str | None, float]:
    """Targets by repeated sharing of the excess, for tests."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target = dict.fromkeys(order, Fraction(0))
    free, left = set(order), Fraction(sum(sizes.values()))
    while left > 0 and free:
        unit = left / sum(weight[s] for s in free)
        left = Fraction(0)
        for s in sorted(free, key=order.index):
            target[s] += unit * weight[s]
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = Fraction(cap * sizes[s])
                free.discard(s)
    return {s: float(t) for s, t in target.items()}


def sainte_lague(weights: list[float], seats: int) -> list[int]:
    """Seats dealt one at a time, for tests; ties go to the first."""
    out = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out
