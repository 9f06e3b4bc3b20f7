"""Compressing conversations by age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions import text as T

RECENT, OLD, INDEXED, LOOKBACK, LEAST_TOKENS = 0.75, 0.40, 0.20, 4, 300


def tiers(turns: DataFrame, indexed_names: DataFrame | None = None, lookback: int = LOOKBACK) -> DataFrame:
    """turns (conv_id, turn, role, text) with tier: current, recent, old_indexed or old; null for other roles.

    ``indexed_names`` (conv_id, names): names whose code can be had elsewhere.
    """
    spoken = F.col("role").isin("user", "assistant")
    order = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("conv_id")
    out = turns.withColumns({"pos": F.when(spoken, F.sum(spoken.cast("int")).over(order) - 1), "_last": F.sum(spoken.cast("int")).over(whole) - 1})
    names = F.array_distinct(F.flatten(F.transform(F.filter(T.segments("text"), lambda s: s["kind"] == "code"), lambda s: T.defined_names(s["text"]))))
    if indexed_names is not None:
        out = out.join(indexed_names.withColumnRenamed("names", "_names"), "conv_id", "left")
        known = (F.size(names) > 0) & (F.size(F.array_except(names, F.coalesce("_names", F.array().cast("array<string>")))) == 0)
    else:
        known = F.lit(False)
    distance = F.col("_last") - F.col("pos")
    tier = F.when(F.col("pos").isNull(), F.lit(None)).when(distance <= 0, "current").when(distance <= lookback, "recent").when(known, "old_indexed").otherwise("old")
    return out.withColumn("tier", tier).drop("_last", "_names")


def is_compressible(least: int = LEAST_TOKENS) -> Column:
    """Old enough, long enough, and neither protocol nor error output."""
    return (F.col("tier").isin("recent", "old", "old_indexed") & (F.coalesce("text", F.lit("")) != "") & ~T.has_marker("text") & ~T.is_traceback("text") & (T.estimate_tokens("text") >= least)) & F.col("tier").isNotNull()


def compress(turns: DataFrame, indexed_names: DataFrame | None = None, prose=T.compress_prose, least: int = LEAST_TOKENS) -> DataFrame:
    """turns with tier and compressed: prose shortened by tier, code kept, or stubbed where all its names are indexed."""
    tiered = tiers(turns, indexed_names)
    rate = F.when(F.col("tier") == "recent", RECENT).when(F.col("tier") == "old", OLD).otherwise(INDEXED)

    def part(s):
        fenced = F.concat(F.lit("```"), s["lang"], F.lit("\n"), s["text"], F.lit("\n```"))
        code = F.when(F.col("tier") == "old_indexed", T.code_stub(s["text"], s["lang"])).otherwise(fenced)
        return F.when(F.trim(s["text"], F.lit(" \t\r\n")) == "", s["text"]).when(s["kind"] == "text", prose(s["text"], rate)).otherwise(code)

    new = F.array_join(F.transform(T.segments("text"), part), "")
    return tiered.withColumn("compressed", F.when(F.coalesce(is_compressible(least), F.lit(False)), new).otherwise(F.col("text")))


def compress_by_model(turns: DataFrame, scorer, indexed_names: DataFrame | None = None, least: int = LEAST_TOKENS) -> DataFrame:
    """``compress`` with a compressor that is a scorer of texts "rate" newline "text" (``sources.tables.map_scored``); prose that it fails on stays as it is."""
    from skeinflow.sources.tables import map_scored

    native = compress(turns, indexed_names, prose=lambda text, rate: text, least=least)  # code stubbed, prose as it was
    rate = F.when(F.col("tier") == "recent", RECENT).when(F.col("tier") == "old", OLD).otherwise(INDEXED)
    able = F.coalesce(is_compressible(least), F.lit(False))
    marked = native.withColumn("_able", able).withColumn("_rate", rate)
    parts = marked.where("_able").select("conv_id", "turn", "_rate", F.posexplode(T.segments("compressed")).alias("_i", "_s"))
    prose = parts.where((F.col("_s.kind") == "text") & (F.trim("_s.text", F.lit(" \t\r\n")) != "")).withColumn("_prompt", F.concat(F.col("_rate").cast("string"), F.lit("\n"), "_s.text"))
    short = map_scored(prose.drop("_s"), scorer, "_prompt", "_short").select("conv_id", "turn", "_i", "_short")
    fenced = F.concat(F.lit("```"), "_s.lang", F.lit("\n"), "_s.text", F.lit("\n```"))
    text = F.when(F.col("_s.kind") == "code", fenced).otherwise(F.coalesce("_short", "_s.text"))
    joined = parts.join(short, ["conv_id", "turn", "_i"], "left").groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct("_i", text.alias("t")))).alias("_parts"))
    return marked.join(joined, ["conv_id", "turn"], "left").withColumn("compressed", F.when(F.col("_able"), F.array_join(F.col("_parts.t"), "")).otherwise(F.col("compressed"))).drop("_able", "_rate", "_parts")
