"""Filter cascades and decisions of models joined as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions import html as H
from skeinflow.functions import text as T
from skeinflow.functions import url as U
from skeinflow.functions.base import let

MIN_STRICT = 3
RELEVANCE_THRESHOLD = 0.6
BATCH = 10


def validate_urls(pages: DataFrame, query: str | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with reject_stage: domain, static, accessibility, keywords, or null where a page passes.

    Cheap stages first; a stage only sees what the ones before left. Anchors narrow the
    keyword stage unless they would leave fewer than three pages.
    """
    cheap = F.when(U.is_domain_excluded(url), "domain").when(~U.is_crawlable(url) | ~U.is_html(url), "static")
    wiki = F.lower(U.netloc(url)).contains("wikipedia.org")
    staged = pages.withColumn("reject_stage", F.when(cheap.isNotNull(), cheap).when(~wiki & ~F.coalesce(H.looks_like_html(html), F.lit(False)), "accessibility"))
    if not query:
        return staged
    words, anchors = T.preflight_keywords(F.lit(query)), T.anchor_keywords(F.lit(query))
    # the page's text is made once, and only of pages that got this far
    text = F.concat(H.title(html), F.lit(" "), H.body_text(html))
    found = lambda t, keywords: F.coalesce(F.exists(keywords, lambda k: F.contains(t, k)), F.lit(False)) | (F.size(keywords) == 0)
    looked = F.when(wiki, F.struct(F.lit(True).alias("general"), F.lit(True).alias("strict"))).otherwise(let(text, lambda t: F.struct(found(t, words).alias("general"), (found(t, words) & found(t, anchors)).alias("strict"))))
    marked = staged.withColumn("_found", F.when(F.col("reject_stage").isNull(), looked))
    # one number of the whole, as a scalar subquery: no window gathers the rows
    enough = marked.agg(F.count_if("_found.strict") >= MIN_STRICT).scalar()
    passes = F.when(enough, F.col("_found.strict")).otherwise(F.col("_found.general"))
    return marked.withColumn("reject_stage", F.when(F.col("reject_stage").isNull() & ~passes, "keywords").otherwise(F.col("reject_stage"))).drop("_found")


def numbered_batches(df: DataFrame, order: list[str], size: int = BATCH, name: str = "batch") -> DataFrame:
    """Rows in batches of ``size``, in order.

    Ranks come from counts of range partitions, so the order is total without one task
    that sorts everything.
    """
    return ordinal(df, order, "_n").withColumn(name, F.floor(F.col("_n") / size)).drop("_n")


def ordinal(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rank of every row in a total order, from 0: range partitions are ranked alone and shifted by their counts."""
    from skeinflow.sources.storage import materialise

    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = materialise(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy("_part").count()
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_part", "_own", "_before")


def decide(items: DataFrame, decisions: DataFrame, key: str, default: str = "KEEP", failed: str = "failed") -> DataFrame:
    """Items with decision: a model's answer; the default where the item's whole batch failed; else REJECT.

    ``items`` has the column batch; ``decisions`` has key, decision and, with key null, failed batches.
    """
    answers = decisions.where(F.col(key).isNotNull()).select(key, "decision").dropDuplicates([key])
    broken = decisions.where(F.col(failed)).select("batch").distinct().withColumn("_broken", F.lit(True))
    joined = items.join(answers, key, "left").join(broken, "batch", "left")
    return joined.withColumn("decision", F.when(F.col("_broken"), default).otherwise(F.coalesce("decision", F.lit("REJECT")))).drop("_broken")


def refill(items: DataFrame, order: str, minimum: int) -> DataFrame:
    """Kept items, and as many of the first rejected ones as ``minimum`` asks for, flagged as refilled."""
    need = items.where("decision = 'KEEP'").agg((F.lit(minimum) - F.count("*")).alias("n")).scalar()
    rejects = items.where("decision <> 'KEEP'").orderBy(order).limit(minimum)
    ranked = rejects.withColumn("_r", F.row_number().over(Window.orderBy(order)))
    more = ranked.where(F.col("_r") <= need).drop("_r")
    return items.where("decision = 'KEEP'").withColumn("refilled", F.lit(False)).unionByName(more.withColumn("refilled", F.lit(True)))


def relevance(items: DataFrame, relevant: Column, tokens: Column, by: list[str] | None = None) -> DataFrame:
    """Share of relevant tokens (1 where there are none) and whether that is enough."""
    groups = items.groupBy(*(by or []))
    total = F.sum(tokens)
    ratio = F.when(F.coalesce(total, F.lit(0)) == 0, 1.0).otherwise(F.coalesce(F.sum(F.when(relevant, tokens)), F.lit(0)) / total)
    return groups.agg(F.coalesce(total, F.lit(0)).cast("long").alias("total_tokens"), F.round(ratio, 6).alias("ratio"), (ratio >= RELEVANCE_THRESHOLD).alias("enough"))


def semantic_or_all(chosen: DataFrame, everything: DataFrame, least: int = 2) -> DataFrame:
    """The chosen rows if there are at least two, else all rows."""
    n = chosen.agg(F.count("*")).scalar()
    return chosen.where(n >= least).unionByName(everything.where(n < least))


def frequent_domain(pages: DataFrame, url: str = "url") -> DataFrame:
    """Pages a domain; of equal counts the first in the alphabet comes first."""
    return pages.select(U.netloc(url).alias("domain")).where("domain <> ''").groupBy("domain").agg(F.count("*").alias("n"))


def research_mode(pages: DataFrame, url: str = "url") -> DataFrame:
    """One row: the crawl mode that suits a set of URLs."""
    total = pages.agg(F.count("*").alias("urls"), F.count_if(U.has_slug(url)).alias("slugs"))
    top = frequent_domain(pages, url).agg(F.max(F.struct("n", F.col("domain"))).alias("t")).select(F.col("t.n").alias("n"), F.col("t.domain").alias("domain"))
    from skeinflow.functions.base import contains_any

    both = total.withColumn("k", F.lit(1)).join(F.broadcast(top.withColumn("k", F.lit(1))), "k", "left")
    mode = (
        F.when((F.col("urls") == 0) | F.col("domain").isNull(), "pseudo_adaptive")
        .when((F.col("n") > 0.5 * F.col("urls")) & contains_any(F.col("domain"), U.KNOWLEDGE_DOMAINS), "bfs_deep")
        .when(F.col("slugs") > 0.5 * F.col("urls"), "pseudo_adaptive")
        .otherwise("research_filter")
    )
    return both.select("urls", "slugs", mode.alias("mode"))
