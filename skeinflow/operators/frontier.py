"""Crawl strategies over a link graph (src, dst, ord), level by level."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skeinflow.functions import text as T
from skeinflow.functions import url as U
from skeinflow.operators.sets import first_by
from skeinflow.sources.storage import materialise

MAX_DEPTH = 2


def same_host(links: DataFrame, base: str, url: str = "dst") -> DataFrame:
    return links.where(F.lower(U.netloc(url)) == urlsplit(base).netloc.lower())


def bfs_levels(edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, host: str | None = None) -> DataFrame:
    """(url, depth) of what breadth-first search reaches; each level is one join with what is not yet visited."""
    level = first_by(starts.select(F.col("url"), F.lit(0).alias("depth")), ["url"], "depth")
    seen = level = materialise(level)
    for depth in range(1, max_depth + 1):
        out = edges.join(level.select(F.col("url").alias("src")), "src", "left_semi")
        if host:
            out = same_host(out, host)
        level = materialise(out.select(F.col("dst").alias("url")).distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)))
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def crawl_in_batches(spark: SparkSession, edges: DataFrame, starts: list[str], query: str, tokens: DataFrame, batch: int = 5, max_depth: int = MAX_DEPTH, max_pages: int = 20, max_tokens: int = 0, host: str | None = None, links_a_page: int | None = None, scored_only: bool = True) -> DataFrame:
    """(url, depth, score, step) in the order of a first-in-first-out frontier, ``batch`` pages a step, best scores first in a step.

    Stops when the frontier is empty or pages or tokens are used up. The frontier that the
    driver holds is bounded by ``max_pages`` times the links that a page may add; links and pages stay in tables.
    """
    queue = [(u, 0, 0) for u in dict.fromkeys(starts)]
    queued, done, used, step = set(starts), [], 0, 0
    score = T.keyword_score("dst", F.lit(query))
    while queue and len(done) < max_pages and (not max_tokens or used < max_tokens):
        taken, queue = queue[:batch], queue[batch:]
        taken = sorted(taken, key=lambda x: -x[2])[: max_pages - len(done)]
        taken = [x for x in taken if x[1] <= max_depth]
        if not taken:
            continue
        done += [(*x, step) for x in taken]
        step += 1
        urls = [x[0] for x in taken]
        cost = tokens.where(F.col("url").isin(urls)).agg(F.sum("tokens")).first()[0]
        used += cost or 0
        out = edges.where(F.col("src").isin(urls))
        out = same_host(out, host) if host else out
        out = out.withColumn("score", score)
        out = out.where("score > 0") if scored_only else out
        if links_a_page:
            best = Window.partitionBy("src").orderBy(F.col("score").desc(), "ord")
            out = out.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= links_a_page)
        depth = {x[0]: x[1] for x in taken}
        place = {u: i for i, u in enumerate(urls)}
        for row in sorted(out.select("src", "dst", "ord", "score").collect(), key=lambda r: (place[r["src"]], r["ord"])):
            if row["dst"] not in queued:
                queued.add(row["dst"])
                queue.append((row["dst"], depth[row["src"]] + 1, row["score"]))
    return spark.createDataFrame(done, "url string, depth int, score int, step int")


def pseudo_adaptive(spark: SparkSession, edges: DataFrame, starts: list[str], query: str, tokens: DataFrame, **options) -> DataFrame:
    """Batches of five, links with a keyword only."""
    return crawl_in_batches(spark, edges, starts, query, tokens, **options)


def guided(spark: SparkSession, edges: DataFrame, starts: list[str], query: str, tokens: DataFrame, external: bool = False, **options) -> DataFrame:
    """One page at a time, its three best links, on the start's host unless external."""
    host = None if external or not starts else starts[0]
    return crawl_in_batches(spark, edges, starts, query, tokens, batch=1, links_a_page=3, host=host, **options)


def bfs_deep(spark: SparkSession, edges: DataFrame, starts: list[str], query: str, tokens: DataFrame, external: bool = False, **options) -> DataFrame:
    """Levels of the start's host within budgets, whatever links say."""
    host = None if external or not starts else starts[0]
    return crawl_in_batches(spark, edges, starts, query, tokens, host=host, scored_only=False, **options)


def two_levels(edges: DataFrame, starts: DataFrame, query: str, first: int = 15, best: int = 3) -> DataFrame:
    """(source, url, score) of each start's best links of its host among its first ones; two joins, no loop."""
    own = edges.join(starts.select(F.col("url").alias("src")), "src", "left_semi")
    order = Window.partitionBy("src").orderBy("ord")
    early = own.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= first)
    scored = early.withColumn("score", T.keyword_score("dst", F.lit(query))).where("score > 0").where(F.lower(U.netloc("src")) == F.lower(U.netloc("dst")))
    ranked = scored.withColumn("_r", F.row_number().over(Window.partitionBy("src").orderBy(F.col("score").desc(), "ord"))).where(F.col("_r") <= best)
    return ranked.select(F.col("src").alias("source"), F.col("dst").alias("url"), "score")


def research_filter(spark: SparkSession, edges: DataFrame, starts: list[str], query: str, tokens: DataFrame, max_pages: int = 20, **_) -> DataFrame:
    """The starts, and of each its best links; sorted by how many words of the query their URLs hold."""
    own = spark.createDataFrame([(u,) for u in dict.fromkeys(starts)], "url string")
    found = two_levels(edges, own, query).groupBy("url").agg(F.max("score").alias("score")).join(own, "url", "left_anti")
    both = own.select("url", F.lit(0).alias("depth"), T.keyword_score("url", F.lit(query)).alias("score")).unionByName(found.select("url", F.lit(1).alias("depth"), "score"))
    return both.orderBy(F.col("score").desc(), "depth", "url").limit(max_pages).withColumn("step", F.col("depth"))


#: The strategies by name; unknown names mean the first.
MODES = {"pseudo_adaptive": pseudo_adaptive, "llm_guided": guided, "bfs_deep": bfs_deep, "research_filter": research_filter}


def crawl(mode: str, *args, **options) -> DataFrame:
    return MODES.get(mode, pseudo_adaptive)(*args, **options)


def refine(search, crawl_, judge, query: str, rounds: int = 3, key: str = "url") -> DataFrame:
    """Search, crawl and judge until there is enough: ``search(query)`` gives (key), ``crawl_(keys)`` their content,
    ``judge(content)`` (enough, next query). Keys, URLs or records of them, are visited once, content accumulates."""
    content = visited = None
    for _ in range(rounds):
        found = search(query)
        if visited is not None:
            found = found.join(visited, key, "left_anti")
        found = materialise(found.select(key).distinct())
        new = materialise(crawl_(found))
        visited = found if visited is None else visited.union(found)
        content = new if content is None else content.unionByName(new)
        enough, query = judge(content)
        if enough:
            break
    return content
