"""Operators that ask a model: a prompt column, a scorer, a parser, a default.

A scorer is a function from a list of prompts to a list of answers (None where there is
none), run by ``sources.tables.map_scored``. Rows are numbered within batches, a batch is
one prompt, and an answer that can't be read gives every row of the batch its default.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions import json as J
from skeinflow.functions import text as T
from skeinflow.functions import url as U
from skeinflow.functions.base import col
from skeinflow.operators.filters import decide, ordinal
from skeinflow.sources.tables import map_scored

Scorer = Callable[[list[str]], list[str | None]]

FRAGMENT_CHARS, ITEM_CHARS = 500, 300


def numbered(texts: Column, chars: int) -> Column:
    """Lines "0: text", "1: text", ... of an array, each cut and on one line."""
    line = lambda x, i: F.concat(i.cast("string"), F.lit(": "), F.left(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "), F.lit(chars)))
    return F.array_join(F.transform(texts, line), "\n")


def ask(batches: DataFrame, task: str, items: Column, chars: int, scorer: Scorer, out: str = "response") -> DataFrame:
    """``batches`` with a model's answer about the numbered items of each row."""
    prompt = F.concat(F.lit(f"{task}\n\n"), numbered(items, chars), F.lit("\n\nAnswer:"))
    return map_scored(batches.withColumn("_prompt", prompt), scorer, "_prompt", out).drop("_prompt")


def batched(items: DataFrame, by: list[str], order: str, text: str, size: int) -> DataFrame:
    """(by, batch, rows): arrays of (ord, text) of the rows of each group, in order, ``size`` a batch.

    A batch is what a total order of all rows and the group's first place in it tell, so no task gathers a whole group.
    """
    placed = ordinal(items.select(*by, F.col(order).alias("ord"), F.col(text).alias("text")), [*by, "ord"], "_n")
    first = placed.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.min("_n").alias("_first"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    told = placed.join(first, same).withColumn("batch", F.floor((F.col("_n") - F.col("_first")) / size).cast("int"))
    return told.groupBy(*by, "batch").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("rows"))


def whole(items: DataFrame, by: list[str], order: str, text: str) -> DataFrame:
    """(by, rows): one array for each group, which must be as small as a prompt."""
    return items.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), F.col(text).alias("text")))).alias("rows"))


def flag_chunks(chunks: DataFrame, scorer: Scorer) -> DataFrame:
    """(url, chunk_index, relevant): a model's flag for each chunk of a page; all true where the answer can't be read."""
    pages = whole(chunks, ["url"], "chunk_index", "chunk")  # a page is one prompt
    asked = ask(pages, "Which of these fragments of a web page inform, and are no navigation, advertising or notices? A JSON array of booleans, one a fragment.", F.col("rows.text"), FRAGMENT_CHARS, scorer)
    flags = asked.withColumn("flags", J.parse_flags("response", F.size("rows")))
    return flags.select("url", F.inline(F.arrays_zip(F.col("rows.ord").alias("chunk_index"), F.col("flags").alias("relevant")))).toDF("url", "chunk_index", "relevant")


def judge_relevance(items: DataFrame, by: list[str], order: str, text: str, query: Column, scorer: Scorer, size: int = 10) -> DataFrame:
    """(by, ord, relevant): RELEVANT or NOISE of every item, ``size`` a prompt; all RELEVANT where an answer has another length."""
    rows = batched(items, by, order, text, size)
    task = "Is each of these texts RELEVANT to the query of the user, or NOISE? A JSON array of these two words, one a text."
    prompt = F.concat(F.lit(f"{task}\nQuery: "), query, F.lit("\n\n"), numbered(F.col("rows.text"), ITEM_CHARS), F.lit("\n\nAnswer:"))
    asked = map_scored(rows.withColumn("_prompt", prompt), scorer, "_prompt")
    words = J.parse_strings("response")
    told = asked.withColumn("words", words).withColumn("flags", F.when(F.size("words") == F.size("rows"), F.transform("words", lambda w: F.upper(F.trim(w)) == "RELEVANT")).otherwise(F.array_repeat(F.lit(True), F.size("rows"))))
    return told.select(*by, F.inline(F.arrays_zip(F.col("rows.ord").alias("ord"), F.col("flags").alias("relevant")))).toDF(*by, "ord", "relevant")


def keep_urls(results: DataFrame, titles: DataFrame, phrases: Column, query: str, scorer: Scorer, order: str = "ord", size: int = 10) -> DataFrame:
    """Results (url, ord) with title, batch and decision: those whose slug has a homonym are REJECTed unasked; the model names the numbers to keep.

    Numbers that it does not name are rejected, numbers out of range ignored; a failed batch is kept.
    """
    named = results.join(titles.select("url", "title"), "url", "left").withColumn("title", F.coalesce("title", F.lit("N/A")))
    named = named.withColumn("homonym", F.coalesce(U.mentions("url", phrases), F.lit(False)))
    rows = batched(named.where("not homonym").withColumn("_k", F.lit(0)).withColumn("_line", F.concat_ws(" | ", "title", "url")), ["_k"], order, "_line", size)
    asked = ask(rows, f"Which of these pages are worth reading for: {query}? A JSON array of their numbers.", F.col("rows.text"), ITEM_CHARS, scorer)
    numbers = F.from_json(J.find_array("response"), "array<int>")
    told = asked.select("batch", F.col("rows.ord").alias("ords"), numbers.alias("numbers"))
    members = told.select("batch", F.col("numbers").isNull().alias("failed"), F.posexplode("ords").alias("place", order), "numbers")
    answers = members.where("not failed").select(order, F.when(F.array_contains("numbers", F.col("place")), "KEEP").otherwise("REJECT").alias("decision"), F.lit(False).alias("failed"), F.lit(None).cast("int").alias("batch"))
    broken = members.where("failed").select(F.lit(None).cast(named.schema[order].dataType).alias(order), F.lit(None).cast("string").alias("decision"), "failed", "batch").distinct()
    # a homonym has no batch and no answer, so it is rejected
    return decide(named.join(members.select(order, "batch"), order, "left"), answers.unionByName(broken), order).drop("homonym")


def expand_queries(queries: DataFrame, scorer: Scorer, query: str = "query", limit: int = 5) -> DataFrame:
    """``queries`` with queries: the query and what the model adds, and homonyms: what its comment tells to avoid."""
    prompt = F.concat(F.lit(f"At most {limit} other search queries for the one below, as a JSON array; then a comment line '// Homonyms to avoid: ...'.\n"), col(query))
    asked = map_scored(queries.withColumn("_prompt", prompt), scorer, "_prompt", "_reply")
    found = asked.withColumn("queries", J.expansions(query, J.parse_strings("_reply"), limit)).withColumn("homonyms", F.coalesce(J.homonyms("_reply"), F.array().cast("array<string>")))
    return found.drop("_prompt", "_reply")


def reformulate(queries: DataFrame, scorer: Scorer, query: str = "query", out: str = "next_query") -> DataFrame:
    """A better query by the model's first line, or the same one."""
    asked = map_scored(queries.withColumn("_prompt", F.concat(F.lit("The results of this search did not suffice. One better query, on one line.\n"), col(query))), scorer, "_prompt", "_reply")
    return asked.withColumn(out, F.coalesce(F.nullif(T.first_line("_reply"), F.lit("")), col(query))).drop("_prompt", "_reply")


def classify_turns(turns: DataFrame, experts: DataFrame, scorer: Scorer, text: str = "text", out: str = "model_expert") -> DataFrame:
    """The id of the expert that the model names in its first word, else null."""
    told = experts.agg(F.array_sort(F.collect_list(F.struct("ord", F.concat(F.lit("- "), "id", F.lit(": "), "name").alias("line"), "id"))).alias("e")).scalar()
    asked = turns.withColumn("_e", told).withColumn("_prompt", F.concat(F.lit("Which expert suits the question best? Its id alone.\n"), F.array_join(F.col("_e.line"), "\n"), F.lit("\n\nQuestion: "), col(text)))
    word = F.lower(F.regexp_extract("_reply", r"^\s*(\S+)", 1))
    return map_scored(asked, scorer, "_prompt", "_reply").withColumn(out, F.when(F.array_contains(F.col("_e.id"), word), word)).drop("_e", "_prompt", "_reply")


def rewrite_turns(turns: DataFrame, scorer: Scorer, expert: str = "expert", text: str = "text", out: str = "rewritten") -> DataFrame:
    """The model's first line in place of a question; tool requests and missing answers stay as they are."""
    prompt = F.concat(F.lit("Rewrite the question for the expert "), F.col(expert), F.lit(", on one line.\n"), col(text))
    asked = turns.withColumn("_prompt", F.when(~T.is_tool_request(text) & (col(text) != ""), prompt))
    one, other = asked.where("_prompt is not null"), asked.where("_prompt is null").withColumn("_reply", F.lit(None).cast("string"))
    return map_scored(one, scorer, "_prompt", "_reply").unionByName(other).withColumn(out, F.coalesce(F.nullif(T.first_line("_reply"), F.lit("")), col(text))).drop("_prompt", "_reply")
