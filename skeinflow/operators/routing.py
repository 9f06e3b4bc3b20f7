"""Routing questions to experts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinflow.functions import text as T
from skeinflow.functions.base import let
from skeinflow.sources.storage import materialise

DEFAULT = "generalista"
SEMANTIC_THRESHOLD = 0.55
CHANGE_THRESHOLD = 2
#: What is told of a knowledge base, around its collection and its name, and the name of one without.
GUIDANCE = (
    "You have access to the knowledge base '", "' (", "specialized documents",
    "). Use this knowledge base when relevant, but you may also use other available tools. Answer in the same language as the user.",
)

def keyword_expert(turns: DataFrame, experts: DataFrame, text: str = "text", out: str = "expert") -> DataFrame:
    """``turns`` with the first expert (by ord) one of whose keywords is in the text, else null; experts from a table.

    The experts, a configuration, are one array for all rows; no row meets another in a join.
    """
    listed = experts.agg(F.array_sort(F.collect_list(F.struct("ord", "id", "keywords")))).scalar()
    found = let(F.lower(F.coalesce(text, F.lit(""))), lambda lower: F.filter("_experts", lambda e: F.exists(e["keywords"], lambda k: F.contains(lower, k))))
    return turns.withColumn("_experts", listed).withColumn(out, F.get(found, 0)["id"]).drop("_experts")


def by_similarity(queries: DataFrame, examples: DataFrame, key: str, threshold: float = SEMANTIC_THRESHOLD, default: str = DEFAULT, block_bytes: int = 16 << 20) -> DataFrame:
    """(key, expert_id, score): the expert of the most similar example, the default below the threshold; equal scores go to the first expert.

    ``queries`` (key, embedding); ``examples`` (expert_ord, expert_id, embedding). Examples are
    broadcast in blocks of at most ``block_bytes`` of vectors; a further block is a further
    pass over the best so far, written in between.
    """
    out = queries.select(F.col(key), F.col("embedding").cast("array<double>").alias("embedding"), F.lit(-1.0).alias("score"), F.lit(None).cast("int").alias("expert_ord"), F.lit(None).cast("string").alias("expert_id"))
    for i, block in enumerate(_example_blocks(examples, block_bytes)):
        out = (materialise(out) if i else out).mapInArrow(_nearest(queries.sparkSession.sparkContext.broadcast(block)), out.schema)
    return out.select(key, F.when(F.col("score") >= threshold, F.col("expert_id")).otherwise(default).alias("expert_id"), "score")


def _example_blocks(examples: DataFrame, block_bytes: int) -> Iterator[tuple[np.ndarray, list[int], list[str]]]:
    """Normed vectors with their experts, sorted by expert, in blocks of bounded size."""
    rows, size = [], 0
    for row in examples.select("expert_ord", "expert_id", "embedding").orderBy("expert_ord").toLocalIterator():
        rows.append(row)
        size += 8 * len(row[2])
        if size >= block_bytes:
            yield _block(rows)
            rows, size = [], 0
    if rows:
        yield _block(rows)


def _block(rows: list) -> tuple[np.ndarray, list[int], list[str]]:
    return _normed(np.array([r[2] for r in rows], float)), [r[0] for r in rows], [r[1] for r in rows]


def _normed(vectors: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1, norms)


def _nearest(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, ords, ids = shared.value
        for batch in batches:
            own = batch.column(1)
            able = [x is not None and len(x) == vectors.shape[1] for x in own.to_pylist()]
            sims = np.full(batch.num_rows, -1.0)
            at = np.zeros(batch.num_rows, np.int64)
            if any(able):
                places = np.flatnonzero(able)
                product = np.round(_normed(np.array([own[int(i)].as_py() for i in places], float)) @ vectors.T, 6)
                at[places] = product.argmax(axis=1)
                sims[places] = product.max(axis=1)
            before = batch.column(2).to_numpy()
            # the first expert stays on ties: earlier blocks hold smaller ones
            better = (sims > before) | (batch.column(3).is_null().to_numpy(zero_copy_only=False) & np.array(able, bool))
            score = np.where(better, sims, before)
            old_ord, old_id = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            new_ord = [ords[a] if b else o for a, b, o in zip(at, better, old_ord, strict=True)]
            new_id = [ids[a] if b else o for a, b, o in zip(at, better, old_id, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), own, pa.array(score, pa.float64()), pa.array(new_ord, pa.int32()), pa.array(new_id, pa.string())], names=batch.schema.names)

    return run


def cache_key(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with cache_key: the text and a hash of the two turns before, by user or assistant."""
    window = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    told = F.when(F.col("role").isin("user", "assistant"), F.concat("role", F.lit(":"), F.substring("text", 1, 80)))
    before = F.array_join(F.collect_list(told).over(window), "|")
    base = F.trim(F.lower("text"))
    return turns.withColumn("cache_key", F.when(before == "", base).otherwise(F.concat(base, F.lit("::"), F.substring(F.md5(before.cast("binary")), 1, 8))))


def classify(cached: Column, active: Column, model: Column, semantic: Column, keyword: Column, default: str = DEFAULT) -> Column:
    """Cache, then the active expert if similarity confirms it, the model, similarity, keywords, the default."""
    sticky = F.when((active != default) & (semantic == active), semantic)
    return F.coalesce(cached, sticky, F.nullif(model, F.lit("")), F.nullif(semantic, F.lit("")), keyword, F.lit(default))


def model_answer(response: Column, ids: list[str]) -> Column:
    """A model's first word, if it is an expert's id."""
    first = F.lower(F.regexp_extract(response, r"^\s*(\S+)", 1))
    return F.when(first.isin(*ids), first)


def sticky(turns: DataFrame, threshold: int = CHANGE_THRESHOLD) -> DataFrame:
    """(conv_id, turn, expert): the expert of a conversation changes only when a question shares few words with the ones before.

    ``turns`` (conv_id, turn, role, text, new_expert), new_expert for user turns; folded in order, as each step needs the last.
    """
    two = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, -1)
    told = F.collect_list(F.when(F.col("role") == "user", F.col("text"))).over(two)
    shared = T.shared_words("text", F.array_join(told, " "))
    steps = turns.withColumn("_shared", shared).where("role = 'user'")
    listed = steps.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "new_expert", "_shared"))).alias("s"))
    state = "struct<current:string,out:array<struct<turn:bigint,expert:string>>>"
    empty = F.struct(F.lit(None).cast("string").alias("current"), F.array().cast("array<struct<turn:bigint,expert:string>>").alias("out")).cast(state)

    def step(a, x):
        change = a["current"].isNull() | ((x["new_expert"] != a["current"]) & (x["_shared"] < threshold))
        expert = F.when(change, x["new_expert"]).otherwise(a["current"])
        return F.struct(expert.alias("current"), F.concat(a["out"], F.array(F.struct(x["turn"].cast("bigint").alias("turn"), expert.alias("expert")))).alias("out")).cast(state)

    return listed.select("conv_id", F.explode(F.aggregate("s", empty, step, lambda a: a["out"])).alias("x")).select("conv_id", "x.turn", "x.expert")


def inject_guidance(turns: DataFrame, experts: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text, expert_id) with the knowledge base told in the first system turn, or in a new turn -1.

    ``experts`` (id, collection_name, knowledge_base); nothing is told of experts without a collection.
    """
    dim = experts.where("collection_name is not null").select(F.col("id").alias("expert_id"), "collection_name", "knowledge_base")
    guidance = F.concat(F.lit(GUIDANCE[0]), F.col("collection_name"), F.lit(GUIDANCE[1]), F.coalesce("knowledge_base", F.lit(GUIDANCE[2])), F.lit(GUIDANCE[3]))
    joined = turns.join(dim, "expert_id", "left").withColumn("_g", guidance)
    first = F.min(F.when(F.col("role") == "system", F.col("turn"))).over(Window.partitionBy("conv_id"))
    marked = joined.withColumn("_first", first)
    same = marked.withColumn("text", F.when((F.col("turn") == F.col("_first")) & F.col("_g").isNotNull(), F.concat("text", F.lit("\n\n"), F.col("_g"))).otherwise(F.col("text")))
    new = marked.where("_first is null and _g is not null").groupBy("conv_id", "expert_id").agg(F.first("_g").alias("text")).select("conv_id", F.lit(-1).cast("bigint").alias("turn"), F.lit("system").alias("role"), "text", "expert_id")
    return same.select("conv_id", "turn", "role", "text", "expert_id").unionByName(new)


def rewrite(turns: DataFrame, answers: DataFrame) -> DataFrame:
    """turns with rewritten: a model's first line, the text itself for tool requests and missing answers."""
    joined = turns.join(answers, ["conv_id", "turn"], "left")
    line = F.nullif(T.first_line("response"), F.lit(""))
    return joined.withColumn("rewritten", F.when(T.is_tool_request("text"), F.col("text")).otherwise(F.coalesce(line, F.col("text")))).drop("response")
