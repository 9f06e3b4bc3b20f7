"""Vector functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skeinflow.functions.base import col


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double precision; null where a vector has no length."""
    a, b = col(a), col(b)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def boosted(similarity: Column, boost: Column) -> Column:
    return F.least(F.lit(1.0), similarity + boost)


def similar_pairs(vectors: DataFrame, key: str, vector: str, threshold: float, block: int = 1024, group: str | None = None) -> DataFrame:
    """(a, b, sim) of all pairs a < b with a cosine above the threshold.

    Vectors are dealt into blocks by a hash; a task multiplies two blocks, so memory is
    bounded and no row meets all others in one place. Exact, and so quadratic in the rows;
    with ``group``, in the rows of a group: only rows that share that column are compared
    (a label, or a key of a blocking that the caller has measured).
    """
    told = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"), (F.col(group) if group else F.lit(0)).alias("g"))
    sizes = told.groupBy("g").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = told.join(sizes, "g").withColumn("own", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("g", "k", "v", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("right"))

    def multiply(table: pa.Table) -> pa.Table:
        keys = table.column("k").to_numpy()
        rows = np.array(table.column("v").to_pylist())
        norms = np.linalg.norm(rows, axis=1)
        rows = rows / np.where(norms == 0, 1, norms)[:, None]
        right = table.column("right").to_numpy().astype(bool)
        left, other = np.flatnonzero(~right), np.flatnonzero(right)
        same = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        if same:
            other = left
        sims = rows[left] @ rows[other].T
        x, y = np.nonzero(sims > threshold)
        a, b = keys[left[x]], keys[other[y]]
        keep = a < b if same else a != b
        return pa.table({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "sim": np.round(sims[x, y][keep], 6)})

    return dealt.groupBy("g", "i", "j").applyInArrow(multiply, "a long, b long, sim double")


def similar_pairs_by_planes(vectors: DataFrame, key: str, vector: str, threshold: float, bits: int = 8, tables: int = 16, seed: int = 1, block: int = 1024) -> DataFrame:
    """``similar_pairs`` of rows that lie on the same side of ``bits`` random planes in one of ``tables`` sets of them.

    Not exact: a pair of cosine c is missed with probability (1 - (1 - acos(c) / pi)^bits)^tables,
    which is 2e-4 at 0.95 with the defaults. Rows are compared ``tables`` times with those
    of their side, about 2^-bits of all, so it grows with the rows as long as ``bits`` does with their logarithm.
    """
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    size = rows.agg(F.max(F.size("v"))).first()[0] or 1

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(seed).standard_normal((size, tables * bits))
        for batch in batches:
            if batch.num_rows:
                own = (np.array(batch.column(1).to_pylist()) @ planes > 0).reshape(-1, tables, bits)
                codes = own @ (1 << np.arange(bits)) + np.arange(tables) * (1 << bits)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes.tolist(), pa.list_(pa.int64()))], names=["k", "v", "codes"])

    dealt = rows.where(F.size("v") == size).mapInArrow(sides, "k long, v array<double>, codes array<long>").select("k", "v", F.explode("codes").alias("code"))
    return similar_pairs(dealt, "k", "v", threshold, block, group="code").distinct()
