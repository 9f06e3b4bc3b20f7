"""Helpers that the corpus operators share: tables, the shared folder, column names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skeinflow.functions.base import let as let
from skeinflow.sources.storage import mark as mark
from skeinflow.sources.storage import materialise as materialise
from skeinflow.sources.storage import sweep as sweep

#: The word separators of the contracts: space and U+0009 to U+000D.
SEPARATORS = " \\x09-\\x0D"
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``, through Spark's reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: F.Column | str) -> F.Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null has none."""
    text = F.trim(F.col(text) if isinstance(text, str) else text, F.lit(BLANKS))
    return F.when(text != "", F.split(text, f"[{SEPARATORS}]+")).otherwise(F.array().cast("array<string>"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that do not clash with those of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows, or values of arrays, up to which a written table is broadcast in a join; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, size: F.Column | None = None, most: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a narrow written table, if the sizes of its rows (1 each, unless told) add up to no more than ``most``."""
    total = df.agg(F.coalesce(F.sum(F.lit(1) if size is None else size + 1), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= most else df
