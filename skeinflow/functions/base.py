"""Small helpers for column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def contains_any(text: Column, needles) -> Column:
    """Is one of the literal strings in the text; null text is false."""
    found = reduce(lambda a, b: a | b, (text.contains(n) for n in needles), F.lit(False))
    return F.coalesce(found, F.lit(False))


def ends_with_any(text: Column, endings) -> Column:
    found = reduce(lambda a, b: a | b, (text.endswith(e) for e in endings), F.lit(False))
    return F.coalesce(found, F.lit(False))
