"""JSON that models and crawlers return: found in prose, repaired, normalised."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.functions.base import col, let


def find_array(text: Column | str) -> Column:
    """From the first bracket to the last; null without."""
    found = F.regexp_extract(F.regexp_replace(col(text), "```(?:json)?", ""), r"(?s)(\[.*\])", 1)
    return F.when(found != "", found)


def parse_flags(text: Column | str, n: Column) -> Column:
    """An array of booleans, a missing bracket added; all true where it can't be read or has another length."""
    raw = F.regexp_extract(col(text), r"(?s)(\[.*)", 1)
    kind = T.ArrayType(T.BooleanType())
    parsed = F.coalesce(F.from_json(find_array(text), kind), F.from_json(F.concat(F.regexp_replace(raw, r"[\s,]+$", ""), F.lit("]")), kind))
    return let(parsed, lambda a: F.when(a.isNotNull() & (F.size(a) == n) & ~F.exists(a, lambda x: x.isNull()), a).otherwise(F.array_repeat(F.lit(True), n)))


def parse_strings(text: Column | str) -> Column:
    return F.coalesce(F.from_json(find_array(text), T.ArrayType(T.StringType())), F.array().cast("array<string>"))


def homonyms(text: Column | str) -> Column:
    """What a comment line tells to avoid."""
    told = F.regexp_extract(col(text), r"(?i)//\s*Homonyms to avoid:\s*([^\n]*)", 1)
    parts = F.transform(F.split(told, "[,;]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: (x != "") & ~F.lower(x).isin("none", "ninguno", "n/a", "-"))


def expansions(query: Column | str, found: Column, limit: int = 5) -> Column:
    """The query, then at most ``limit`` others that differ from it, each once."""
    query = col(query)
    return F.array_distinct(F.concat(F.array(query), F.filter(F.slice(found, 1, limit), lambda x: F.lower(F.trim(x)) != F.lower(F.trim(query)))))


#: The topics of items that are a text, or anything else without a topic.
TEXT_TOPIC, OTHER_TOPIC, BLOCK_TOPIC = "Extracted information", "Content", "Information"


def _first(item: dict, *names: str, default: object) -> object:
    """The value of the first name that is there, whatever it is."""
    return next((item[n] for n in names if n in item), default)


def _spelled(value: object, lists: int = 2) -> str:
    """A summary as text: objects by their own summary or content, lists joined by blanks, also the list that an object of a list holds; deeper ones as they are written."""
    if isinstance(value, list) and lists:
        return " ".join(_spelled(_first(x, "summary", "content", default=str(x)), lists - 1) if isinstance(x, dict) else str(x) for x in value)
    if isinstance(value, dict):
        return str(_first(value, "summary", "content", default=str(value)))
    return str(value)


def normalise_item(value: object) -> list[tuple[str, str, str | None]]:
    """(topic, summary, source) of whatever a crawler calls content. A key that is there counts, also with an empty or null value (spelled None)."""
    if isinstance(value, list):
        return [row for x in value for row in normalise_item(x)]
    if isinstance(value, dict):
        source = value.get("source")
        return [(str(_first(value, "topic", "title", default=OTHER_TOPIC)), _spelled(_first(value, "summary", "content", default="")), None if source is None else str(source))]
    return [(TEXT_TOPIC if isinstance(value, str) else OTHER_TOPIC, str(value), None)]


def extracted_item(value: object) -> list[tuple[str, str, str | None]]:
    """(topic, summary, source) of the crawler's extracted blocks: objects whose error is false, texts, and whatever a nested list holds; nothing where they are no list."""
    told = lambda x: (str(_first(x, "topic", default=BLOCK_TOPIC)), str(_first(x, "summary", default=str(x))), None)
    out = []
    for x in value if isinstance(value, list) else []:
        if isinstance(x, dict):
            out += [told(x)] if x.get("error") is False else []
        elif isinstance(x, str):
            out.append((OTHER_TOPIC, x, None))
        elif isinstance(x, list):
            out += [told(y) if isinstance(y, dict) else (OTHER_TOPIC, str(y), None) for y in x]
    return out


def normalise_content(df: DataFrame, content: str, *keys: str, items=normalise_item) -> DataFrame:
    """``keys``, ord, topic, summary, source of every item in a column of JSON text, by ``items`` (or ``extracted_item``); recursion needs Python."""
    own = df.select(*keys, content)
    schema = T.StructType([*own.select(*keys).schema.fields, T.StructField("ord", T.IntegerType()), T.StructField("topic", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("source", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rows = [], []
            for i, text in enumerate(batch.column(len(keys)).to_pylist()):
                try:
                    value = json.loads(text) if text else None
                except ValueError:
                    value = text
                for k, row in enumerate(items(value) if text else []):
                    out.append((k, *row))
                    rows.append(i)
            taken = [batch.column(k).take(pa.array(rows, pa.int64())) for k in range(len(keys))]
            made = [pa.array([r[0] for r in out], pa.int32()), *(pa.array([r[k] for r in out], pa.string()) for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([*taken, *made], names=schema.names)

    return own.mapInArrow(run, schema)


def extracted_items(text: Column | str) -> Column:
    """The crawler's extracted blocks that are no errors: array of (topic, summary)."""
    block = T.StructType([T.StructField("error", T.BooleanType()), T.StructField("topic", T.StringType()), T.StructField("summary", T.StringType()), T.StructField("content", T.StringType())])
    parsed = F.coalesce(F.from_json(col(text), T.ArrayType(block)), F.array().cast(T.ArrayType(block)))
    good = F.filter(parsed, lambda x: ~F.coalesce(x["error"], F.lit(True)))
    return F.transform(good, lambda x: F.struct(F.coalesce(x["topic"], F.lit("Content")).alias("topic"), F.coalesce(x["summary"], x["content"], F.lit("")).alias("summary")))
