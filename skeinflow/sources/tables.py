"""Readers: tables, recorded responses, raw files, experts."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from skeinflow.functions.text import language_of, truncate_bytes
from skeinflow.functions.url import filename
from skeinflow.sources.expert_config import as_json

#: Bytes of a raw file that are kept.
RAW_BYTES = 100_000
#: Bytes of recorded answers that a task reads.
STRETCH = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [f.name for f in df.schema if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df


class SearchSource(DataSource):
    """Recorded answers of search engines as a batch source: options path (JSON lines: a file, or a folder of *.jsonl) and limit.

    A line is {"query", "engine", "results": [{url or link, title, content, snippet or description}]}.
    The driver lists the files, and each is read in stretches of ``STRETCH`` bytes by tasks of
    their own, so the path must be one that executors can open; ``search_results`` reads
    the same answers through Spark's readers from any store.
    """

    @classmethod
    def name(cls) -> str:
        return "skein_search"

    def schema(self) -> str:
        return "query string, engine string, rank int, url string, title string, snippet string"

    def reader(self, schema) -> DataSourceReader:
        return _SearchReader(self.options["path"], int(self.options.get("limit", 10)))


class _Stretch(InputPartition):
    def __init__(self, path: str, begin: int, end: int) -> None:
        self.path, self.begin, self.end = path, begin, end


class _SearchReader(DataSourceReader):
    def __init__(self, path: str, limit: int) -> None:
        self.path, self.limit = Path(path), limit

    def partitions(self) -> list[InputPartition]:
        files = sorted(self.path.glob("*.jsonl")) if self.path.is_dir() else [self.path]
        return [_Stretch(str(f), b, b + STRETCH) for f in files for b in range(0, max(1, f.stat().st_size), STRETCH)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """The lines that begin within the stretch."""
        with open(partition.path, "rb") as lines:
            if partition.begin:
                lines.seek(partition.begin - 1)
                lines.readline()
            while lines.tell() < partition.end and (line := lines.readline()):
                if line.strip():
                    answer = json.loads(line)
                    for rank, r in enumerate((answer.get("results") or [])[: self.limit]):
                        yield answer.get("query"), answer.get("engine"), rank, r.get("url") or r.get("link"), r.get("title"), r.get("content") or r.get("snippet") or r.get("description")


def search_results(answers: DataFrame, limit: int = 10) -> DataFrame:
    """Recorded answers (query_ord, engine_ord, response JSON) as ranked rows, through Spark's JSON reader functions."""
    item = "array<struct<url:string,link:string,title:string,content:string,snippet:string,description:string>>"
    parsed = answers.withColumn("r", F.from_json("response", f"struct<results:{item}>"))
    rows = parsed.select("query_ord", "engine_ord", F.posexplode(F.slice("r.results", 1, limit)).alias("rank", "x"))
    text = F.coalesce(*(F.nullif(F.col(f"x.{c}"), F.lit("")) for c in ("content", "snippet", "description")), F.lit(""))
    return rows.select("query_ord", "engine_ord", "rank", F.coalesce(F.nullif(F.col("x.url"), F.lit("")), F.col("x.link")).alias("url"), F.coalesce("x.title", F.lit("")).alias("title"), text.alias("snippet"))


def raw_files(spark: SparkSession, path: str, size: int = RAW_BYTES) -> DataFrame:
    """Files as content items: topic is the file's name, summary its fenced text."""
    return raw_items(spark.read.format("binaryFile").load(path), size).select(F.col("path").alias("source"), "topic", "summary")


def raw_items(files: DataFrame, size: int = RAW_BYTES) -> DataFrame:
    """``files`` (path, content) with topic, the file's name, and summary, its text in a fence, cut to ``size`` bytes."""
    text = truncate_bytes(F.make_valid_utf8(F.col("content").cast("string")), size)
    named = files.withColumn("topic", filename("path"))
    return named.withColumn("summary", F.concat(F.lit("```"), language_of("topic"), F.lit("\n"), text, F.lit("\n```")))


def experts(spark: SparkSession, config: str | None = None) -> DataFrame:
    """Experts (ord, id, name, keywords, examples, knowledge_base, collection_name) of a JSON text; entries without id, name or keywords are left out."""
    config = as_json() if config is None else config
    kind = "array<struct<id:string,name:string,keywords:array<string>,description:string,examples:array<string>,knowledge_base:string,collection_name:string>>"
    one = spark.createDataFrame([(config,)], "config string")
    rows = one.select(F.posexplode(F.from_json("config", kind)).alias("ord", "x")).select("ord", "x.*")
    return rows.where("id is not null and name is not null and keywords is not null")


class ExpertConfig:
    """Experts from a text that may change: read again when its hash changes, kept as they were when the new text can't be used."""

    def __init__(self, spark: SparkSession, config: str | None = None) -> None:
        self.spark, self.hash, self.rows = spark, None, None
        self.load(as_json() if config is None else config)

    def load(self, config: str) -> bool:
        """Did the experts change."""
        new = hashlib.md5(config.encode()).hexdigest()
        if new == self.hash:
            return False
        try:
            entries = json.loads(config)
            usable = isinstance(entries, list) and any(isinstance(e, dict) and e.get("id") and e.get("name") and e.get("keywords") for e in entries)
        except ValueError:
            usable = False
        if not usable and self.rows is not None:
            return False
        self.hash, self.rows = new, experts(self.spark, config)
        return True


def map_scored(df: DataFrame, score, prompt: str, out: str = "response", batch: int = 10) -> DataFrame:
    """A column of answers by a scorer: a function of a list of prompts, called on an executor for ``batch`` prompts at a time.

    A failing call gives nulls, which every consumer reads as its default.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            answers: list[str | None] = []
            prompts = rows.column(rows.schema.get_field_index(prompt)).to_pylist()
            for i in range(0, len(prompts), batch):
                try:
                    got = list(score(prompts[i : i + batch]))
                except Exception:  # any failure of a remote model is a missing answer
                    got = []
                answers += got if len(got) == len(prompts[i : i + batch]) else [None] * len(prompts[i : i + batch])
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(answers, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)
