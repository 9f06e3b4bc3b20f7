"""WARC: revisit records resolved to the full responses that they did not repeat.

A server's "not modified" answer is archived as a revisit record without a payload. Here
it is joined, as of its time, to the latest earlier full response of the same canonical
URL; the validators (payload digest, ETag, Last-Modified) that both records carry must
agree; and the headers that a 304 answer may update replace those of the response.

The as-of join runs on narrow rows in two levels, so that one URL with a third of all
captures is no single task: captures are dealt into slices of time by approximate
quantiles, the last response of each (URL, slice) is found by a map-side combined
aggregation, a window over slices carries it forward, and a window inside (URL, slice)
does the rest. Revisits travel through it whole, responses without headers and payload.
Those join last; while the responses referred to number at most
``_shared.BROADCAST_ROWS``, a broadcast of hashes of their keys sorts out the others before
payloads are shuffled.

Defined results: a revisit and a response are known by all that the join looks at (record
id, URL, time, validators), so records that repeat a record_id are each resolved by their
own URL and time; of responses that are equal in all of it one with the smallest hash of
status, headers and payload is taken. Records of null URL, time or id are never matched
(outcome "missing"); records of equal time are ordered by record_id, then validators; a
revisit without any validator in common with the response is a "mismatch"; empty tables
give empty results; further columns pass through.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skeinflow.llm._shared import let, materialise, small, unused

#: Captures of one URL that a slice of time should hold, about.
SLICE_ROWS = 5000

#: Headers that a 304 answer may update (RFC 9111, 3.2 and RFC 9110, 15.4.5); fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary", "age", "warning")

RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("digest", T.StringType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)


def canonical_url(url: F.Column | str) -> F.Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters and a trailing slash do not tell URLs apart; host case neither."""
    url = F.trim(F.col(url) if isinstance(url, str) else url)
    url = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "(?i)^https?://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, "^[^/?]*", 0)), "^www\\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(url, "^[^?]*\\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(utm_[a-z]*|gclid|fbclid|ref|sessionid)="))
    query = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _lowered(headers: F.Column) -> F.Column:
    pairs = F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    def named(p):
        last = F.filter(p, lambda e, i: e["key"].isNotNull() & ~F.exists(F.slice(p, i + 2, F.size(p)), lambda f: f["key"] == e["key"]))
        return F.map_from_entries(last)

    return F.coalesce(let(pairs, named), F.create_map().cast("map<string,string>"))


def resolve_revisits(records: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Revisits with refers_to, outcome (resolved, mismatch or missing), and where resolved the response's payload and merged headers.

    ``records`` has the columns of RECORD and perhaps more, whose values come from the revisit.
    """
    canonical, etag, modified, own = unused(records, "m_canonical", "m_etag", "m_modified", "m_own")
    told = records.withColumns({canonical: canonical_url("url"), etag: F.element_at(_lowered(F.col("headers")), "etag"), modified: F.element_at(_lowered(F.col("headers")), "last-modified")})
    key = F.struct("ts", "record_id", "digest", F.col(etag).alias("etag"), F.col(modified).alias("modified"))
    able = F.col(canonical).isNotNull() & F.col("ts").isNotNull() & F.col("record_id").isNotNull()
    whole = F.struct(*(F.col(f"`{c}`") for c in records.columns))
    revisits = told.where("type = 'revisit'")
    seen = revisits.where(able).select(F.col(canonical).alias("canonical"), "ts", key.alias("key"), F.lit(None).cast(key_type(told, key)).alias("full"), whole.alias(own))
    full = told.where((F.col("type") == "response") & able).select(F.col(canonical).alias("canonical"), "ts", key.alias("key"), key.alias("full"), F.lit(None).cast(seen.schema[own].dataType).alias(own))
    narrow = seen.union(full)
    edges = _edges(narrow, slice_rows)
    slice_ = F.size(F.filter(F.lit(edges).cast("array<double>"), lambda e: e <= F.col("ts").cast("double"))) if edges else F.lit(0)
    narrow = narrow.withColumn("slice", slice_)
    sums = narrow.groupBy("canonical", "slice").agg(F.max("full").alias("of_slice"))
    before = Window.partitionBy("canonical").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("canonical", "slice", F.max("of_slice").over(before).alias("carried"))
    inside = Window.partitionBy("canonical", "slice").orderBy("ts", "key.record_id", F.col("full").isNull()).rowsBetween(Window.unboundedPreceding, -1)
    joined = narrow.join(carried, ["canonical", "slice"]).withColumn("response", F.coalesce(F.max("full").over(inside), F.col("carried")))
    agree, differ = F.lit(False), F.lit(False)
    for name in ("digest", "etag", "modified"):
        agree = agree | F.coalesce(F.col(f"key.{name}") == F.col(f"response.{name}"), F.lit(False))
        differ = differ | F.coalesce(F.col(f"key.{name}") != F.col(f"response.{name}"), F.lit(False))
    outcome = F.when(F.col("response").isNull(), "missing").when(agree & ~differ, "resolved").otherwise("mismatch")
    resolved = joined.where(F.col(own).isNotNull()).select(own, "canonical", "response", outcome.alias("outcome"))
    resolved = materialise(resolved.union(revisits.where(~able).select(whole, F.lit(None).cast("string"), F.lit(None).cast(key_type(told, key)), F.lit("missing"))))
    # the responses that are needed, one of each key
    needed = resolved.where("outcome = 'resolved'").select(F.xxhash64("canonical", "response").alias("n_hash")).distinct()
    bodies = told.where((F.col("type") == "response") & able).select(F.col(canonical).alias("b_canonical"), key.alias("b_key"), F.col("headers").alias("b_headers"), F.col("payload").alias("b_payload"), F.col("status").alias("b_status"))
    bodies = bodies.join(small(needed), F.xxhash64("b_canonical", "b_key") == F.col("n_hash"), "left_semi")
    body = F.xxhash64("b_status", F.array_sort(F.map_entries("b_headers")), "b_payload")
    bodies = bodies.withColumn("b_at", F.row_number().over(Window.partitionBy("b_canonical", "b_key").orderBy(body))).where("b_at = 1")
    ok = F.col("outcome") == "resolved"
    out = resolved.withColumn("r_canonical", F.when(ok, F.col("canonical"))).join(bodies, (F.col("r_canonical") == F.col("b_canonical")) & F.col("response").eqNullSafe(F.col("b_key")), "left")
    mine = lambda c: F.col(f"`{own}`.`{c}`")
    update = F.map_filter(_lowered(mine("headers")), lambda k, _: k.isin(*PERMITTED))
    merged = let(update, lambda u: F.map_concat(F.map_filter(_lowered(F.col("b_headers")), lambda k, _: ~F.array_contains(F.map_keys(u), k)), u))
    changed = {"headers": F.when(ok, merged).otherwise(mine("headers")), "payload": F.when(ok, F.col("b_payload")).otherwise(mine("payload")), "status": F.when(ok, F.col("b_status")).otherwise(mine("status"))}
    refers, told_outcome = unused(records, "refers_to", "outcome")
    return out.select(*((changed.get(c, mine(c))).alias(c) for c in records.columns), F.col("response.record_id").alias(refers), F.col("outcome").alias(told_outcome))


def key_type(told: DataFrame, key: F.Column) -> T.DataType:
    return told.select(key.alias("key")).schema["key"].dataType


def _edges(narrow: DataFrame, slice_rows: int) -> list[float]:
    """Approximate quantiles of time: slices of about ``slice_rows`` captures, at most 1000."""
    n = narrow.count()
    cuts = min(1000, n // slice_rows)
    if cuts < 1:
        return []
    found = narrow.select(F.percentile_approx(F.col("ts").cast("double"), [i / (cuts + 1) for i in range(1, cuts + 1)], 10_000)).first()[0]
    return sorted(set(found))


def captures(pages: DataFrame) -> DataFrame:
    """A crawl's records from pages: each page as a full response, and a check of it half a crawl later.

    page_id counts seconds. The check is answered "not modified" with the page's own
    validators, so it resolves unless another capture of the URL came in between.
    """
    digest = F.concat(F.lit("sha256:"), F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256))
    tag = F.concat(F.lit('"'), F.substring(digest, 8, 16), F.lit('"'))
    ts = F.col("page_id").cast("timestamp")
    date = F.date_format(ts, "yyyy-MM-dd HH:mm:ss")
    full = pages.select(
        F.concat(F.lit("r"), F.col("page_id")).alias("record_id"), F.lit("response").alias("type"), "url", ts.alias("ts"), digest.alias("digest"), F.lit(200).alias("status"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), tag, F.lit("Date"), date).alias("headers"), F.col("html").cast("binary").alias("payload"), "page_id",
    )
    later = (ts.cast("long") + 5000).cast("timestamp")
    check = pages.select(
        F.concat(F.lit("v"), F.col("page_id")).alias("record_id"), F.lit("revisit").alias("type"), "url", later.alias("ts"), F.lit(None).cast("string").alias("digest"), F.lit(304).alias("status"),
        F.create_map(F.lit("etag"), tag, F.lit("date"), F.date_format(later, "yyyy-MM-dd HH:mm:ss"), F.lit("content-length"), F.lit("0")).alias("headers"), F.lit(None).cast("binary").alias("payload"), "page_id",
    )
    return full.unionByName(check)


def parse_warc(data: bytes) -> Iterator[dict]:
    """The response and revisit records of a WARC file, plain or gzip by member; a broken tail is left out."""
    if data[:2] == b"\x1f\x8b":
        plain, rest = [], data
        while rest:
            member = zlib.decompressobj(31)
            try:
                plain.append(member.decompress(rest))
            except zlib.error:
                break
            rest = member.unused_data
        data = b"".join(plain)
    at = 0
    while (at := data.find(b"WARC/", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        try:
            size = int(head.get("content-length", ""))
        except ValueError:
            at = end
            continue
        block = data[end + 4 : end + 4 + size]
        if len(block) < size:
            return
        at = end + 4 + size
        if head.get("warc-type") not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        lines = http.decode("latin-1").split("\r\n")
        status = lines[0].split(" ")
        headers = dict(tuple(p.strip() for p in x.partition(":")[::2]) for x in lines[1:] if ":" in x)
        yield {"record_id": head.get("warc-record-id"), "type": head["warc-type"], "url": head.get("warc-target-uri", "").strip("<>") or None, "ts": head.get("warc-date"), "digest": head.get("warc-payload-digest"), "status": int(status[1]) if len(status) > 1 and status[1].isdigit() else None, "headers": headers, "payload": payload}


def format_warc(record: dict, compress: bool = False) -> bytes:
    """The record of ``parse_warc`` as bytes."""
    http = "\r\n".join([f"HTTP/1.1 {record['status'] or 0} -", *(f"{k}: {v}" for k, v in (record["headers"] or {}).items())]).encode("latin-1", "replace")
    block = http + b"\r\n\r\n" + (record["payload"] or b"")
    named = {"WARC-Type": record["type"], "WARC-Record-ID": record["record_id"], "WARC-Target-URI": record["url"], "WARC-Date": record["ts"], "WARC-Payload-Digest": record["digest"], "Content-Length": len(block)}
    head = "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in named.items() if v is not None)]).encode()
    out = head + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(out, mtime=0) if compress else out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, one task a file at least, through Spark's binary reader."""
    plain = T.StructType([T.StructField(f.name, T.StringType() if f.name == "ts" else f.dataType) for f in RECORD])
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = list(parse_warc(content.as_py()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([list(r[n].items()) if n == "headers" else r[n] for r in rows], k) for n, k in zip(plain.names, kinds, strict=True)], names=plain.names)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, plain).withColumn("ts", F.try_to_timestamp("ts"))
