"""Resolution of WARC not-modified revisits, and WARC files.

``resolve`` finds for every revisit record the latest earlier full response (a ``response`` with
status 200) of its canonical URL, checks the validators and merges the headers that a 304 may
change into those of the response.  Records: record_id, url, ts (long), type, status, headers
(map, lower-case names), digest.  Rows: record_id, canonical_url, response_id, outcome, headers:

- ``resolved``: the entity tags agree (weakly compared), or without two tags the modification
  dates, or without two dates the payload digests
- ``unchecked``: there is no validator on both sides to compare
- ``mismatch``: the first pair of validators that both sides have differs; response_id is kept
- ``orphan``: there is no earlier full response, or the URL is null
- ``other``: the record has a ``profile`` (a column that may be missing) that is not the one of unmodified responses, such as
  that of identical payloads; it is not resolved

Of responses with one ts the largest record_id counts; a response at the revisit's own ts isn't earlier.
A revisit with a null ts is an orphan, and responses with a null ts are not used.  Repeated records give a row each.

A URL may hold a third of all records, so captures are searched within buckets of time; only the
last response of each bucket travels to later ones.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator
from datetime import datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Header fields that a 304 response may update.
PERMITTED = ["age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary"]
#: Fixed value: what the profile of a not-modified revisit holds.
NOT_MODIFIED = "server-not-modified"
#: Query parameters that don't name a resource.
TRACKING = r"(?:utm_[a-z]+|gclid|fbclid|ref|sessionid)"


def canonical_url(url: Column) -> Column:
    """Without scheme, user, ``www.``, default port, fragment, tracking parameters and closing slash; host in lower case."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"^(?i:https?:)?//", "")
    host = F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1))
    rest = F.substring(bare, F.length(host) + 1, F.length(bare))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"^www\.", ""), r":(?:80|443)$", "")
    path, query = F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"\?(.*)$", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(f"^{TRACKING}(?:=|$)")))
    return F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def resolve(records: DataFrame, bucket_seconds: int = 86_400) -> DataFrame:
    empty = F.create_map().cast("map<string,string>")
    other = F.lit(False)
    if "profile" in records.columns:
        other = F.coalesce(~F.lower("profile").contains(NOT_MODIFIED), F.lit(False))
    rows = records.select(other.alias("other"), "record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "type", "status", F.coalesce("headers", empty).alias("headers"), "digest")
    rows = rows.withColumn("bucket", F.floor(F.col("ts") / bucket_seconds))
    full = (F.col("type") == "response") & (F.col("status") == 200) & F.col("ts").isNotNull() & F.col("canonical_url").isNotNull()
    revisit = F.col("type") == "revisit"
    known = revisit & ~F.col("other") & F.col("ts").isNotNull() & F.col("canonical_url").isNotNull()
    response = F.when(full, F.struct("ts", "record_id", "headers", "digest"))
    rows = rows.where(full | revisit).withColumn("is_revisit", revisit)
    order = [F.col("ts"), F.col("is_revisit").desc(), F.col("record_id")]
    # Ordered by ts with revisits first, every response before a revisit is earlier.
    within = Window.partitionBy("canonical_url", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.where(known).unionAll(rows.where(full)).withColumn("response", F.last(response, ignorenulls=True).over(within)).where("is_revisit")
    lasts = rows.where(full).groupBy("canonical_url", "bucket").agg(F.max_by(F.struct("ts", "record_id", "headers", "digest"), F.struct("ts", "record_id")).alias("last"))
    buckets = rows.where(known).select("canonical_url", "bucket").distinct().join(lasts, ["canonical_url", "bucket"], "full")
    carried = buckets.withColumn("carried", F.last("last", ignorenulls=True).over(Window.partitionBy("canonical_url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).drop("last")
    found = found.join(carried, ["canonical_url", "bucket"], "left").withColumn("response", F.coalesce("response", "carried")).drop("carried")
    orphans = rows.where(revisit & ~F.coalesce(known, F.lit(False))).withColumn("response", F.lit(None).cast(found.schema["response"].dataType))
    found = found.unionByName(orphans)

    def pair(name: str, clean=lambda x: x) -> tuple[Column, Column]:
        return clean(F.col("headers")[name]), clean(F.col("response.headers")[name])

    def tag(x: Column) -> Column:
        return F.regexp_replace(F.trim(x), "^W/", "")

    outcome = F.lit("unchecked")
    for a, b in ((F.col("digest"), F.col("response.digest")), pair("last-modified", F.trim), pair("etag", tag)):
        outcome = F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, "resolved").otherwise("mismatch")).otherwise(outcome)
    outcome = F.when(F.col("other"), "other").when(F.col("response").isNull(), "orphan").otherwise(outcome)
    update = F.map_filter("headers", lambda k, _: k.isin(PERMITTED))
    keep = F.map_filter("response.headers", lambda k, _: ~F.map_contains_key(update, k))
    merged = F.when(outcome.isin("resolved", "unchecked"), F.map_concat(keep, update)).otherwise(F.col("headers"))
    return found.select("record_id", "canonical_url", F.col("response.record_id").alias("response_id"), outcome.alias("outcome"), merged.alias("headers"))


def write_record(kind: str, headers: dict[str, str], block: bytes, compress: bool = True) -> bytes:
    """One WARC/1.1 record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers.items()), f"Content-Length: {len(block)}"]
    data = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    return gzip.compress(data, mtime=0) if compress else data


def _inflated(data: bytes) -> Iterator[bytes]:
    """The members of a gzip file, one after the other; what a broken one holds up to its fault is the last."""
    while data:
        inflate = zlib.decompressobj(wbits=31)
        try:
            yield inflate.decompress(data)
        except zlib.error:
            return
        data = inflate.unused_data


def parse_records(data: bytes) -> Iterator[tuple[str, dict[str, str], bytes]]:
    """(type, headers with lower-case names, block) of each record; reading ends where a record is broken."""
    rest = b""
    for part in _inflated(data) if data[:2] == b"\x1f\x8b" else [data]:
        rest, at = rest + part, 0
        while record := _record(rest, at):
            *found, at = record
            yield tuple(found)
        rest = rest[at:]


def _record(data: bytes, at: int) -> tuple[str, dict[str, str], bytes, int] | None:
    """The record at a place, and where the next one begins; None if it is not there whole."""
    end = data.find(b"\r\n\r\n", at) if data.startswith(b"WARC/", at) else -1
    if end < 0:
        return None
    lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = headers.get("content-length", "")
    begin = end + 4
    if not (size.isascii() and size.isdigit()) or begin + int(size) > len(data):
        return None
    return headers.get("warc-type", ""), headers, data[begin : begin + int(size)], begin + int(size) + 4


def _seconds(date: str | None) -> int | None:
    """A WARC-Date as seconds; null if it is none."""
    try:
        return int(datetime.fromisoformat(date.replace("Z", "+00:00")).timestamp()) if date else None
    except (ValueError, OverflowError):
        return None


def _http(block: bytes) -> tuple[int | None, dict[str, str]]:
    head = block.partition(b"\r\n\r\n")[0].decode("latin-1").split("\r\n")
    status = head[0].split(" ")[1:2]
    return (int(status[0]) if status and status[0].isascii() and status[0].isdigit() and len(status[0]) < 6 else None), {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head[1:])}


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records of WARC files: record_id, url, ts, type, status, headers, digest, profile.

    A file is read by one task, a record at a time; its bytes are in memory, its records are not.  A file that is broken gives
    the records before the fault, and a date that can't be read is null.
    """
    ddl = "record_id string, url string, ts long, type string, status int, headers map<string,string>, digest string, profile string"
    schema = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("ts", pa.int64()), ("type", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("digest", pa.string()), ("profile", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows = []
                for kind, h, block in parse_records(data.as_py()):
                    if kind in ("response", "revisit"):
                        status, http = _http(block)
                        rows.append({"record_id": h.get("warc-record-id"), "url": h.get("warc-target-uri"), "ts": _seconds(h.get("warc-date")), "type": kind, "status": status, "headers": list(http.items()), "digest": h.get("warc-payload-digest"), "profile": h.get("warc-profile")})
                    if len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ddl)
