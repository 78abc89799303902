"""WARC records and the resolution of not-modified revisits.

A revisit under the server-not-modified profile has no payload of its own. It is
resolved by an as-of join by canonical URL to the latest earlier full response;
their validators are checked and the headers that a 304 may update are merged.

The as-of join deals captures by range of (canonical URL, time), so that a URL
with very many captures spans several tasks. Each task finds the latest response
within its own range; what a URL carries over from earlier ranges is a table of at
most two rows a range, which is broadcast.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

NOT_MODIFIED = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
#: Headers of a stored response that a 304 leaves alone: those of the representation, and hop-by-hop ones.
KEPT_HEADERS = (
    "content-encoding", "content-length", "content-range", "content-type",
    "connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
)
#: Query parameters that name no other resource.
TRACKING = "^(utm_[^=]*|fbclid|gclid)(=.*)?$"
RECORDS = "record_id string, type string, url string, date string, profile string, status int, headers map<string,string>, payload_sha256 string, payload_bytes long, payload binary"


# -- records ---------------------------------------------------------------------


def record(kind: str, record_id: str, url: str | None, date: str, block: bytes, profile: str | None = None) -> bytes:
    """One WARC 1.1 record."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url}")
    if profile:
        lines.append(f"WARC-Profile: {profile}")
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def http_block(status: str, headers: list[tuple[str, str]], body: bytes = b"") -> bytes:
    return "\r\n".join([f"HTTP/1.1 {status}", *(f"{k}: {v}" for k, v in headers), "", ""]).encode() + body


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; repeated ones joined by a comma, continued lines by a space."""
    out: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").splitlines():
        if line[:1] in " \t" and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last, value = last.strip().lower(), value.strip()
            out[last] = f"{out[last]}, {value}" if last in out else value
    return out


def _length(value: str | None) -> int | None:
    """A Content-Length, or None where it is missing, negative or no number."""
    return int(value) if value is not None and re.fullmatch("[0-9]{1,18}", value) else None


def parse(raw: bytes, payloads: bool = True):
    """Each response and revisit record of a WARC file, plain or gzip: a tuple of RECORDS.

    A cut-off last record is left out. So is a record without a legible length; the
    next line that begins a record is looked for from its header on. Other bytes
    between records are passed over. A status that is no number is null.
    """
    stream: io.BufferedIOBase = io.BytesIO(raw)
    if raw[:2] == b"\x1f\x8b":
        stream = gzip.GzipFile(fileobj=stream)
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            head = []
            while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
                head.append(line)
            fields = _fields(b"".join(head))
            size = _length(fields.get("content-length"))
            if size is None:
                continue
            block = stream.read(size)
            if len(block) < size:
                return
            kind = fields.get("warc-type", "")
            if kind not in ("response", "revisit"):
                continue
            top, _, body = block.partition(b"\r\n\r\n")
            status_line, _, rest = top.partition(b"\r\n")
            parts = status_line.split(None, 2)
            status = int(parts[1]) if len(parts) > 1 and re.fullmatch(b"[0-9]{1,9}", parts[1]) else None
            yield (
                fields.get("warc-record-id", "").strip("<>"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), fields.get("warc-profile"),
                status, list(_fields(rest).items()), hashlib.sha256(body).hexdigest(), len(body), body if payloads else None,
            )
    except (EOFError, zlib.error, gzip.BadGzipFile):
        return


def parse_column(files: DataFrame, column: str, payloads: bool = True) -> DataFrame:
    """The records (RECORDS) of all WARC files in a binary column. Null or empty files have none."""
    names = [f.split()[0] for f in RECORDS.replace("map<string,string>", "map").split(", ")]
    kinds = [pa.string()] * 5 + [pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.binary()]

    def run(batches):
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            rows, weight = [], 0
            for raw in batch.column(0):
                for r in parse(raw.as_py() or b"", payloads):
                    rows.append(r)
                    weight += r[8] + 500
                    if weight > 8 << 20:
                        yield batch_of(rows)
                        rows, weight = [], 0
            if rows:
                yield batch_of(rows)

    return files.select(column).mapInArrow(run, RECORDS)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all .warc and .warc.gz files under path. A file is parsed in one task, so it has to be below 2 GB, as crawlers write them."""
    return parse_column(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path), "content", payloads)


# -- resolution ------------------------------------------------------------------


def canonical_url(url: Column) -> Column:
    """Host in lower case without www, credentials and default port; path; sorted parameters that do not track. No scheme, no fragment."""
    plain = F.regexp_replace(F.regexp_replace(F.btrim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(plain, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, "^.*@", ""), "^www[0-9]*[.]", ""), ":(80|443)$", "")
    path = F.regexp_extract(plain, "^[^/?]*([^?]*)", 1)
    query = F.split(F.regexp_extract(plain, "[?](.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, F.when(path == "", "/").otherwise(path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(captures: DataFrame, ranges: int = 0) -> DataFrame:
    """Every not-modified revisit of captures with the full response it stands for.

    captures: record_id, type (response or revisit), url, date (ISO 8601), profile,
    status, headers (by lower-case name), payload_sha256, payload_bytes. More columns
    are ignored. Result: record_id, canonical_url, date, outcome, response_id,
    payload_sha256, payload_bytes, headers.

    The response is the latest strictly earlier one of status 200 with the same
    canonical URL; of equally late ones that with the largest id. outcome: resolved
    (entity tags equal in the weak sense or, without a tag on one side, equal
    Last-Modified), unvalidated (one side has no validators), mismatch or missing.
    Only resolved and unvalidated revisits get a payload and merged headers: the
    response's, updated by the revisit's except for KEPT_HEADERS; the others keep
    their own. Captures without URL or legible date resolve nothing and are missing.
    Rows that repeat an id are resolved each. An empty table gives no rows.
    """
    spark = captures.sparkSession
    at = F.unix_micros(F.try_to_timestamp(F.col("date")))
    full = (F.col("type") == "response") & (F.col("status") == 200)
    revisit = (F.col("type") == "revisit") & F.col("profile").eqNullSafe(NOT_MODIFIED)
    entries = F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string,string>"))))
    thin = captures.filter(full | revisit).select(
        "record_id", "date", canonical_url(F.col("url")).alias("canon"), at.alias("at"), revisit.alias("is_revisit"),
        F.col("headers").alias("own"), F.struct("record_id", "payload_sha256", "payload_bytes", entries.alias("entries")).alias("held"),
    )
    usable = F.col("canon").isNotNull() & F.col("at").isNotNull()
    parts = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    full_one = F.when(~F.col("is_revisit"), F.struct("at", "held"))
    dealt = written(thin.filter(usable).repartitionByRange(parts, "canon", "at").withColumn("part", F.spark_partition_id()), "warc-dealt")
    # what a URL has from earlier ranges: only the URLs at a range's ends lie in several
    several = dealt.groupBy("canon").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b").select("canon")
    ends = dealt.join(F.broadcast(several), "canon").groupBy("canon", "part").agg(F.max(full_one).alias("latest"))
    before = Window.partitionBy("canon").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = written(ends.select("canon", "part", F.max("latest").over(before).alias("carried")), "warc-carried")
    earlier = Window.partitionBy("part", "canon").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    found = dealt.withColumn("within", F.max(full_one).over(earlier)).filter("is_revisit").join(F.broadcast(carried), ["canon", "part"], "left")
    found = found.select("record_id", "date", "canon", "own", F.coalesce("within", "carried").getField("held").alias("full"))
    lost = thin.filter(~usable & F.col("is_revisit")).select("record_id", "date", "canon", "own", F.lit(None).cast(found.schema["full"].dataType).alias("full"))
    found = found.unionByName(lost)

    stored = F.map_from_entries("full.entries")
    own = F.coalesce("own", F.create_map().cast("map<string,string>"))
    found = found.withColumn("stored", stored).withColumn("own", own)
    tag, kept_tag, since, kept_since = F.col("own")["etag"], F.col("stored")["etag"], F.col("own")["last-modified"], F.col("stored")["last-modified"]
    outcome = (
        F.when(F.col("full").isNull(), "missing")
        .when(tag.isNotNull() & kept_tag.isNotNull(), F.when(_weak(tag) == _weak(kept_tag), "resolved").otherwise("mismatch"))
        .when(since.isNotNull() & kept_since.isNotNull(), F.when(since == kept_since, "resolved").otherwise("mismatch"))
        .otherwise("unvalidated")
    )
    taken = F.col("outcome").isin("resolved", "unvalidated")
    updates = F.map_filter("own", lambda k, _: ~k.isin(*KEPT_HEADERS))
    rest = F.map_filter("stored", lambda k, _: ~F.array_contains(F.map_keys(updates), k))
    return found.withColumn("outcome", outcome).select(
        "record_id", F.col("canon").alias("canonical_url"), "date", "outcome",
        F.when(taken, F.col("full.record_id")).alias("response_id"),
        F.when(taken, F.col("full.payload_sha256")).alias("payload_sha256"),
        F.when(taken, F.col("full.payload_bytes")).alias("payload_bytes"),
        F.when(taken, F.map_concat(rest, updates)).otherwise(F.col("own")).alias("headers"),
    )
