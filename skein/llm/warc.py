"""WARC records, and resolution of revisits that a server answered with "not modified".

A revisit has no payload of its own. It is resolved by an as-of join: the latest full response of the same canonical URL
before it, if the validators of both agree. The resolved record has the response's headers, updated by those that the
revisit may change.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .staging import stage

#: Headers of a stored response that a "not modified" answer doesn't change, and those of one connection.
NOT_MERGED = (
    "content-length content-encoding content-type content-range transfer-encoding connection keep-alive te trailer "
    "upgrade proxy-authenticate proxy-authorization"
).split()
#: Query parameters that don't name a page.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"

#: Bytes of a file that are inflated at once.
PART = 1 << 20

_HEADERS = pa.map_(pa.string(), pa.string())
RECORD = pa.schema(
    [("source_key", pa.int64()), ("ordinal", pa.int64())]
    + [(n, pa.string()) for n in ("warc_type", "record_id", "url", "date", "profile", "digest")]
    + [("status", pa.int64()), ("headers", _HEADERS), ("payload_bytes", pa.int64()), ("payload_crc32", pa.int64()), ("payload", pa.binary())]
)
RECORD_DDL = (
    "source_key long, ordinal long, warc_type string, record_id string, url string, date string, profile string, digest string, "
    "status long, headers map<string,string>, payload_bytes long, payload_crc32 long, payload binary"
)


def _fields(block: bytes) -> tuple[str, dict[str, str]]:
    """The first line, and the named fields with lower-case names; a repeated name's values are joined by a comma."""
    lines = block.decode("utf-8", "replace").split("\r\n")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            key = name.strip().lower()
            fields[key] = f"{fields[key]}, {value.strip()}" if key in fields else value.strip()
    return lines[0], fields


def _inflated(data: bytes) -> Iterator[bytes]:
    """The bytes of a plain or gzip file (of one or many members) in parts of PART bytes; ends where the file is broken."""
    view = memoryview(data)
    if data[:2] != b"\x1f\x8b":
        yield from (bytes(view[k : k + PART]) for k in range(0, len(view), PART))
        return
    at, member = 0, zlib.decompressobj(31)
    rest = b""
    while at < len(view) or rest:
        if not rest:
            rest = bytes(view[at : at + PART])
            at += PART
        try:
            part = member.decompress(rest, PART)
        except zlib.error:
            return
        if part:
            yield part
        if member.eof:
            rest, member = member.unused_data, zlib.decompressobj(31)
        else:
            rest = member.unconsumed_tail


def _whole_number(text: str, digits: str) -> int | None:
    return int(text) if re.fullmatch(f"[0-9]{digits}", text) else None


def read_records(data: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or gzip (also one member per record).

    Reading ends at a broken tail: compressed data that can't be read on, a head without an end, a length that is no
    number, or a block that is shorter than its length. Records before it are given. A file is inflated as it is read;
    beside it one record is in memory. A status that isn't three digits is null.
    """
    parts = _inflated(data)
    held = bytearray()

    def find(what: bytes, begin: int) -> int:
        while (at := held.find(what, begin)) < 0:
            begin = max(begin, len(held) - len(what) + 1)
            part = next(parts, None)
            if part is None:
                return -1
            held.extend(part)
        return at

    while (at := find(b"WARC/", 0)) >= 0:
        del held[:at]
        end = find(b"\r\n\r\n", 0)
        if end < 0:
            return
        _, fields = _fields(bytes(held[:end]))
        length = _whole_number(fields.get("content-length", ""), "{1,15}")
        if length is None:
            return
        stop = end + 4 + length
        while len(held) < stop:
            part = next(parts, None)
            if part is None:
                return
            held.extend(part)
        block = bytes(held[end + 4 : stop])
        del held[:stop]
        status, headers, payload = None, {}, block
        if "msgtype=response" in fields.get("content-type", ""):
            head, _, payload = block.partition(b"\r\n\r\n")
            first, headers = _fields(head)
            status = _whole_number("".join(first.split(" ")[1:2]), "{3}")
        yield {
            "warc_type": fields.get("warc-type"),
            "record_id": fields.get("warc-record-id"),
            "url": fields.get("warc-target-uri"),
            "date": fields.get("warc-date"),
            "profile": fields.get("warc-profile"),
            "digest": fields.get("warc-payload-digest"),
            "status": status,
            "headers": list(headers.items()),
            "payload_bytes": len(payload),
            "payload_crc32": zlib.crc32(payload),
            "payload": payload,
        }


def parse_warc(files: DataFrame, key_col: str, data_col: str, *, with_payload: bool = True) -> DataFrame:
    """One row per record of each WARC file (a binary column); nulls and bytes without records give no rows."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for key, data in zip(*batch.columns):
                for k, record in enumerate(read_records(data.as_py() or b"")):
                    size += record["payload_bytes"] if with_payload else 500
                    rows.append(record | {"source_key": key.as_py(), "ordinal": k} | ({} if with_payload else {"payload": None}))
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, RECORD)

    part = files.select(F.col(f"`{key_col}`").cast("long").alias("source_key"), F.col(f"`{data_col}`").cast("binary").alias("data"))
    return part.mapInArrow(parse, RECORD_DDL)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of all WARC files under ``path``; the key is a hash of the file's name.

    Spark hands a file over in one row as it is stored, so a file may have 2 GB; it is inflated as it is read.
    """
    files = spark.read.format("binaryFile").load(path)
    return parse_warc(files.select(F.xxhash64("path").alias("key"), "content"), "key", "content")


def warc_bytes(
    kind: Column, record_id: Column, url: Column, date: Column, status_line: Column, headers: Column, payload: Column, profile: Column
) -> Column:
    """A WARC record as binary, from columns: ``headers`` is one string of ``name: value`` lines, each ended by CR LF."""
    block = F.concat(F.encode(F.concat(status_line, F.lit("\r\n"), headers, F.lit("\r\n")), "UTF-8"), payload)
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), record_id, F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Date: "), date, F.when(profile.isNotNull(), F.concat(F.lit("\r\nWARC-Profile: "), profile)).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(F.encode(head, "UTF-8"), block, F.encode(F.lit("\r\n\r\n"), "UTF-8"))


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.``, default port or user; no scheme, fragment, tracking parameters or final slash.

    Parameters are sorted. Null stays null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^(?:[^/?@]*@)?([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), "^www\\.", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[^/?]*([^?]*)", 1), "/index\\.html?$", "/"), "(?<!/)/+$", "")
    query = F.array_sort(
        F.filter(F.split(F.regexp_extract(bare, "\\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))
    )
    return F.concat(host, path, F.when(F.size(query) > 0, F.concat(F.lit("?"), F.array_join(query, "&"))).otherwise(F.lit("")))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve_revisits(records: DataFrame, chunk: str = "day") -> DataFrame:
    """One row per revisit: its record_id, url, canonical, date, outcome, refers_to, and the response's payload and merged headers.

    ``outcome``: resolved; validator_mismatch (entity tags differ, compared weakly; without tags on both sides, dates of
    last modification; without those, payload digests); unverified (nothing to compare; refers_to is still given); or
    no_earlier_response. "Earlier" is strictly before; among responses of one moment the greatest record id counts. A
    revisit without a readable date or URL has no earlier response. Repeated revisits stay repeated. The join runs in two
    levels, within chunks of time and over the last responses of chunks, so that a URL with very many captures is no
    single task. Records are read once: what is needed of them is written to the shared folder. Payloads don't travel:
    ``attach_payload`` fetches them by refers_to. No records, or none that are revisits, give no rows.
    """
    ts = F.unix_micros(F.try_to_timestamp("date"))
    rows = records.select(
        "record_id",
        "url",
        "date",
        canonical_url(F.col("url")).alias("canonical"),
        ts.alias("ts"),
        (F.col("warc_type") == "revisit").alias("is_revisit"),
        "warc_type",
        "status",
        "headers",
        "digest",
        "payload_bytes",
        "payload_crc32",
    ).where("warc_type = 'revisit' or (warc_type = 'response' and status = 200)")
    rows = stage(rows.withColumn("chunk", F.date_trunc(chunk, F.timestamp_micros("ts"))), "records")
    response = F.when(
        ~F.col("is_revisit") & F.col("ts").isNotNull() & F.col("canonical").isNotNull(),
        F.struct("record_id", "headers", "digest", "payload_bytes", "payload_crc32"),
    )
    order = F.struct("ts", "record_id")
    last = F.max_by(response, F.when(response.isNotNull(), order))
    within = Window.partitionBy("canonical", "chunk").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", last.over(within)).where("is_revisit").drop("is_revisit")
    ends = rows.where("not is_revisit").groupBy("canonical", "chunk").agg(last.alias("end"), F.lit(True).alias("has"))
    marks = ends.unionByName(
        rows.where("is_revisit").select("canonical", "chunk").distinct(), allowMissingColumns=True
    ).groupBy("canonical", "chunk").agg(F.max_by("end", "has").alias("end"))
    earlier = marks.select(
        F.col("canonical").alias("c"),
        F.col("chunk").alias("k"),
        F.last("end", ignorenulls=True)
        .over(Window.partitionBy("canonical").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
        .alias("far"),
    )
    found = near.join(earlier, (F.col("canonical") == F.col("c")) & (F.col("chunk") == F.col("k")), "left").withColumn(
        "hit", F.when(F.col("ts").isNotNull(), F.coalesce("near", "far"))
    )
    own, old = F.col("headers"), F.col("hit.headers")
    tag, old_tag = own["etag"], old["etag"]
    changed, old_changed = own["last-modified"], old["last-modified"]
    agree = (
        F.when(tag.isNotNull() & old_tag.isNotNull(), _weak(tag) == _weak(old_tag))
        .when(changed.isNotNull() & old_changed.isNotNull(), changed == old_changed)
        .when(F.col("digest").isNotNull() & F.col("hit.digest").isNotNull(), F.col("digest") == F.col("hit.digest"))
    )
    outcome = (
        F.when(F.col("hit").isNull(), "no_earlier_response")
        .when(agree.isNull(), "unverified")
        .when(agree, "resolved")
        .otherwise("validator_mismatch")
    )
    new = F.map_filter(own, lambda k, v: ~k.isin(NOT_MERGED))
    merged = F.map_concat(F.map_filter(old, lambda k, v: ~F.coalesce(F.map_contains_key(new, k), F.lit(False))), new)
    done = F.col("outcome") == "resolved"
    return found.withColumn("outcome", outcome).select(
        "record_id",
        "url",
        "canonical",
        "date",
        "outcome",
        F.when(F.col("outcome").isin("resolved", "unverified"), F.col("hit.record_id")).alias("refers_to"),
        F.when(done, merged).alias("headers"),
        F.when(done, F.col("hit.payload_bytes")).alias("payload_bytes"),
        F.when(done, F.col("hit.payload_crc32")).alias("payload_crc32"),
    )


def attach_payload(resolved: DataFrame, records: DataFrame) -> DataFrame:
    """Resolved revisits with the payload bytes of the responses that they refer to."""
    payloads = records.where("warc_type = 'response'").select(F.col("record_id").alias("__r"), "payload")
    return resolved.join(payloads, F.col("refers_to") == F.col("__r"), "left").drop("__r")
