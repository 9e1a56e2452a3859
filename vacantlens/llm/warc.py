"""WARC archives: write captures, read records back, assemble each capture's transaction.

A capture is three records: the request, the response (or a revisit of an earlier-named payload)
and a metadata record; request and metadata name the response in WARC-Concurrent-To. Archives
are gzipped WARC/1.1 files, written by Spark's text writer (a row is one capture, the separator
ends its last record) and read whole as binary files, by Content-Length, so any payload is safe;
plain files are read too. One file holds one task's rows, or ``files`` sets their number, for
which ``files_of`` aims at FILE_BYTES.

Defined cases: a null payload is empty; a null URI is written as an empty one and read as null;
a null page_id is written as an empty one and read as null; rows that repeat a page_id and
payload are captures of their own, of which one is the response; a record that names no known
response makes no capture; an empty table writes no archive and gives no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vacantlens.llm.columns import once
from vacantlens.session import scratch_path

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Payload bytes per archive file, on average.
FILE_BYTES = 16 << 20
#: Parts a group of equal payloads is dealt over.
SALTS = 32
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = (
    "record_id string, record_type string, concurrent_to string, refers_to string, uri string, date string, "
    "declared_digest string, http_head string, payload_bytes long, payload_digest string, payload binary, fields map<string,string>"
)


def base32(digest: Column) -> Column:
    """Upper-case base32 of a digest of 40 hexadecimal digits."""
    bits = [F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int") for k in range(8)]
    letter = lambda value: F.substring(F.lit(BASE32), value + 1, F.lit(1))
    return F.concat(*[letter(F.shiftright(b, s).bitwiseAND(F.lit(31))) for b in bits for s in (15, 10, 5, 0)])


def captures(pages: DataFrame, page_id: str = "page_id", uri: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """One row per page with its record type: of equal payloads of ``least_bytes`` or more, one
    page with the largest page_id is the response, the others revisit it."""
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(uri).alias("uri"), F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = once(once(rows, "_hex", F.sha1("payload")), "digest", base32(F.col("_hex"))).drop("_hex")
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("long"))
    # Counted per page and payload first: groups of equal payloads can be very large.
    keyed = rows.groupBy("digest", "bytes", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = keyed.groupBy("digest", "bytes").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("n"))
    several = groups.where((F.col("n") > 1) & (F.col("bytes") >= least_bytes)).select("digest", "bytes", F.col("top.page_id").alias("last"), F.col("top.n").alias("times"))
    # A payload's pages are dealt over SALTS parts, so that a hot payload does not meet in one
    # task; the repeats of one page stay together and the first of them is the response.
    salt = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")
    spread = several.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    marked = rows.withColumn("salt", salt).join(spread, ["digest", "bytes", "salt"], "left")
    again = W.partitionBy("digest", "bytes", "salt", "page_id").orderBy("uri")
    at_last = F.col("page_id").eqNullSafe(F.col("last")) & (F.row_number().over(again) == 1)
    typed = marked.withColumn("copy", F.when(F.col("times").isNull() | at_last, 1).otherwise(0))
    response = F.col("copy") == 1
    return typed.select(
        "page_id",
        "uri",
        "payload",
        "bytes",
        "digest",
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        F.when(~response, F.col("last")).alias("refers_to"),
    )


def _record(kind: str, head: list[Column | str], block: Column) -> Column:
    lines = [F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in line]) for line in head]
    top = F.concat_ws(CRLF, F.lit("WARC/1.1"), F.lit(f"WARC-Type: {kind}") if kind else lines.pop(0), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(top, F.lit(CRLF * 2), block)


def write_archives(rows: DataFrame, path: str, date: str = "2020-01-01T00:00:00Z", files: int | None = None) -> None:
    """Write the rows of ``captures`` as archives under ``path``."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    # A response is named by page and digest; a draw tells revisits of one page apart.
    revisits = F.col("record_type") == "revisit"
    unique = rows.withColumn("_key", F.concat_ws(":", page, "digest", F.when(revisits, F.uuid())))
    key = F.col("_key")
    ident = lambda part: F.concat(F.lit("<urn:capture:"), key, F.lit(f":{part}>"))
    uri = F.regexp_replace(F.coalesce(F.col("uri"), F.lit("")), r"[\r\n]", " ")
    when = F.lit(f"WARC-Date: {date}")
    common = [[F.lit("WARC-Target-URI: "), uri], [when]]
    request_block = F.concat(F.lit(f"GET / HTTP/1.1{CRLF}X-Target: "), uri, F.lit(CRLF * 2))
    request = _record(
        "request",
        [[F.lit("WARC-Record-ID: "), ident("request")], *common, [F.lit("WARC-Concurrent-To: "), ident("response")], ["Content-Type: application/http; msgtype=request"]],
        request_block,
    )
    head = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("bytes").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisits, head).otherwise(F.concat(head, F.col("payload")))
    body = [[F.lit("WARC-Record-ID: "), ident("response")], *common, [F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")]]
    response = _record("response", [*body, ["Content-Type: application/http; msgtype=response"]], block)
    revisit = _record(
        "revisit",
        [*body, [f"WARC-Profile: {REVISIT}"], [F.lit("WARC-Refers-To: <urn:capture:"), F.coalesce(F.col("refers_to").cast("string"), F.lit("")), F.lit(":"), F.col("digest"), F.lit(":response>")], ["Content-Type: application/http; msgtype=response"]],
        block,
    )
    metadata = _record(
        "metadata",
        [[F.lit("WARC-Record-ID: "), ident("metadata")], *common, [F.lit("WARC-Concurrent-To: "), ident("response")], ["Content-Type: application/warc-fields"]],
        F.concat(F.lit("page-id: "), page, F.lit(CRLF)),
    )
    value = F.concat_ws(CRLF * 2, request, F.when(revisits, revisit).otherwise(response), metadata)
    out = unique.select(value.alias("value"))
    if files:
        out = out.repartition(files)
    out.write.option("lineSep", CRLF * 2).text(path, compression="gzip")


def files_of(rows: DataFrame) -> int:
    """Archive files for the rows of ``captures`` at FILE_BYTES each; 0 without rows."""
    count, total = rows.agg(F.count(F.lit(1)), F.sum(F.when(F.col("record_type") == "response", F.col("bytes")).otherwise(0) + 1500)).first()
    return max(1, -(-int(total or 0) // FILE_BYTES)) if count else 0


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of one archive, in order. Raises ValueError where a record is broken or cut off."""
    at, end = 0, len(data)
    while at < end:
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        stop = data.find(b"\r\n\r\n", at)
        lines = data[at : stop if stop >= 0 else end].decode("utf-8", "replace").split("\r\n")
        if stop < 0 or not lines[0].startswith("WARC/"):
            raise ValueError(f"no record head at byte {at}")
        fields = {}
        for line in lines[1:]:
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        start = stop + 4
        at = start + int(fields["content-length"])
        if at > end:
            raise ValueError(f"record cut off at byte {end}")
        yield {"fields": fields, "block": memoryview(data)[start:at]}


def _http(block: memoryview) -> tuple[str, memoryview]:
    """(head, body) of an HTTP message; without an empty line all of it is head."""
    raw = bytes(block[: 1 << 16])
    stop = raw.find(b"\r\n\r\n")
    if stop < 0 and len(block) > len(raw):
        raw = bytes(block)
        stop = raw.find(b"\r\n\r\n")
    if stop < 0:
        return raw.decode("utf-8", "replace"), block[len(block) :]
    return raw[:stop].decode("utf-8", "replace"), block[stop + 4 :]


def _head_length(head: str) -> int | None:
    for line in head.split("\r\n")[1:]:
        name, _, value = line.partition(":")
        if name.strip().lower() == "content-length" and value.strip().isdigit():
            return int(value)
    return None


def _row(record: dict, payloads: bool) -> dict:
    fields, block = record["fields"], record["block"]
    head, body = _http(block) if "application/http" in fields.get("content-type", "") else (None, block)
    declared = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    kind = fields.get("warc-type")
    if kind == "revisit":  # the payload is elsewhere; its size and digest are declared
        size, digest = _head_length(head or ""), declared
    else:
        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
    own = {}
    if "warc-fields" in fields.get("content-type", ""):
        for line in bytes(block).decode("utf-8", "replace").split("\r\n"):
            name, colon, value = line.partition(":")
            if colon:
                own[name.strip()] = value.strip()
    return {
        "record_id": fields.get("warc-record-id"),
        "record_type": kind,
        "concurrent_to": fields.get("warc-concurrent-to"),
        "refers_to": fields.get("warc-refers-to"),
        "uri": fields.get("warc-target-uri") or None,
        "date": fields.get("warc-date"),
        "declared_digest": declared,
        "http_head": head,
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": bytes(body) if payloads and kind != "revisit" else None,
        "fields": list(own.items()),
    }


_ARROW = pa.schema(
    [
        *[(n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "refers_to", "uri", "date", "declared_digest", "http_head")],
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("payload", pa.binary()),
        ("fields", pa.map_(pa.string(), pa.string())),
    ]
)


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives under ``path``. A response whose payload differs from its
    declared digest stops the job. ``payloads`` False leaves the payload null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                data = content.as_py()
                if name.as_py().endswith(".gz"):
                    data = gzip.decompress(data)
                rows, size = [], 0
                for record in parse_records(data):
                    row = _row(record, payloads)
                    if row["record_type"] == "response" and row["declared_digest"] not in (None, row["payload_digest"]):
                        raise ValueError(f"payload of {row['record_id']} differs from its digest")
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 2000 or size >= 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit with the request and the metadata
    records that are concurrent to it (arrays; empty where there are none)."""
    part = F.struct("record_id", "uri", "date", "http_head", "payload_bytes", "payload_digest", "payload", "fields")
    main = records.where(F.col("record_type").isin("response", "revisit")).select(
        F.col("record_id").alias("capture_id"), F.col("record_type").alias("kind"), "uri", "date", "refers_to", part.alias("response")
    )
    linked = records.where(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    asked = F.struct("record_id", "http_head", "payload", "fields")
    gathered = linked.groupBy(F.col("concurrent_to").alias("capture_id")).agg(
        F.collect_list(F.when(F.col("record_type") == "request", asked)).alias("requests"),
        F.collect_list(F.when(F.col("record_type") == "metadata", asked)).alias("metadata"),
    )
    none = F.array().cast("array<struct<record_id:string,http_head:string,payload:binary,fields:map<string,string>>>")
    return main.join(gathered, "capture_id", "left").select(
        "capture_id", "kind", "uri", "date", "refers_to", "response", F.coalesce("requests", none).alias("requests"), F.coalesce("metadata", none).alias("metadata")
    )


def archived_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write every page to archives, read them back and give the captures' digests by page_id."""
    spark = pages.sparkSession
    rows = captures(pages, least_bytes=least_bytes)
    path = scratch_path(spark, "warc")
    write_archives(rows, path)
    whole = transactions(read_records(spark, path, payloads=False))
    return whole.select(
        F.expr("try_cast(metadata[0].fields['page-id'] AS bigint)").alias("page_id"),
        F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.when(F.col("kind") == "revisit", F.expr("try_cast(regexp_extract(refers_to, '^<urn:capture:(-?[0-9]+):', 1) AS bigint)")).alias("refers_to"),
    )
