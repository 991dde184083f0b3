"""WARC archives: write page captures, read them back, assemble transactions.

``write_captures`` turns each page into three records (request, response or
revisit, metadata) that name each other through WARC-Concurrent-To and writes
them with Spark's own committed file output, one WARC stream per file (records
end in CRLF CRLF, which is the writer's line separator). ``read_records``
parses archives, plain or gzip, back into one row per record.
``assemble`` joins the records of a transaction through their concurrent-to
identifiers and emits one nested row per capture.

Of pages with equal payloads (SHA-1) of at least ``min_revisit_bytes`` the one
with the smallest page_id is the response and the others are revisits without
a body; smaller payloads are always responses.

Defined results: a null html is an empty payload; a null url gives no target
URI; CR, LF and blanks in a url are percent-encoded in the header; rows that
share the smallest page_id of a payload are all responses; a null page_id
counts as the largest; repeated rows give repeated captures; records without a capture keep their own row with a null
capture; an empty table writes no record and reads back no row; other columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.llm.common import cut, table
from weftmix.session import scratch_path

#: Fixed values of the format.
VERSION = "WARC/1.1"
CRLF = "\r\n"
END = CRLF * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORDS_PER_FILE = 20_000
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"

RECORD_SCHEMA = ("record_id string, record_type string, concurrent_to string, target_uri string, refers_to string, "
                 "digest string, payload_bytes long, fields map<string,string>, payload binary")


def sha1_base32(c: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes: 40 bits a time."""
    hexed = F.sha1(c.cast("binary"))
    return F.concat(*[
        F.translate(F.lpad(F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 32), 8, "0"), BASE32_HEX, BASE32)
        for i in range(4)])


def _header(kind: str, record_id: Column, extra: list[tuple[str, Column]], block: Column) -> Column:
    parts = [F.lit(f"{VERSION}{CRLF}WARC-Type: {kind}{CRLF}WARC-Date: {DATE}{CRLF}WARC-Record-ID: "), record_id, F.lit(CRLF)]
    for name, value in extra:
        parts.append(F.coalesce(F.concat(F.lit(name + ": "), value, F.lit(CRLF)), F.lit("")))
    parts += [F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block]
    return F.concat(*parts)


def _id(key: Column, kind: str) -> Column:
    h = F.md5(F.concat(key, F.lit("/" + kind)))
    return F.concat(F.lit("<urn:uuid:"), *[x for i, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
                                           for x in ([F.lit("-")] if i else []) + [F.substring(h, a, n)]], F.lit(">"))


def capture_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """(record): the text of every WARC record, three per page. ``pages`` is
    read twice; a row's place in it is part of its records' identifiers, so
    that a repeated row is a capture of its own."""
    rows = (pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.monotonically_increasing_id().alias("row"))
            .withColumn("n", F.octet_length("html")).withColumn("digest", sha1_base32(F.col("html"))))
    first = cut(rows.filter(F.col("n") >= min_revisit_bytes).groupBy("digest")
                .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")).alias("first"), F.count(F.lit(1)).alias("copies"))
                .filter("copies > 1").select(F.col("digest").alias("d"), F.col("first.page_id").alias("first_id"),
                                             F.col("first.row").alias("first_row")))
    # both sides of this join are plain exchanges, so a hot payload can be split
    rows = rows.join(first, rows["digest"] == first["d"], "left")
    again = F.col("d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))

    def key(page, row):
        return F.concat(F.coalesce(F.col(page).cast("string"), F.lit("null")), F.lit("#"), F.col(row).cast("string"))
    rows = rows.select("*", again.alias("again"), key("page_id", "row").alias("key"))
    rid, qid, mid = (_id(F.col("key"), x) for x in ("response", "request", "metadata"))
    uri = ("WARC-Target-URI", F.replace(F.replace(F.replace(
        F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20")))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
                    F.col("n").cast("string"), F.lit(END))
    digest = ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest")))
    kind = ("Content-Type", F.lit("application/http; msgtype=response"))
    response = _header("response", rid, [uri, digest, kind], F.concat(http, F.col("html")))
    revisit = _header("revisit", rid, [
        uri, digest, kind, ("WARC-Profile", F.lit(PROFILE)),
        ("WARC-Refers-To", _id(key("first_id", "first_row"), "response"))], http)
    request = _header("request", qid, [uri, ("WARC-Concurrent-To", rid),
                                       ("Content-Type", F.lit("application/http; msgtype=request"))],
                      F.lit(f"GET / HTTP/1.1{END}"))
    metadata = _header("metadata", mid, [uri, ("WARC-Concurrent-To", rid), ("Content-Type", F.lit("application/warc-fields"))],
                       F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit(CRLF)))
    return rows.select(F.explode(F.array(request, F.when(F.col("again"), revisit).otherwise(response), metadata)).alias("record"))


def write_captures(pages: DataFrame, path: str, min_revisit_bytes: int = MIN_REVISIT_BYTES, compression: str = "gzip") -> str:
    """Write the archives under ``path``; a lost task is written again whole."""
    (capture_records(pages, min_revisit_bytes).write.mode("errorifexists")
     .option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path))
    return path


def _head(block: bytes) -> tuple[str, dict[str, str]]:
    lines = block.decode("utf-8", "replace").split(CRLF)
    return lines[0], {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def _unzipped(data: bytes) -> bytes:
    """All gzip members of ``data``, or ``data`` itself when it isn't gzip."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        d = zlib.decompressobj(31)
        out += [d.decompress(data), d.flush()]
        data = d.unused_data
    return b"".join(out)


def parse_archive(data: bytes):
    """Yield one dict per record of a WARC file's bytes, by Content-Length."""
    data, at = _unzipped(data), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        body = data.find(b"\r\n\r\n", at)
        if body < 0:
            return
        _, h = _head(data[at:body])
        body += 4
        end = body + int(h.get("content-length", 0))
        block, kind = data[body:end], h.get("warc-type")
        out = {"record_id": h.get("warc-record-id"), "record_type": kind, "concurrent_to": h.get("warc-concurrent-to"),
               "target_uri": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"), "payload": None,
               "digest": (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, "payload_bytes": None}
        fields = {}
        if kind in ("response", "revisit", "request"):
            head, sep, payload = block.partition(b"\r\n\r\n")
            _, fields = _head(head)
            if kind == "response":
                out |= {"payload": payload, "payload_bytes": len(payload),
                        "digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()}
            elif kind == "revisit" and fields.get("content-length", "").isdigit():
                out["payload_bytes"] = int(fields["content-length"])
        elif kind in ("metadata", "warcinfo"):
            _, fields = _head(CRLF.encode() + block)
        yield out | {"fields": list(fields.items())}
        at = end


_ARROW = pa.schema([(x, pa.string()) for x in ("record_id", "record_type", "concurrent_to", "target_uri", "refers_to", "digest")]
                   + [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])


def _parse(batches, rows: int = 256):
    for batch in batches:
        for data in batch.column("content"):
            held = []
            for r in parse_archive(data.as_py()):
                held.append(r)
                if len(held) == rows:
                    yield pa.RecordBatch.from_pylist(held, _ARROW)
                    held = []
            yield pa.RecordBatch.from_pylist(held, _ARROW)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of every archive under ``path``. An archive is read
    whole by one task, so its size (RECORDS_PER_FILE here) bounds the memory."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parse, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per transaction: capture (response or revisit), request
    and a list of metadata records, joined through concurrent-to. Any of the
    three may be the one that the others name; a record that names a record
    which itself names another follows it once."""
    named = records.select("*", F.coalesce("concurrent_to", "record_id").alias("to"))
    links = (records.filter(F.col("concurrent_to").isNotNull() & (F.col("concurrent_to") != F.col("record_id")))
             .groupBy(F.col("record_id").alias("to")).agg(F.min("concurrent_to").alias("next")))
    r = F.struct(*[c for c in records.columns if c != "concurrent_to"])

    def one(*kinds):
        return F.min_by(F.when(F.col("record_type").isin(*kinds), r), F.when(F.col("record_type").isin(*kinds), F.col("record_id")))
    return (named.join(links, "to", "left").withColumn("transaction", F.coalesce("next", "to"))
            .groupBy("transaction").agg(one("response", "revisit").alias("capture"), one("request").alias("request"),
                                        F.collect_list(F.when(F.col("record_type") == "metadata", r)).alias("metadata")))


def captures_digest(captures: DataFrame) -> DataFrame:
    """Per capture: page_id, payload_bytes, payload_digest, record_type and the
    page_id that a revisit refers to, through its WARC-Refers-To record."""
    flat = cut(captures.filter(F.col("capture").isNotNull()).select(
        F.get("metadata", F.lit(0))["fields"]["page-id"].cast("bigint").alias("page_id"),
        F.col("capture.payload_bytes").alias("payload_bytes"), F.col("capture.digest").alias("payload_digest"),
        F.col("capture.record_type").alias("record_type"), F.col("capture.record_id").alias("record_id"),
        F.col("capture.refers_to").alias("refers_to_record")))
    target = flat.filter("record_type = 'response'").select(F.col("record_id").alias("r"), F.col("page_id").alias("refers_to"))
    target = cut(target.join(flat.filter("refers_to_record is not null").select(F.col("refers_to_record").alias("r")).distinct(), "r"))
    return flat.join(target, flat["refers_to_record"] == target["r"], "left").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_captures(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return captures_digest(assemble(read_records(spark, path).drop("payload")))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id,
             list_transform([1, 11, 21, 31], lambda i: ('0x' || substr(h, i, 10))::BIGINT) AS v FROM d)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           ((v[1 + i // 8] >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f"""
