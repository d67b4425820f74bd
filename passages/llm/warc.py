"""WARC archives: written from pages, read back, and assembled into one nested row per capture.

A capture is a request, a response (or a revisit of an earlier equal payload) and a metadata record.
The records name each other by concurrent-to identifiers; assembly joins them on these, and revisits
find their payload through refers-to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passages.session import shared_dir
from passages.sources.tables import stage

CRLF = "\r\n"
# Captures in one archive file. A file is read as a whole, so it must stay well below 2 GB.
CAPTURES_PER_FILE = 5_000
EPOCH = "1970-01-01T00:00:00Z"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_DIGITS, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

RECORD = (
    "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, "
    "payload_digest string, payload_bytes bigint, fields map<string,string>, payload binary"
)


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a string's UTF-8 bytes."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), BASE32_DIGITS, BASE32)


def _urn(name: Column) -> Column:
    """Record identifier made from a text."""
    h = F.md5(name)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(headers: list[tuple[str, Column]], block: Column) -> Column:
    """A record but for its last line end, which the text writer adds. Null headers are left out."""
    lines = [F.concat(F.lit(name + ": "), value) for name, value in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines, length), F.lit(CRLF * 2), block, F.lit(CRLF))


def capture_roles(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """(payload_key, response_id): the page that answers for each payload of at least ``revisit_from`` bytes.

    ``pages`` has page_id and html, nulls as empty.
    """
    sized = pages.where(F.octet_length("html") >= revisit_from)
    return sized.groupBy(F.sha2("html", 256).alias("payload_key")).agg(F.max("page_id").alias("response_id"))


def write_archives(
    pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
    revisit_from: int = 0, date: str = EPOCH, captures: int = CAPTURES_PER_FILE,
) -> None:
    """Write three records per page into gzip-compressed archives in the folder ``path``.

    Of pages with equal payloads of at least ``revisit_from`` bytes, the one with the largest key is
    the response and the others revisit it; shorter payloads are all responses. A null payload is
    empty. A null url is written as a URN, line ends in urls are escaped. Pages with a null key are
    revisits where another page has their payload, and responses otherwise.
    """
    rows = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html")
    )
    roles = stage(capture_roles(rows, revisit_from), "warc-roles")
    named = rows.withColumn("payload_key", F.sha2("html", 256)).join(roles, "payload_key", "left")
    revisit = F.col("response_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    named = named.withColumns(
        {
            "revisit": revisit,
            "digest": F.concat(F.lit("sha1:"), base32_sha1(F.col("html"))),
            "request_id": F.concat(F.lit("<urn:uuid:"), F.expr("uuid()"), F.lit(">")),
            "answer_id": _urn(F.concat(F.lit("response "), "payload_key", F.coalesce(F.col("response_id").cast("string"), F.lit("")))),
        }
    )
    uri = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    uri = F.coalesce(uri, F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    common = [("WARC-Target-URI", uri), ("WARC-Date", F.lit(date))]
    asked = F.concat(
        F.lit("GET "), uri, F.lit(f" HTTP/1.1{CRLF}Host: "), F.regexp_extract(uri, r"^[^:]*://([^/?#]*)", 1), F.lit(CRLF * 2)
    )
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length("html").cast("string"), F.lit(CRLF * 2),
    )
    own_id = F.when(F.col("revisit"), _urn(F.concat(F.lit("revisit "), "request_id"))).otherwise(F.col("answer_id"))
    request = _record(
        [("WARC-Type", F.lit("request")), ("WARC-Record-ID", F.col("request_id")), *common,
         ("Content-Type", F.lit("application/http;msgtype=request"))],
        asked,
    )
    answer = _record(
        [("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")), ("WARC-Record-ID", own_id), *common,
         ("WARC-Concurrent-To", F.col("request_id")),
         ("WARC-Refers-To", F.when(F.col("revisit"), F.col("answer_id"))),
         ("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
         ("WARC-Payload-Digest", F.col("digest")), ("Content-Type", F.lit("application/http;msgtype=response"))],
        F.concat(head, F.when(F.col("revisit"), "").otherwise(F.col("html"))),
    )
    notes = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit("")))
    metadata = _record(
        [("WARC-Type", F.lit("metadata")), ("WARC-Record-ID", _urn(F.concat(F.lit("metadata "), "request_id"))), *common,
         ("WARC-Concurrent-To", F.col("request_id")), ("Content-Type", F.lit("application/warc-fields"))],
        notes,
    )
    records = named.select(F.explode(F.array(request, answer, metadata)).alias("value"))
    (
        records.write.option("lineSep", CRLF)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", 3 * captures)
        .text(path)
    )


def _lines(text: bytes) -> dict[str, str]:
    """name: value lines as a map with lower-case names."""
    pairs = (line.partition(":") for line in text.decode("utf-8", "replace").split(CRLF))
    return {name.strip().lower(): value.strip() for name, colon, value in pairs if colon}


def parse_records(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, plain or in gzip members of any size."""
    source = io.BytesIO(archive)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=source)) if archive[:2] == b"\x1f\x8b" else source
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record starts with {line[:40]!r}")
        head = b""
        while (line := stream.readline()).strip():
            head += line
        headers = _lines(head)
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) < length:
            raise ValueError("the archive ends within a record")
        yield headers, block


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record in the archives of a folder; see RECORD.

    The payload is the HTTP body of a response, its digest and length are taken from the bytes read.
    For a revisit they are those of its headers, where given, and null. ``payloads`` says whether
    the payload itself is returned.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for headers, block in parse_records(content.as_py()):
                    rows.append(_row(headers, block, payloads))
                    held += len(block)
                    if held > 1 << 23 or len(rows) >= 10_000:
                        yield _batch(rows)
                        rows, held = [], 0
                yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(read, RECORD)


def _row(headers: dict[str, str], block: bytes, payloads: bool) -> tuple:
    kind = headers.get("warc-type", "")
    payload, digest, size, fields = None, headers.get("warc-payload-digest", "").rpartition(":")[2] or None, None, {}
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
        digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
    elif kind == "metadata":
        fields = _lines(block)
    return (
        headers.get("warc-record-id"), kind, headers.get("warc-target-uri"), headers.get("warc-date"),
        headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), digest, size, list(fields.items()),
        payload if payloads else None,
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    text = pa.string()
    kinds = [text] * 7 + [pa.int64(), pa.map_(text, text), pa.binary()]
    names = [f.split()[0] for f in RECORD.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def assemble_captures(records: DataFrame) -> DataFrame:
    """(capture_id, request, answer, metadata, payload_digest, payload_bytes, refers_to): a row per capture.

    Records belong together when they are concurrent to the same record, or to each other: a record's
    capture is the record it names, or itself if it names none. A revisit takes length, digest and
    metadata fields of the response it refers to; they stay null where that is not in the archives.
    The records are gone through several times, so hand over a written table. Records of other types, and those without an id, are left out.
    """
    hub = records.where(F.col("record_id").isNotNull()).withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))

    def side(name: str, *kinds: str) -> DataFrame:
        whole = F.struct(*[c for c in records.columns if c != "concurrent_to"])
        return hub.where(F.col("type").isin(*kinds)).select("capture_id", whole.alias(name))

    captures = (
        side("answer", "response", "revisit")
        .join(side("request", "request"), "capture_id", "full")
        .join(side("metadata", "metadata"), "capture_id", "left")
    )
    answers = captures.where("answer.type = 'response'").groupBy(F.col("answer.record_id").alias("response_id")).agg(
        F.first(F.struct("answer.payload_bytes", "answer.payload_digest", "metadata.fields")).alias("original")
    )
    size = F.coalesce("answer.payload_bytes", "original.payload_bytes")
    return captures.join(answers, F.col("answer.refers_to") == F.col("response_id"), "left").select(
        "capture_id", "request", "answer", "metadata",
        F.coalesce("answer.payload_digest", "original.payload_digest").alias("payload_digest"),
        size.alias("payload_bytes"), F.col("original.fields").alias("refers_to"),
    )


def new_archive_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
