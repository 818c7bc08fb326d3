"""Legacy archives: ARC files of version 1 and 2 are parsed by their header lines and declared lengths and become WARC.

An ARC file starts with a version block whose second line names the version and whose third line names the fields of
the record header lines. Each record is a header line, a body of the declared number of bytes and a line feed. The
conversion synthesises what WARC asks for and ARC lacks: record ids from place and content, ISO timestamps, record
types (`revisit` for repeated payloads) and SHA-1 payload digests. Archives are whole-file gzip, written and read by
Spark, so any file system will do; a file stems from one input split, which bounds its size.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from codeloom.llm.common import new_folder, saved
from codeloom.llm.exact_dedup import with_groups

#: The field names of the header lines by version.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Payloads of fewer bytes are always stored whole.
LEAST_REVISIT = 1000
RECORD = "id long, url string, ip string, date string, mime string, http binary, payload binary, payload_bytes long, digest string, record_id string, version int"
#: What grouping equal payloads needs.
LEAN_RECORD = "id long, payload_bytes long, digest string, record_id string"
WARC_RECORD = "id long, url string, payload binary, payload_bytes long, digest string, record_type string, refers_to long, record_id string"


def _version_block(name: str, version: int) -> str:
    block = f"{version} 0 codeloom\n{ARC_FIELDS[version]}\n"
    rest = f"- - - 0 {name} " if version == 2 else ""
    kind = "text/plain 200 " if version == 2 else "text/plain "
    return f"filedesc://{name} 0.0.0.0 20240101000000 {kind}{rest}{len(block)}\n{block}"


def write_arc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes one ARC record a row, one file a partition, by turns of version 1 and 2.

    A null html is an empty body; a null id leaves its header field out; white space in a URL is percent-encoded and a
    null or empty URL becomes `-`. Other columns are not archived.
    """
    pages = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.spark_partition_id().alias("p"))

    def archive(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        version = None
        for frame in frames:
            out = []
            for row_id, url, html, p in zip(frame["id"], frame["url"], frame["html"], frame["p"]):
                if version is None:
                    version = 1 + int(p) % 2
                    out.append(_version_block(f"pages-{int(p):05d}.arc", version))
                url = "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url or "") or "-"
                known = "" if pd.isna(row_id) else f"X-Page-Id: {int(row_id)}\r\n"
                body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{known}\r\n{html or ''}"
                n = len(body.encode())
                extra = f"text/html 200 - - 0 pages-{int(p):05d}.arc" if version == 2 else "text/html"
                out.append(f"{url} 192.0.2.1 20240101000000 {extra} {n}\n{body}")
            yield pd.DataFrame({"value": out})

    # Int64 keeps ids exact beside nulls
    ids = pages.withColumn("id", F.col("id").cast("string"))
    ids.mapInPandas(archive, "value string").write.option("lineSep", "\n").option("compression", "gzip").text(folder)


def _inflate(content: bytes) -> bytes:
    """All members of a gzip file, or the bytes themselves."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        one = zlib.decompressobj(31)
        out.append(one.decompress(content))
        content = one.unused_data
    return b"".join(out)


def arc_records(data: bytes, name: str) -> Iterator[dict]:
    """The records of one ARC file; a header line or length that does not fit raises an error naming file and place."""
    at, fields = 0, ARC_FIELDS[1].split()
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at:end if end >= 0 else len(data)].rstrip(b"\r").decode("utf-8", "replace")
        if not line:
            at = end + 1 if end >= 0 else len(data)
            continue
        values = line.rsplit(" ", len(fields) - 1)
        if line.startswith("filedesc://"):
            length = line.rsplit(" ", 1)[1]
        else:
            length = values[-1]
        if end < 0 or not length.isdigit() or end + 1 + int(length) > len(data):
            raise ValueError(f"{name}: damaged record at byte {at}: {line[:80]!r}")
        body = data[end + 1:end + 1 + int(length)]
        if line.startswith("filedesc://"):
            fields = body.decode().splitlines()[1].split()
        else:
            yield dict(zip(fields, values)) | {"body": body, "offset": at, "version": 2 if len(fields) > 5 else 1}
        at = end + 1 + int(length)
        if data[at:at + 1] == b"\n":
            at += 1


def _header(block: bytes, name: str) -> str | None:
    for line in block.decode("utf-8", "replace").split("\r\n"):
        key, _, value = line.partition(":")
        if key.lower() == name:
            return value.strip()
    return None


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(folder).select("path", "content")


def read_arc(spark: SparkSession, folder: str, lean: bool = False) -> DataFrame:
    """The parsed records of all ARC files of a folder, with synthesised digest and record id; lean leaves contents out."""
    schema = LEAN_RECORD if lean else RECORD

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in schema.split(", ")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                name, rows, held = path.rsplit("/", 1)[-1], [], 0
                for r in arc_records(_inflate(content), name):
                    http, sep, payload = r["body"].partition(b"\r\n\r\n")
                    if not (sep and http.startswith(b"HTTP/")):
                        http, payload = b"", r["body"]
                    digest = hashlib.sha1(payload).hexdigest()
                    page = _header(http, "x-page-id")
                    made = uuid.uuid5(uuid.NAMESPACE_URL, f"{name}@{r['offset']}:{digest}")
                    if lean:
                        rows.append((page and int(page), len(payload), digest, str(made)))
                        continue
                    rows.append((page and int(page), r["URL"], r["IP-address"], r["Archive-date"], r["Content-type"], http, payload, len(payload), digest, str(made), r["version"]))
                    held += len(r["body"])
                    if held > 4_000_000:
                        yield pd.DataFrame(rows, columns=columns).astype({"id": "Int64"})
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns).astype({"id": "Int64"})

    return _files(spark, folder).mapInPandas(parse, schema)


def _base32(digest: Column) -> Column:
    """Base32 of a hex SHA-1: 160 bits are four groups of 40 bits, each eight digits of base 32."""
    group = [F.lpad(F.upper(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32)), 8, "0") for i in range(4)]
    return F.translate(F.concat(*group), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def convert(spark: SparkSession, arc_folder: str, warc_folder: str, least: int = LEAST_REVISIT) -> None:
    """Writes the records of all ARC files as WARC/1.1.

    Of records with equal payloads of at least `least` bytes, the one with the largest id is the response and the others
    are revisits without payload that refer to it; records that repeat id and payload are all responses.
    """
    # records too small for a revisit get a key of their own, so that the filter lets them pass
    key = F.when(F.col("payload_bytes") >= least, F.col("digest")).otherwise(F.col("record_id")).alias("key")
    best = F.struct("id", "record_id").alias("best")
    keys = saved(read_arc(spark, arc_folder, lean=True).select(key, best), "payload-digests")
    rows = with_groups(read_arc(spark, arc_folder).select("*", key, best), keys, "key", "best", keys.count())
    revisit = F.coalesce(~F.col("id").eqNullSafe(F.col("_best.id")), F.lit(False))
    date = F.date_format(F.to_timestamp("date", "yyyyMMddHHmmss"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    block = F.concat(F.col("http"), F.when(F.length("http") > 0, F.lit(b"\r\n\r\n")).otherwise(F.lit(b"")), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"\r\n{name}: "), value)

    head = F.concat(
        F.lit("WARC/1.1"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), F.col("record_id"), F.lit(">"))),
        line("WARC-Date", date), line("WARC-Target-URI", F.col("url")), line("WARC-IP-Address", F.col("ip")), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("digest")))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), F.col("_best.record_id"), F.lit(">"))),
            line("X-Refers-To-Page", F.coalesce(F.col("_best.id").cast("string"), F.lit("-"))), line("X-Payload-Length", F.col("payload_bytes").cast("string")))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", F.length(block).cast("string")), F.lit("\r\n\r\n"),
    )
    whole = F.concat(F.encode(head, "UTF-8"), block).cast("string")
    rows.select(whole.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(warc_folder)


def warc_records(data: bytes, name: str) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of one WARC file."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        length = _header(data[at:end], "content-length") if data[at:at + 5] == b"WARC/" and end > 0 else None
        if length is None or end + 4 + int(length) > len(data):
            raise ValueError(f"{name}: damaged record at byte {at}")
        yield data[at:end], data[end + 4:end + 4 + int(length)]
        at = end + 8 + int(length)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all WARC files of a folder; a payload that does not fit its digest raises an error."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in WARC_RECORD.split(", ")]
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                name, rows, held = path.rsplit("/", 1)[-1], [], 0
                for head, block in warc_records(_inflate(content), name):
                    kind = _header(head, "warc-type")
                    http, sep, payload = block.partition(b"\r\n\r\n")
                    if not (sep and http.startswith(b"HTTP/")):
                        http, payload = b"", block
                    digest = base64.b32decode(_header(head, "warc-payload-digest").removeprefix("sha1:")).hex()
                    n, refers = len(payload), None
                    if kind == "revisit":
                        n, refers = int(_header(head, "x-payload-length")), _header(head, "x-refers-to-page")
                    elif hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name}: payload of {_header(head, 'warc-record-id')} does not fit its digest")
                    page = _header(http, "x-page-id")
                    rows.append((page and int(page), _header(head, "warc-target-uri"), payload, n, digest, kind, None if refers in (None, "-") else int(refers), _header(head, "warc-record-id")[10:-1]))
                    held += len(block)
                    if held > 4_000_000:
                        yield pd.DataFrame(rows, columns=columns).astype({"id": "Int64", "refers_to": "Int64"})
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns).astype({"id": "Int64", "refers_to": "Int64"})

    return _files(spark, folder).mapInPandas(parse, WARC_RECORD)


def archive_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC read back. Empty tables give no records."""
    spark = pages.sparkSession
    folder = new_folder(spark, "archives")
    write_arc(pages, f"{folder}/arc", id_col, url_col, html_col)
    convert(spark, f"{folder}/arc", f"{folder}/warc")
    return read_warc(spark, f"{folder}/warc")


def op10_query(pages: DataFrame) -> DataFrame:
    return archive_pages(pages).select(F.col("id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
q AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS digest FROM p),
r AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) ELSE page_id END AS best FROM q)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to FROM r
"""
