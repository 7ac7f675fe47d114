"""Legacy web archives and their conversion (operator 12).

ARC files hold a version block, whose lines tell the fields of all header lines after it, and documents: a header line
of five (version 1) or ten (version 2) fields, the last of them the length, and so many bytes. Conversion gives each
document a WARC record: an identifier made of its file and place, so that a retried task makes the same one, the ISO form of its
14 digits of time, a type by scheme and protocol, and digests. Of equal payloads the record with the smallest page id
(then identifier) is the response, the others revisit it and hold headers alone.

Archives are written by Spark's text sink, whose commit survives lost tasks, as gzip files whose bytes are exactly those
of the formats: the separators between records are its line ends. They are read as lines, a file a task, and records
are cut from the stream of lines by their declared lengths, so a task holds one record and one batch at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from camtrail.llm.storage import bounded_batches, written

# Fixed values of the formats: fields of header lines by version, and the profile of revisits.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Smaller payloads are never replaced by a revisit.
LEAST_BYTES = 100
#: So many first records of equal payloads are broadcast; with more, payloads are shuffled by digest.
MOST_BROADCAST = 200_000
#: Capture time of pages that tell none.
CAPTURED = "20000101000000"
NO_URL = "urn:x-no-url"
_BATCH_BYTES = 4 << 20
_ARC_ROW = "file long, place long, version int, uri string, captured string, mime string, head binary, payload binary, n_bytes long, digest string, page_id long"
_WARC_ROW = "record_type string, record_id string, uri string, date string, head binary, payload binary, payload_bytes long, payload_digest string, page_id long, refers_to_id string, refers_to long"


# Writing


def write_arc(pages: DataFrame, path: str, version: int | None = None, captured: str = CAPTURED) -> None:
    """Pages (page_id, url, html) as ARC files of the version (None: both in turn, by file).

    A null html is empty, a null page_id isn't written, a null or empty url becomes NO_URL; white space and control characters of a url
    become %20. An empty table makes files without records; other columns are left out.
    """
    part = F.spark_partition_id()
    kind = F.lit(version) if version else 1 + part % 2
    html, page = F.coalesce("html", F.lit("")), F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    name = F.concat(F.lit("part-"), part.cast("string"), F.lit(".arc"))
    url = F.regexp_replace(F.when(F.coalesce("url", F.lit("")) == "", NO_URL).otherwise(F.col("url")), r"[\x00-\x20\x7F]", "%20")
    document = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n"), page, F.lit("\r\n"), html)
    rows = pages.select(url.alias("url"), document.alias("document"), name.alias("name"), kind.alias("version"), (F.monotonically_increasing_id() % (1 << 33)).alias("place"))

    def line(uri: Column, mime: str, body: Column) -> Column:
        first, length = F.concat(uri, F.lit(f" 0.0.0.0 {captured} {mime} ")), F.octet_length(body).cast("string")
        return F.when(F.col("version") == 1, F.concat(first, length)).otherwise(F.concat(first, F.lit("200 "), F.md5(body), F.lit(" - 0 "), F.col("name"), F.lit(" "), length))

    fields = F.when(F.col("version") == 1, ARC_FIELDS[1]).otherwise(ARC_FIELDS[2])
    about = F.concat(F.col("version").cast("string"), F.lit(" 0 camtrail\n"), fields, F.lit("\n"))
    block = F.concat(line(F.concat(F.lit("filedesc://"), F.col("name")), "text/plain", about), F.lit("\n"), about, F.lit("\n"))
    record = F.concat(line(F.col("url"), "text/html", F.col("document")), F.lit("\n"), F.col("document"))
    _write(rows.select(F.when(F.col("place") == 0, F.concat(block, record)).otherwise(record)), path, "\n")


def write_warc(records: DataFrame, path: str) -> None:
    """Records (record_id, record_type, uri, captured, mime, head, payload, digest, page_id, first_id, first_page) as WARC files."""
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    as_text = lambda name: F.col(name).cast("string")

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    response = F.col("record_type") != "resource"
    head = F.concat(
        F.lit("WARC/1.1\r\n"), field("WARC-Type", F.col("record_type")), field("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        field("WARC-Date", iso_time(F.col("captured"))), field("WARC-Target-URI", F.col("uri")), field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        field("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.sha2(block, 256))), field("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
        field("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), "first_id", F.lit(">")))), field("X-Refers-To-Page-Id", F.when(revisit, as_text("first_page"))),
        field("X-Page-Id", as_text("page_id")), field("Content-Type", F.when(response, F.lit("application/http; msgtype=response")).otherwise(F.col("mime"))),
        field("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"),
    )
    about = "software: camtrail\r\nformat: WARC File Format 1.1\r\n"
    first = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <"), identifier(F.concat(F.lit(path), F.spark_partition_id().cast("string"))),
        F.lit(f">\r\nWARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(about)}\r\n\r\n{about}\r\n\r\n"),
    )
    starts = F.monotonically_increasing_id() % (1 << 33) == 0
    # bytes of any kind pass as they are: a cast makes no check of them
    _write(records.select(F.concat(F.when(starts, first).otherwise(F.lit("")).cast("binary"), head.cast("binary"), block).cast("string")), path, "\r\n\r\n")


def _write(texts: DataFrame, path: str, separator: str) -> None:
    with bounded_batches(texts.sparkSession):
        texts.toDF("value").write.option("lineSep", separator).option("compression", "gzip").option("maxRecordsPerFile", 0).text(path)


def identifier(text: Column) -> Column:
    """urn:uuid of a text's digest."""
    return F.concat(F.lit("urn:uuid:"), F.regexp_replace(F.substring(F.sha2(text, 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))


def iso_time(captured: Column) -> Column:
    """2000-01-02T03:04:05Z for 20000102030405; shorter stamps are filled up from the first moment they can mean."""
    filled = F.concat(captured, F.substring(F.lit(CAPTURED), F.length(captured) + 1, F.lit(14)))
    return F.regexp_replace(filled, "^(.{4})(..)(..)(..)(..)(..)$", "$1-$2-$3T$4:$5:$6Z")


# Reading


class Pieces:
    """Lines and runs of bytes from pieces of a file."""

    def __init__(self, pieces: Iterable[bytes]):
        self.pieces, self.held, self.at = iter(pieces), b"", 0

    def _more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held, self.at = self.held[self.at :] + piece, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        start = self.at
        while (end := self.held.find(b"\n", start)) < 0:
            start = len(self.held) - self.at
            if not self._more():
                return None
        line, self.at = self.held[self.at : end], end + 1
        return line.rstrip(b"\r")

    def take(self, n: int) -> bytes:
        """The next n bytes."""
        parts = [self.held[self.at : self.at + n]]
        self.at += len(parts[0])
        missing = n - len(parts[0])
        while missing:
            piece = next(self.pieces, None)
            if piece is None:
                raise ValueError("a record is shorter than its declared length")
            parts.append(piece[:missing])
            self.held, self.at = piece, len(parts[-1])
            missing -= self.at
        return b"".join(parts)


def _http_parts(body: bytes) -> tuple[bytes, bytes]:
    """Head with its empty line, and payload; a body that isn't HTTP is all payload."""
    if not body.startswith(b"HTTP/"):
        return b"", body
    ends = [(at + len(mark), mark) for mark in (b"\r\n\r\n", b"\n\n") if (at := body.find(mark)) >= 0]
    cut = min(ends)[0] if ends else len(body)
    return body[:cut], body[cut:]


def _number(head: bytes, name: bytes) -> int | None:
    found = re.search(rb"(?im)^" + name + rb":[ \t]*(-?\d+)[ \t]*\r?$", head)
    return int(found[1]) if found else None


def arc_records(pieces: Iterable[bytes]) -> Iterator[tuple]:
    """version, uri, captured, mime, body of each document of an ARC file."""
    data, version = Pieces(pieces), None
    while (line := data.line()) is not None:
        if not line.strip():
            continue
        if version is None or line.startswith(b"filedesc:"):
            body = data.take(int(line.split()[-1]))
            version = int(body.split(None, 1)[0])
            if version not in ARC_FIELDS:
                raise ValueError(f"ARC version {version} isn't known")
            continue
        n = len(ARC_FIELDS[version].split())
        fields = line.rsplit(b" ", n - 1)  # from the right: old crawlers left blanks in addresses
        if len(fields) != n:
            raise ValueError(f"a header line of {len(fields)} fields in an ARC file of version {version}")
        uri, _, captured, mime, length = *fields[:4], fields[-1]
        yield version, uri.decode("utf-8", "replace"), captured.decode("ascii", "replace"), mime.decode("ascii", "replace"), data.take(int(length))


def warc_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Named fields (in lower case) and block of each record of a WARC file."""
    data = Pieces(pieces)
    while (line := data.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("a record doesn't begin with its version")
        fields: dict[str, str] = {}
        while line := data.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        yield fields, data.take(int(fields["content-length"]))


def _files(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    """file and bytes of the lines of batches, in order."""
    for batch in batches:
        file = batch["file"].to_numpy()
        cuts = [0, *(np.flatnonzero(file[1:] != file[:-1]) + 1), len(file)]
        for a, z in zip(cuts, cuts[1:]):
            if z > a:
                lines = batch["line"].slice(a, z - a).cast(pa.large_binary())
                yield int(file[a]), b"\n".join(lines.to_pylist()) + b"\n"


def _read(spark: SparkSession, path: str, rows_of: Callable[[int, Iterator[bytes]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that rows_of makes of each file's pieces. Compressed files are never split, so a task sees whole files, one after another."""
    lines = spark.read.schema("value string").option("lineSep", "\n").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("line"))
    names = [f.strip().split()[0] for f in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = pa.schema([(name, kinds[f.strip().split()[1]]) for name, f in zip(names, schema.split(","))])
    sized = [i for i, f in enumerate(fields) if f.type == pa.binary()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for file, own in groupby(_files(batches), key=lambda x: x[0]):
            for row in rows_of(file, (piece for _, piece in own)):
                held.append(row)
                size += 200 + sum(len(row[i] or b"") for i in sized)
                if size > _BATCH_BYTES:
                    yield _batch(held, fields)
                    held, size = [], 0
        yield _batch(held, fields)

    return lines.mapInArrow(run, schema)


def _batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """file, place, version, uri, captured, mime, head, payload (null without payloads), n_bytes, digest and page_id of each document.

    Files have to be compressed, so that none is split. A wrong length or header line raises. page_id is that of an
    X-Page-Id line of the head, or null.
    """

    def rows_of(file: int, pieces: Iterator[bytes]) -> Iterator[tuple]:
        for place, (version, uri, captured, mime, body) in enumerate(arc_records(pieces)):
            head, payload = _http_parts(body)
            yield file, place, version, uri, captured, mime, head, payload if payloads else None, len(payload), hashlib.sha256(payload).hexdigest(), _number(head, b"X-Page-Id")

    return _read(spark, path, rows_of, _ARC_ROW)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files but warcinfo: type, ids, uri, date, head, payload (null for revisits), length and digest of the full payload.

    Of revisits both are as the record tells them; of others they are taken from the payload, which has to have the
    digest that its record tells.
    """

    def rows_of(file: int, pieces: Iterator[bytes]) -> Iterator[tuple]:
        for fields, block in warc_records(pieces):
            kind = fields["warc-type"]
            if kind == "warcinfo":
                continue
            head, payload = _http_parts(block) if kind != "resource" else (b"", block)
            told = fields.get("warc-payload-digest", "").rpartition(":")[2]
            number = lambda name: int(fields[name]) if name in fields else None
            if kind == "revisit":
                payload, size, digest = None, _number(head, b"Content-Length"), told
            else:
                size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                if told and told != digest:
                    raise ValueError(f"the payload of {fields['warc-record-id']} has another digest")
            yield kind, fields["warc-record-id"].strip("<>"), fields.get("warc-target-uri"), fields.get("warc-date"), head, payload, size, digest, number("x-page-id"), fields.get("warc-refers-to", "").strip("<>") or None, number("x-refers-to-page-id")

    return _read(spark, path, rows_of, _WARC_ROW)


# Conversion


def convert(spark: SparkSession, arc_path: str, warc_path: str, least_bytes: int = LEAST_BYTES, most_broadcast: int = MOST_BROADCAST) -> None:
    """WARC files of the documents of ARC files.

    HTTP documents become response or revisit records, others resource records. Of equal payloads of at least
    least_bytes the one with the smallest page_id (null last), then identifier, stays whole. Digests alone are grouped,
    so equal payloads, however many, meet as one row a task; an archive without documents gives one without records.
    """

    def known(payloads: bool) -> DataFrame:
        own = read_arc(spark, arc_path, payloads)
        return own.withColumn("record_id", identifier(F.concat_ws(":", "file", "place"))).withColumn("http", F.octet_length("head") > 0)

    equal = known(False).where((F.col("n_bytes") >= least_bytes) & F.col("http")).groupBy("digest")
    first = equal.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("unknown"), "page_id", "record_id")).alias("first")).where("n > 1")
    first = written(first.select("digest", F.col("first.record_id").alias("first_id"), F.col("first.page_id").alias("first_page")), "first-records")
    few = first.limit(most_broadcast + 1).count() <= most_broadcast
    records = known(True).join(F.broadcast(first) if few else first, "digest", "left")
    revisit = F.col("http") & (F.col("n_bytes") >= least_bytes) & (F.col("first_id") != F.col("record_id"))
    write_warc(records.withColumn("record_type", F.when(revisit, "revisit").when(F.col("http"), "response").otherwise("resource")), warc_path)
