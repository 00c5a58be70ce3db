"""WARC archives: write captures, read records back, assemble the records of a capture.

Writing uses Spark's text writer: its line separator is the blank line that ends a WARC record, so every row is the
three records of one capture and the files are gzipped archives. Reading uses the text reader with the start of a
version line as separator. One archive is read by one task as a stream, however large; a record is as long as its
Content-Length says, whatever its payload looks like.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ordered import fold
from .common import stored, utf8

MIN_SHARED_BYTES = 100
CRLF = "\r\n"
VERSION = "WARC/1."
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = (
    "record_id string, type string, date string, uri string, concurrent_to string, refers_to string, "
    "payload_digest string, truncated boolean, head string, payload binary, payload_bytes bigint, payload_sha256 string"
)


def _lines(*parts: str | Column) -> Column:
    return F.concat_ws(CRLF, *[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _field(name: str, value: Column) -> Column:
    """A header line; null where there is no value. Line ends inside a value are percent-escaped."""
    text = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(F.lit(f"{name}: "), text)


def _record(kind: Column, record_id: Column, date: str, block: Column, *more: Column) -> Column:
    head = _lines(
        f"{VERSION}1", _field("WARC-Type", kind), _field("WARC-Record-ID", record_id), f"WARC-Date: {date}", *more,
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return F.concat(head, F.lit(CRLF * 2), block)


def _urn(kind: str, *parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def write_archives(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write request, response (or revisit) and metadata records of every page as gzipped archives below `path`.

    The payload is the html in UTF-8 (null: empty). Of pages with equal payloads of at least MIN_SHARED_BYTES bytes,
    that with the smallest page_id gets the response record, the others revisit it. A page without an id can't be
    revisited before one with an id. The metadata record carries the page_id. Request and metadata name the response
    in WARC-Concurrent-To. Every row is a capture of its own, repeated rows too: record ids come from page_id, payload,
    url and a number among equal rows. Where several rows have the smallest page_id, all hold the payload, and the one
    with the smallest url (null first) is revisited. Null urls leave the target out. An empty table gives an archive
    without records. Other columns are not written.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha2(body.cast("binary"), 256).alias("digest"))
    # Without the payloads: what each digest that occurs again refers to, and whether equal rows are among its pages.
    counted = rows.groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("html")).alias("size"))
    least = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    shared = stored(
        fold(counted, "digest", least, F.sum("n").alias("rows"), F.max("n").alias("most"), F.max("size").alias("size")).where("rows > 1"),
        "archive-shared",
    )
    first = shared.select("digest", F.when(F.col("size") >= MIN_SHARED_BYTES, F.col("first")).alias("first"), (F.col("most") > 1).alias("equal"))
    placed = rows.join(first, "digest", "left")
    none = F.lit(0).alias("number")
    once = placed.where(~F.coalesce("equal", F.lit(False))).select("page_id", "url", "html", "digest", "first", none)
    if not first.where("equal").isEmpty():
        # Equal rows fold to one before they travel, and come back with numbers.
        folded = rows.join(first.where("equal"), "digest").groupBy("page_id", "url", "digest", "first").agg(
            F.first("html").alias("html"), F.count(F.lit(1)).alias("n")
        )
        numbers = F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("number")
        once = once.unionByName(folded.select("page_id", "url", "html", "digest", "first", numbers))
    placed = once
    again = F.coalesce(F.col("first.page_id") != F.col("page_id"), F.col("first").isNotNull())
    main, asked, about = (
        _urn(k, F.col("page_id"), F.col("digest"), F.col("url"), F.col("number")) for k in ("response", "request", "metadata")
    )
    target = _field("WARC-Target-URI", F.col("url"))
    concurrent = _field("WARC-Concurrent-To", main)
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit(""))
    route = F.regexp_replace(F.regexp_replace(url, "^.*?://[^/?#]*", ""), "[\\s]", "%20")
    request = F.concat(
        _lines(F.concat(F.lit("GET /"), F.ltrim(route, F.lit("/")), F.lit(" HTTP/1.1")), _field("Host", host)),
        F.lit(CRLF * 2),
    )
    answer = F.concat(
        _lines(
            "HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8",
            F.concat(F.lit("Content-Length: "), F.octet_length("html").cast("string")),
        ),
        F.lit(CRLF * 2),
    )
    digest = F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest"))
    response = _record(
        F.lit("response"), main, date, F.concat(answer, F.col("html")), target,
        F.lit("Content-Type: application/http; msgtype=response"), digest,
    )
    revisit = _record(
        F.lit("revisit"), main, date, answer, target, F.lit("Content-Type: application/http; msgtype=response"), digest,
        F.lit(f"WARC-Profile: {REVISIT}"), _field("WARC-Refers-To", _urn("response", F.col("first.page_id"), F.col("digest"), F.col("first.url"), F.lit(0))),
    )
    asking = _record(
        F.lit("request"), asked, date, request, target, F.lit("Content-Type: application/http; msgtype=request"), concurrent
    )
    facts = F.coalesce(F.concat(F.lit("page-id: "), F.col("page_id").cast("string"), F.lit(CRLF)), F.lit(""))
    telling = _record(
        F.lit("metadata"), about, date, facts, target, F.lit("Content-Type: application/warc-fields"), concurrent
    )
    capture = F.concat_ws(CRLF * 2, asking, F.when(again, revisit).otherwise(response), telling)
    placed.select(capture.alias("value")).write.option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


class _Open:
    """The record that is being read: pieces of it until its whole length is there."""

    def __init__(self, file: str):
        self.file, self.pieces, self.size, self.need = file, [], 0, None

    def add(self, piece: bytes) -> bool:
        """True once the record is whole."""
        self.pieces.append(piece)
        self.size += len(piece)
        if self.need is None:
            data = b"".join(self.pieces)
            self.pieces = [data]
            end = data.find(b"\r\n\r\n")
            if end < 0:
                return False
            self.head = _headers(data[:end])
            length = self.head.get("content-length", "0")
            self.need = end + 4 + (int(length) if length.isdigit() else 0)
            self.at = end + 4
        return self.size >= self.need

    def row(self) -> dict:
        if self.need is None:
            self.head, self.at, self.need = _headers(b"".join(self.pieces)), self.size, self.size
        block = b"".join(self.pieces)[self.at : self.need]
        head, payload = "", block
        if self.head.get("content-type", "").startswith("application/http"):
            top, gap, rest = block.partition(b"\r\n\r\n")
            head, payload = top.decode("utf-8", "replace"), rest if gap else b""
        return {
            "record_id": self.head.get("warc-record-id"),
            "type": self.head.get("warc-type"),
            "date": self.head.get("warc-date"),
            "uri": self.head.get("warc-target-uri"),
            "concurrent_to": self.head.get("warc-concurrent-to"),
            "refers_to": self.head.get("warc-refers-to"),
            "payload_digest": self.head.get("warc-payload-digest"),
            "truncated": self.size < self.need or "warc-truncated" in self.head,
            "head": head,
            "payload": payload,
            "payload_bytes": len(payload),
            "payload_sha256": hashlib.sha256(payload).hexdigest(),
        }


def _headers(data: bytes) -> dict[str, str]:
    found = {}
    for line in data.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            found[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return found


_ARROW = pa.schema(
    [(n, pa.string()) for n in ("record_id", "type", "date", "uri", "concurrent_to", "refers_to", "payload_digest")]
    + [("truncated", pa.bool_()), ("head", pa.string()), ("payload", pa.binary())]
    + [("payload_bytes", pa.int64()), ("payload_sha256", pa.string())]
)
_FLUSH = 8 << 20


def _parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[dict] = []
    size = 0
    record: _Open | None = None
    for part in parts:
        for file, piece in zip(part.column("file").to_pylist(), part.column("value").to_pylist()):
            if record is not None and record.file != file:
                rows.append(record.row())
                record = None
            if record is None:
                if not piece:  # what stands before the first version line of a file
                    continue
                record = _Open(file)
                done = record.add(piece)
            else:  # the separator was part of the record
                done = record.add(VERSION.encode() + piece)
            if done:
                rows.append(record.row())
                size += record.size
                record = None
            if size > _FLUSH:
                yield pa.RecordBatch.from_pylist(rows, _ARROW)
                rows, size = [], 0
    if record is not None:
        rows.append(record.row())
    if rows:
        yield pa.RecordBatch.from_pylist(rows, _ARROW)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the gzipped archives (WARC 1.0 or 1.1) below `path`.

    HTTP blocks are split into head and payload; of other blocks all is payload. A record cut off by the end of its
    file, or marked so, is `truncated`. Missing headers are null.
    """
    chunks = spark.read.option("lineSep", VERSION).text(path)
    chunks = chunks.select(utf8("value").alias("value"), F.col("_metadata.file_path").alias("file"))
    return chunks.mapInArrow(_parse, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: the response or revisit record, its request, and its metadata records.

    A record belongs to the capture whose response or revisit it names in WARC-Concurrent-To, or whose response names
    it, or whose request it names. Of several requests the one with the smallest id counts; metadata records are
    sorted by id. Record ids are unique: repeated ones count once. Records without an id, and those that belong to no
    capture, are left out; a capture may lack a request (null) or metadata (empty).
    """
    known = records.where(F.col("record_id").isNotNull()).dropDuplicates(["record_id"])
    main = known.where(F.col("type").isin("response", "revisit"))
    other = known.where(F.col("type").isin("request", "metadata"))
    named = other.select("record_id", F.col("concurrent_to").alias("capture"))
    naming = main.select(F.col("concurrent_to").alias("record_id"), F.col("record_id").alias("capture"))
    mains = main.select(F.col("record_id").alias("capture"))
    direct = named.join(mains, "capture", "left_semi").select("record_id", "capture").unionByName(
        naming.where(F.col("record_id").isNotNull())
    )
    over = direct.select(F.col("record_id").alias("via"), F.col("capture").alias("to"))
    further = named.join(over, F.col("capture") == F.col("via")).select("record_id", F.col("to").alias("capture"))
    owner = direct.unionByName(further).groupBy("record_id").agg(F.min("capture").alias("capture"))
    fields = [c for c in records.columns if c != "type"]
    rest = other.join(owner, "record_id").groupBy("capture").agg(
        F.min_by(F.struct(*fields), F.when(F.col("type") == "request", F.col("record_id"))).alias("request"),
        F.sort_array(F.collect_list(F.when(F.col("type") == "metadata", F.struct(*fields)))).alias("metadata"),
    )
    own = main.select(F.col("record_id").alias("capture"), "type", F.struct(*fields).alias("response"))
    empty = F.array().cast(rest.schema["metadata"].dataType)
    return own.join(rest, "capture", "left").withColumn("metadata", F.coalesce("metadata", empty))


ORACLE = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
         sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN coalesce(first, page_id) = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN coalesce(first, page_id) <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""
