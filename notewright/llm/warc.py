"""WARC archives of pages, read back by segment reassembly, and op12_warc.

Writing: a record is a header, a blank line and a block, ended by a blank line, so the text
sink writes archives with that blank line as its line end. A payload that an earlier page
holds becomes a revisit; a block above ``segment_bytes`` is cut into a first record and
continuation records that name it. Reading: the text source cuts archives at blank lines,
and one task goes through an archive's pieces in order, putting blocks together by their
Content-Length. Records in segments are then grouped by the identifier of their origin,
sorted by segment number and fed, one segment at a time, to a decoder of HTTP headers and
chunked framing, so that no task holds more than a segment unless payloads are asked for."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.common import prepare, table
from notewright.session import materialize, run_dir

BLANK = b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
UNSAFE = re.compile(rb"[\x00-\x20\x7F]")
LARGEST_HEAD = 1 << 20


@dataclass(frozen=True)
class WarcParams:
    """Blocks above ``segment_bytes`` are cut; payloads travel in chunks of ``chunk_bytes``;
    equal payloads of at least ``revisit_bytes`` are stored once."""

    segment_bytes: int = 16 << 10
    chunk_bytes: int = 4 << 10
    revisit_bytes: int = 1000
    date: str = "2024-01-01T00:00:00Z"
    compression: str = "gzip"


# --- writing ---------------------------------------------------------------------------


def chunked(payload: bytes, size: int) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%s\r\n" % (len(p), p) for p in (payload[i : i + size] for i in range(0, len(payload), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record without the blank line at its end; fields that are null are left out."""
    head = "".join(f"\r\n{k}: {v}" for k, v in fields if v is not None)
    return b"WARC/1.1" + head.encode() + b"\r\nContent-Length: %d" % len(block) + BLANK + block


def record_id(run: str, row: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{run}/{row}'.encode()).digest())}>"


def page_records(run: str, row: int, page: str | None, url: bytes | None, payload: bytes, first: int | None, params: WarcParams) -> list[bytes]:
    """The records of a page: one, or its segments. ``first`` is the row that a revisit names."""
    where = None if url is None else UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], url).decode("utf-8", "replace")
    own = record_id(run, row)
    digest = "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    page = None if page is None else UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], page.encode()).decode()
    common = [("WARC-Record-ID", own), ("WARC-Date", params.date), ("WARC-Target-URI", where), ("X-Page-ID", page)]
    http = ("Content-Type", "application/http;msgtype=response")
    if first is not None and first != row:
        named = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(run, first)), ("WARC-Payload-Digest", digest)]
        return [record([("WARC-Type", "revisit"), *common, *named, http], HTTP_HEAD + BLANK)]
    block = HTTP_HEAD + BLANK + chunked(payload, params.chunk_bytes)
    digested = ("WARC-Payload-Digest", digest)
    if len(block) <= params.segment_bytes:
        return [record([("WARC-Type", "response"), *common, digested, http], block)]
    parts = [block[i : i + params.segment_bytes] for i in range(0, len(block), params.segment_bytes)]
    out = [record([("WARC-Type", "response"), *common, digested, ("WARC-Segment-Number", 1), http], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        fields = [
            ("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.UUID(own[10:-1]), str(n))}>"),
            ("WARC-Date", params.date), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", n),
            ("WARC-Segment-Total-Length", len(block) if n == len(parts) else None),
        ]
        out.append(record(fields, part))
    return out


def write_warc(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", params: WarcParams = WarcParams()) -> None:
    """Archives of all rows of ``pages`` in ``folder``, one file a task. A null payload is
    empty; a null url or id is left out of its record; blanks and control characters in
    either are percent-encoded. Of equal payloads of ``revisit_bytes`` or more the row with
    the largest id is stored (null is less than all; of rows with the same id, one), the
    others name it. Other columns are not archived. No rows give no records."""
    run = uuid.uuid4().hex
    payload = F.coalesce(pages[html].cast("binary"), F.lit("").cast("binary"))
    # written once, so that row numbers and digests stay as they are when a task is repeated
    staged = materialize(
        pages.select(
            F.monotonically_increasing_id().alias("row"), pages[page_id].alias("page"), pages[url].cast("binary").alias("url"), payload.alias("payload"),
            F.when(F.octet_length(payload) >= params.revisit_bytes, F.sha2(payload, 256)).alias("key"),
        ),
        "warc-pages",
    )
    large = staged.filter(F.col("key").isNotNull())
    # a digest that many pages share is one row a task before it is shuffled
    found = large.groupBy("key").agg(F.max(F.struct("page", "row")).alias("last"), F.count("*").alias("n"))
    shared = materialize(found.filter("n > 1").select("key", F.col("last.row").alias("first")), "warc-shared")
    # both sides are plain tables: partitions of hot digests are split
    rows = large.join(shared, "key", "left").unionByName(staged.filter(F.col("key").isNull()).withColumn("first", F.lit(None).cast("long")))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [r for row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for r in page_records(run, *row, params)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["record"])

    records = rows.select("row", F.col("page").cast("string"), "url", "payload", "first").mapInArrow(render, "record binary")
    lines = records.select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", BLANK.decode()).option("compression", params.compression).text(folder)


# --- reading ---------------------------------------------------------------------------

KINDS = {"string": (T.StringType(), pa.string()), "long": (T.LongType(), pa.int64()), "boolean": (T.BooleanType(), pa.bool_()), "binary": (T.BinaryType(), pa.binary())}


def struct(columns: str) -> T.StructType:
    """A schema from 'name type, name type', without a session."""
    return T.StructType([T.StructField(name, KINDS[kind][0]) for name, kind in (c.split() for c in columns.split(","))])


RECORDS = struct(
    "file string, at long, type string, record_id string, origin_id string, segment long, total_length long, refers_to string, "
    "target_uri string, page_id string, declared string, http boolean, block binary, problem string"
)


def header_fields(piece: bytes) -> dict[str, str]:
    """Named fields of a record's header, names in lower case; folded lines are joined."""
    out: dict[str, str] = {}
    name = None
    for line in piece.split(b"\r\n")[1:]:
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
        elif b":" in line:
            key, value = line.split(b":", 1)
            name = key.strip().lower().decode("utf-8", "replace")
            out[name] = value.strip().decode("utf-8", "replace")
    return out


def number(text: str | None) -> int | None:
    return int(text) if text is not None and re.fullmatch(r"[0-9]{1,18}", text) else None


def hex_digest(declared: str | None) -> str | None:
    """A sha1 field as bare lower-case hex, from base32 or hex; null for what is neither."""
    if declared is None or not declared.lower().startswith("sha1:"):
        return None
    value = declared[5:].strip()
    if re.fullmatch(r"[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch(r"[A-Za-z2-7]{32}", value) else None


def arrow_rows(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    kinds = dict(KINDS.values())
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], kinds[f.dataType]) for f in schema], names=schema.names)


class ArchiveReader:
    """Puts the pieces of one archive, cut at blank lines, together into records. Where a
    length doesn't fit, the record has a problem and reading goes on at the next header."""

    def __init__(self, file: str):
        self.file, self.at, self.fields, self.parts, self.left, self.lost, self.half = file, 0, None, [], 0, False, False

    def made(self, problem: str | None) -> tuple:
        f = self.fields or {}
        kind = f.get("warc-type")
        own = f.get("warc-record-id")
        self.at += 1
        out = (
            self.file, self.at, kind, own, f.get("warc-segment-origin-id", own), number(f.get("warc-segment-number")),
            number(f.get("warc-segment-total-length")), f.get("warc-refers-to"), f.get("warc-target-uri"), f.get("x-page-id"),
            hex_digest(f.get("warc-payload-digest")), f.get("content-type", "").lower().startswith("application/http"),
            None if problem else b"".join(self.parts), problem,
        )
        self.fields, self.parts, self.half = None, [], False
        return out

    def feed(self, piece: bytes) -> Iterator[tuple]:
        if self.half:  # the block ended in a line end, so half of the blank line after it is here
            whole = piece.startswith(b"\r\n")
            yield self.made(None if whole else "bad length")
            piece, self.lost = piece[2:] if whole else piece, not whole
        if self.fields is None:
            if piece.startswith(b"WARC/"):
                self.fields, self.lost = header_fields(piece), False
                self.left = number(self.fields.get("content-length"))
                if self.left is None:
                    yield self.made("no length")
                    self.lost = True
            elif piece and not self.lost:  # one row for a stretch that is no record
                self.lost = True
                yield self.made("no header")
            return
        self.parts.append(piece)
        self.left -= len(piece)
        if self.left == 0:
            yield self.made(None)
        elif self.left == 2:
            self.parts.append(b"\r\n")
            self.half = True
        elif self.left >= len(BLANK):
            self.parts.append(BLANK)
            self.left -= len(BLANK)
        else:
            yield self.made("bad length")
            self.lost = True
            if piece.startswith(b"WARC/"):
                yield from self.feed(piece)

    def end(self) -> Iterator[tuple]:
        if self.fields is not None:
            yield self.made(None if self.half else "cut off")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives in ``folder``: header fields, block, and what is wrong
    with it, if anything ('no header', 'no length', 'bad length', 'cut off'). One task reads
    an archive, piece by piece, so archives are to be compressed or below the size at which
    Spark splits files; a split one is refused with an error."""
    pieces = (
        prepare(spark).read.schema("value string").option("lineSep", BLANK.decode()).text(folder)
        .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("piece"))
    )
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        rows: list[tuple] = []
        for batch in batches:
            for file, start, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if start:
                    raise ValueError(f"{file} is split between tasks: compress it, or raise spark.sql.files.maxPartitionBytes")
                if reader is None or reader.file != file:
                    rows += reader.end() if reader else ()
                    reader = ArchiveReader(file)
                rows += reader.feed(piece)
            yield arrow_rows([dict(zip(RECORDS.names, r, strict=True)) for r in rows], RECORDS)
            rows = []
        if reader:
            yield arrow_rows([dict(zip(RECORDS.names, r, strict=True)) for r in reader.end()], RECORDS)

    return pieces.mapInArrow(run, RECORDS)


class Decoder:
    """The payload of an HTTP response, fed in parts: headers, then the body, out of its
    chunked framing where the headers say so. Keeps the bytes only if ``keep``."""

    def __init__(self, http: bool, keep: bool):
        self.digest, self.size, self.kept = hashlib.sha1(), 0, bytearray() if keep else None
        self.state, self.held, self.need, self.problem = "head" if http else "body", b"", 0, None

    def give(self, data: bytes) -> None:
        self.digest.update(data)
        self.size += len(data)
        if self.kept is not None:
            self.kept += data

    def feed(self, data: bytes) -> None:
        data = self.held + data
        self.held = b""
        while data and self.problem is None:
            if self.state == "body":
                self.give(data)
                return
            if self.state == "data":
                part, data = data[: self.need], data[self.need :]
                self.give(part)
                self.need -= len(part)
                if not self.need:
                    self.state = "mark"
                continue
            if self.state == "done":
                self.problem = "bytes after the last chunk"
                return
            end = data.find(BLANK if self.state == "head" else b"\r\n")
            if end < 0:
                if len(data) > LARGEST_HEAD:
                    self.problem = "bad http header" if self.state == "head" else "bad chunk"
                self.held = data
                return
            if self.state == "head":
                line, data = data[:end], data[end + 4 :]
                codings = re.findall(rb"(?im)^transfer-encoding:[ \t]*([^\r\n]*?)[ \t]*\r?$", line)
                self.state = "size" if codings and codings[-1].lower().endswith(b"chunked") else "body"
                continue
            line, data = data[:end], data[end + 2 :]
            if self.state == "mark":
                if line:
                    self.problem = "bad chunk"
                self.state = "size"
            elif self.state == "size":
                size = line.split(b";", 1)[0].strip()
                if not re.fullmatch(rb"[0-9a-fA-F]{1,15}", size):
                    self.problem = "bad chunk"
                    return
                self.need = int(size, 16)
                self.state = "data" if self.need else "trailer"
            elif self.state == "trailer" and not line:
                self.state = "done"

    def end(self) -> str | None:
        """What is wrong with the whole, if anything."""
        if self.problem is None and (self.state not in ("body", "done") or self.held):
            return "bad http header" if self.state == "head" else "chunks cut off"
        return self.problem


CAPTURES = struct(
    "record_id string, type string, target_uri string, page_id string, refers_to string, declared string, "
    "segments long, payload_bytes long, payload_digest string, payload binary, problem string"
)


class Capture:
    """A record under assembly from its segments, which come in order."""

    def __init__(self, payloads: bool):
        self.payloads, self.first, self.next, self.length, self.total, self.problem, self.decoder = payloads, None, 1, 0, None, None, None

    def add(self, row: dict) -> None:
        segment = row["segment"] or 1
        if segment == self.next - 1 and self.first is not None:
            return  # the same segment again
        if segment != self.next:
            self.problem = self.problem or "missing segment"
        if self.first is None:
            self.first = row
            if row["type"] == "continuation" and row["segment"] in (None, 1):
                self.problem = "missing segment"
            self.decoder = Decoder(bool(row["http"]), self.payloads)
        self.next = segment + 1
        self.length += len(row["block"] or b"")
        self.total = row["total_length"] if row["total_length"] is not None else self.total
        self.problem = self.problem or row["problem"]
        if not self.problem:
            self.decoder.feed(row["block"])

    def end(self) -> tuple:
        row, problem = self.first, self.problem
        if problem is None and row["segment"] is not None and self.total is None:
            problem = "missing segment"
        if problem is None and self.total is not None and self.total != self.length:
            problem = "bad total length"
        if row["type"] != "revisit":  # a revisit may do without the body that its headers tell of
            problem = problem or self.decoder.end()
        digest = self.decoder.digest.hexdigest()
        if problem is None and row["type"] != "revisit" and row["declared"] not in (None, digest):
            problem = "bad digest"
        good = problem is None and row["type"] != "revisit"
        return (
            row["record_id"] if row["type"] != "continuation" else row["origin_id"], row["type"], row["target_uri"], row["page_id"],
            row["refers_to"], row["declared"], self.next - 1, self.decoder.size if good else None, digest if good else None,
            bytes(self.decoder.kept) if good and self.payloads else None, problem,
        )


def assemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record that isn't a continuation: its fields, the number of its
    segments, size, SHA-1 and bytes (with ``payloads``) of its payload, and what is wrong, if
    anything: a problem of reading, 'missing segment', 'bad total length', 'bad http header',
    'bad chunk', 'chunks cut off', 'bytes after the last chunk' or 'bad digest'; size, digest
    and payload are null then, and for revisits. A segment that is there twice counts once.
    Continuations whose origin is missing give one row with a problem. A record in one piece
    is decoded where it is read; only segments are shuffled."""
    names = [f.name for f in RECORDS if f.name not in CAPTURES.names]
    both = T.StructType([*CAPTURES, *(RECORDS[n] for n in names)])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if row["segment"] is None:
                    one = Capture(payloads)
                    one.add(row)
                    rows.append(dict(zip(CAPTURES.names, one.end(), strict=True)) | {"at": row["at"], "file": row["file"]})
                else:
                    rows.append(row)
                if sum(len(r.get("block") or r.get("payload") or b"") for r in rows[-64:]) > 4 << 20:
                    yield arrow_rows(rows, both)
                    rows = []
            yield arrow_rows(rows, both)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, of, rows = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["origin_id"] != of:
                    rows += [now.end()] if now else []
                    now, of = Capture(payloads), row["origin_id"]
                now.add(row)
            yield arrow_rows([dict(zip(CAPTURES.names, r, strict=True)) for r in rows], CAPTURES)
            rows = []
        if now:
            yield arrow_rows([dict(zip(CAPTURES.names, now.end(), strict=True))], CAPTURES)

    read = materialize(records.mapInArrow(single, both), "warc-records")
    parts = read.filter(F.col("segment").isNotNull()).repartition("origin_id").sortWithinPartitions("origin_id", "segment", "file", "at")
    return read.filter(F.col("segment").isNull()).select(CAPTURES.names).unionByName(parts.mapInArrow(grouped, CAPTURES))


def resolve(captures: DataFrame) -> DataFrame:
    """``captures`` without payloads, revisits with the size and digest of the response that
    they name and its page (``refers_to_page``); 'unresolved' where it is missing or has another
    digest than the revisit says."""
    slim = captures.drop("payload")
    # a record id is unique in sound archives; of records that share one, any of equal digest serves
    known = slim.filter("type <> 'revisit' AND problem IS NULL AND record_id IS NOT NULL").dropDuplicates(["record_id"]).select(
        F.col("record_id").alias("refers_to"), F.col("payload_bytes").alias("b"), F.col("payload_digest").alias("d"), F.col("page_id").alias("refers_to_page")
    )
    known = materialize(known, "warc-responses")
    again = slim.filter("type = 'revisit'").join(known, "refers_to", "left")
    fits = F.col("d").isNotNull() & F.coalesce(F.col("declared") == F.col("d"), F.lit(True))
    again = again.select(
        *(c for c in slim.columns if c not in ("payload_bytes", "payload_digest", "problem")),
        F.when(fits, F.col("b")).alias("payload_bytes"), F.when(fits, F.col("d")).alias("payload_digest"),
        F.coalesce("problem", F.when(~fits, "unresolved")).alias("problem"), F.when(fits, F.col("refers_to_page")).alias("refers_to_page"),
    )
    rest = slim.filter("type <> 'revisit' OR type IS NULL").withColumn("refers_to_page", F.lit(None).cast("string"))
    return rest.unionByName(again)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = run_dir(spark, "warc")
    write_warc(pages, folder)
    captures = materialize(assemble(read_records(spark, folder), payloads=False), "warc-captures")
    return resolve(captures).select(
        F.col("page_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("refers_to_page").cast("long").alias("refers_to"),
    )


QUERIES = {"op12_warc": op12_warc}
SQL = {
    "op12_warc": """
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
FROM (SELECT *, strlen(body) >= 1000 AND page_id <> last AS again
      FROM (SELECT page_id, coalesce(html, '') AS body, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages))
"""
}
