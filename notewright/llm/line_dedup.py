"""Line dedup by sorted line hashes, and op8_line_dedup.

Each document gives the hashes of its lines; the hashes are range-partitioned together
with the document, sorted, and streamed: the first document of a key keeps its lines. As
the ranges are over (key, document), a key that very many documents hold is spread over
tasks; what a task can't decide alone (the keys at its two ends) is settled from one
summary an end. The result is one compressed bitmap a document, no text."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.common import free_name, table, texts
from notewright.session import materialize

MIN_CHARS, MIN_DOCS = 40, 5
STRIP = b" \t\n\x0b\x0c\r"
NO_ID = -(2**63)
DROP, PENDING, SUMMARY = 0, 1, 2


def line_keys(text: bytes, min_chars: int) -> dict[int, list[int]]:
    """128-bit hash of each long enough key -> numbers of its lines."""
    out: dict[int, list[int]] = {}
    for at, line in enumerate(text.split(b"\n")):
        key = line.strip(STRIP).lower()
        if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars):
            out.setdefault(xxhash.xxh3_128_intdigest(key), []).append(at)
    return out


def identified(docs: DataFrame, doc_id: str, text: str) -> tuple:
    """Columns that tell rows apart: the id (null is smaller than all) and the text's hash.
    Rows alike in both are the same lines of the same document."""
    return (
        F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("row"),
    )


def occurrences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(k1, k2, doc, row, at): a row for each key of each document row, ``at`` its lines."""
    schema = "k1 long, k2 long, doc long, row long, at array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, owner, at = [], [], []
            for i, text in enumerate(texts(batch.column(2))):
                for key, lines in line_keys(text, min_chars).items():
                    keys.append(key)
                    owner.append(i)
                    at.append(lines)
            halves = np.frombuffer(b"".join(k.to_bytes(16, "big") for k in keys), ">i8").reshape(-1, 2)
            own = pa.array(owner, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(halves[:, 0].astype(np.int64)),
                    pa.array(halves[:, 1].astype(np.int64)),
                    batch.column(0).take(own),
                    batch.column(1).take(own),
                    pa.array(at, pa.list_(pa.int32())),
                ],
                names=["k1", "k2", "doc", "row", "at"],
            )

    rows = docs.select(*identified(docs, doc_id, text), F.coalesce(docs[text], F.lit("")).cast("binary").alias("bytes"))
    return rows.mapInArrow(run, schema)


def decide(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Streams one sorted partition (key, then document from the largest). Rows of a key
    that began and was decided here leave as DROP; rows of the first key, and of the last
    one if still short of documents, as PENDING; both ends also leave a SUMMARY with the
    number of documents and the largest. At most the rows of ``min_docs`` - 1 documents
    are held."""
    names = ["kind", "k1", "k2", "doc", "row", "at", "n"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int64()]
    out: list[tuple] = []
    key, first, top, before, seen, held = None, True, None, None, 0, []

    def packed() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    for batch in batches:
        for k1, k2, doc, row, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (k1, k2) != key:
                if key and first:
                    out.append((SUMMARY, *key, top, None, None, seen))
                    first = False
                key, top, before, seen, held = (k1, k2), doc, doc, 1, []
            if doc != before:
                before = doc
                seen += 1
            if first:
                out.append((PENDING, k1, k2, doc, row, at, None))
            elif doc != top:
                held.append((DROP, k1, k2, doc, row, at, None))
                if seen >= min_docs:
                    out += held
                    held = []
        yield packed()
        out.clear()
    if key:
        out.append((SUMMARY, *key, top, None, None, seen))
        out += [(PENDING, *x[1:]) for x in held]
        yield packed()


def keep_bitmaps(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """(doc, row, n_dropped, bitmap) for document rows that lose lines. ``bitmap`` is
    zlib-compressed, bit i (high bits first) set where line i stays; lines after its end
    stay. A key is a line stripped of white space and in lower case (A-Z); keys of at
    least ``min_chars`` characters in at least ``min_docs`` ids stay only in the largest
    id that holds them, there in all their lines. Rows with one id are one document;
    a null id is a document too, smaller than all others."""
    spark = docs.sparkSession
    long_lines = materialize(occurrences(docs, doc_id, text, min_chars), "lines")
    ordered = long_lines.repartitionByRange("k1", "k2", F.desc("doc")).sortWithinPartitions("k1", "k2", F.desc("doc"))
    schema = "kind int, k1 long, k2 long, doc long, row long, at array<int>, n long"
    decided = materialize(ordered.mapInArrow(lambda b: decide(b, min_docs), schema), "decisions")
    # at most two rows a partition of the sort, whatever the input
    ends = (
        decided.filter(F.col("kind") == SUMMARY)
        .groupBy("k1", "k2")
        .agg(F.sum("n").alias("docs"), F.max("doc").alias("last"))
        .filter(F.col("docs") >= min_docs)
    )
    settled = (
        decided.filter(F.col("kind") == PENDING)
        .join(F.broadcast(ends), ["k1", "k2"])
        .filter(F.col("doc") < F.col("last"))
        .select("doc", "row", "at")
    )
    drops = decided.filter(F.col("kind") == DROP).select("doc", "row", "at").union(settled)
    lines = drops.groupBy("doc", "row").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"))

    def run(batches):
        for batch in batches:
            maps = []
            for at in batch.column(2).to_pylist():
                bits = np.ones(max(at) + 1, np.uint8)
                bits[at] = 0
                whole = np.ones(-(-len(bits) // 8) * 8, np.uint8)
                whole[: len(bits)] = bits
                maps.append(zlib.compress(np.packbits(whole).tobytes()))
            counts = pa.array([len(x) for x in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), counts, pa.array(maps, pa.binary())],
                names=["doc", "row", "n_dropped", "bitmap"],
            )

    return lines.mapInArrow(run, "doc long, row long, n_dropped long, bitmap binary")


def kept_lines(text: bytes, bitmap: bytes | None) -> tuple[int, bytes]:
    """(number of lines, text of those that stay)."""
    lines = text.split(b"\n")
    if bitmap is None:
        return len(lines), text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return len(lines), b"\n".join([x for i, x in enumerate(lines) if i >= len(bits) or bits[i]])


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, str]:
    """Every row of ``docs`` with its bitmap (null: all stays), and that column's name."""
    doc, row, own = free_name(docs, "doc"), free_name(docs, "row"), free_name(docs, "bitmap")
    keys = identified(docs, doc_id, text)
    left = docs.withColumns({doc: keys[0], row: keys[1]})
    doc_r, row_r = free_name(left, "doc_r"), free_name(left, "row_r")
    right = bitmaps.select(
        F.col("doc").alias(doc_r), F.col("row").alias(row_r), F.col("bitmap").alias(own)
    ).hint("shuffle_hash")
    on = (F.col(doc) == F.col(doc_r)) & (F.col(row) == F.col(row_r))
    return left.join(right, on, "left").select(*docs.columns, own), own


def drop_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """``docs``, all columns, with the repeated lines gone from ``text``; null stays null."""
    joined, own = with_bitmaps(docs, keep_bitmaps(docs, doc_id, text, **limits), doc_id, text)
    names = docs.columns
    place = names.index(text)

    def run(batches):
        for batch in batches:
            columns = list(batch.columns[:-1])
            new = [
                x if x is None or m is None else kept_lines(x, m)[1]
                for x, m in zip(columns[place].cast(pa.binary()).to_pylist(), batch.column(len(columns)).to_pylist(), strict=True)
            ]
            columns[place] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined, own = with_bitmaps(docs, keep_bitmaps(docs))
    schema = T.StructType().add("doc_id", "long").add("n_lines", "long").add("n_dropped", "long").add("kept_sha256", "string")

    def run(batches):
        for batch in batches:
            n_lines, n_dropped, digests = [], [], []
            for text, bitmap in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                lines, kept = kept_lines(text, bitmap)
                bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8)) if bitmap else np.ones(0)
                n_lines.append(lines)
                n_dropped.append(int(len(bits) - bits.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(digests)],
                names=schema.names,
            )

    return joined.mapInArrow(run, schema)


QUERIES = {"op8_line_dedup": op8_line_dedup}
SQL = {
    "op8_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, place, line, translate(
    regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
           generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
    FROM documents)
), common AS (
  SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT l.doc_id, l.place, l.line, c.last IS NOT NULL AND l.doc_id < c.last AS gone
  FROM lines l LEFT JOIN common c ON l.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
}
