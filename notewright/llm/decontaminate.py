"""Benchmark decontamination by an Aho-Corasick automaton, and op10_decontaminate.

Words of the benchmark items (A-Z in lower case) are numbered, and their windows go into one
automaton over word numbers, ten nodes a window at most; a document is scanned once, and
what is hit is given as words and as places in the original text. Items are read in blocks
of a bounded number of words, so that no automaton grows with the benchmark: there is one
scan a block, and only what a scan hits is kept of it."""

from __future__ import annotations

from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.common import WORD, _arrow_type, free_name, map_text, table, texts
from notewright.session import materialize

WINDOW = 10
BLOCK_WORDS = 100_000  # of items in one automaton
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("hit_words", SPAN),
    T.StructField("hit_chars", SPAN),
]


class Windows:
    """The automaton of some items: for each window how many words it has and which items (by
    number) hold it."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        self.names, self.numbers = [name for name, _ in items], {}
        held: dict[tuple[int, ...], set[int]] = {}
        for number, (_, text) in enumerate(items):
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in WORD.findall(text.lower()))
            for i in range(max(1, len(words) - size + 1) if words else 0):
                held.setdefault(words[i : i + size], set()).add(number)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, numbers in held.items():
            self.automaton.add_word(window, tuple(sorted(numbers)) + (len(window),))
        if held:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[set[str], list[tuple[int, int]]]:
        """(items, runs of words) that the words of a text hit; 0 is a word that no item has."""
        items: set[str] = set()
        hit = np.zeros(len(words), bool)
        if len(self.automaton) and words:
            number = self.numbers.get
            for last, (*numbers, size) in self.automaton.iter(tuple([number(w, 0) for w in words])):
                hit[last + 1 - size : last + 1] = True
                items.update(self.names[i] for i in numbers)
        return items, runs(hit)


def runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def fields_of(text: bytes, low: bytes, words: list[bytes], found: list[tuple[set[str], list[tuple[int, int]]]]) -> dict:
    """The result fields of one text from what its scans found."""
    hit = np.zeros(len(words), bool)
    for _, places in found:
        for start, end in places:
            hit[start:end] = True
    hit_words, hit_chars = runs(hit), []
    if hit_words:
        spans = [m.span() for m in WORD.finditer(low)]
        at = [spans[s][0] for s, _ in hit_words] + [spans[e - 1][1] for _, e in hit_words]
        heads = np.flatnonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)  # bytes that begin a character
        places = np.searchsorted(heads, at).tolist()
        hit_chars = list(zip(places[: len(hit_words)], places[len(hit_words) :], strict=True))
    items = sorted(set().union(*(i for i, _ in found)))
    return {"n_words": len(words), "n_hit": int(hit.sum()), "items": items, "hit_words": hit_words, "hit_chars": hit_chars}


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    keep: list[str] | None = None,
) -> DataFrame:
    """One row a document row: the columns ``keep``, n_words, n_hit, items (ids as strings,
    sorted), hit_words and hit_chars (maximal hit runs, ends exclusive, chars in the text
    as given). A window is ``size`` consecutive words of an item, or all words of a
    shorter one; items without words and null texts hit nothing; an item without an id
    is called 'null'. No items: nothing is hit. Repeated rows give repeated results. Items of
    more than ``block_words`` words take a scan for each block of about as many."""
    spark = docs.sparkSession
    named = items.select(
        F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"),
        F.coalesce(F.col(item_text).cast("binary"), F.lit("").cast("binary")).alias("text"),
    ).distinct()
    low = F.lower(F.col("text").cast("string"))
    total = named.agg(F.sum(F.regexp_count(low, F.lit(PATTERN))).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total * 5 // (4 * block_words)) if total > block_words else 1)
    kept = list(docs.columns if keep is None else keep)
    kept = [c for c in kept if c.lower() not in {f.name.lower() for f in FIELDS}]
    if blocks == 1:
        return _one_block(docs, _shared(named), text, size, kept)
    named = materialize(named.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))), "items")
    source, row, found = (free_name(docs, name) for name in ("source_text", "source_row", "found"))
    # written once, with a number for each row, by which its hits come back to it
    rows = docs.select(*(docs[c] for c in kept), docs[text].cast("binary").alias(source), F.monotonically_increasing_id().alias(row))
    rows = materialize(rows, "decontaminate")
    slim = rows.select(F.col(row).alias("row"), F.col(source).alias("text"))
    # about block_words at most: hashed blocks
    hits = reduce(DataFrame.union, [_hits(slim, _shared(named.filter(F.col("block") == b)), size) for b in range(blocks)])
    # one entry a block that hits a row
    hits = materialize(hits.groupBy("row").agg(F.collect_list(F.struct("items", "hit_words")).alias("found")), "hits")
    hits = hits.select(F.col("row").alias(f"{row}_hit"), F.col("found").alias(found))
    joined = rows.join(hits, F.col(row) == F.col(f"{row}_hit"), "left").select(*kept, source, found)
    schema = T.StructType([*(rows.schema[c] for c in kept), *FIELDS])

    def run(batches):
        for batch in batches:
            made = []
            for item, told in zip(texts(batch.column(len(kept))), batch.column(len(kept) + 1).to_pylist(), strict=True):
                low = item.lower()
                parts = [(set(t["items"]), [(x["start"], x["end"]) for x in t["hit_words"]]) for t in told or []]
                made.append(fields_of(item, low, WORD.findall(low), parts))
            columns = [pa.array([r[f.name] for r in made], _arrow_type(f.dataType)) for f in FIELDS]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], names=schema.names)

    return joined.mapInArrow(run, schema)


def _shared(named: DataFrame):
    """A broadcast of the items of one block."""
    rows = sorted((r["id"], bytes(r["text"])) for r in named.select("id", "text").collect())
    return named.sparkSession.sparkContext.broadcast(rows)


def _one_block(docs: DataFrame, shared, text: str, size: int, kept: list[str]) -> DataFrame:
    def make():
        windows = Windows(shared.value, size)

        def work(items):
            made = []
            for item in items:
                low = item.lower()
                words = WORD.findall(low)
                made.append(fields_of(item, low, words, [windows.scan(words)]))
            return [[r[f.name] for r in made] for f in FIELDS]

        return work

    return map_text(docs, make, FIELDS, text, kept)


def _hits(rows: DataFrame, shared, size: int) -> DataFrame:
    """(row, items, hit_words) of the rows that a block of items hits."""
    made = [FIELDS[2], FIELDS[3]]

    def run(batches):
        windows = Windows(shared.value, size)
        for batch in batches:
            out = [(row, *windows.scan(WORD.findall(text.lower()))) for row, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True)]
            out = [(row, sorted(items), places) for row, items, places in out if items]
            columns = zip(*out, strict=True) if out else ([], [], [])
            kinds = [pa.int64(), *(_arrow_type(f.dataType) for f in made)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["row", "items", "hit_words"])

    return rows.mapInArrow(run, T.StructType([T.StructField("row", T.LongType()), *made]))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that hold a window of an item."""
    plain = docs
    taken = {f.name for f in FIELDS}
    renamed = {}
    for name in docs.columns:  # a column in any case, as Spark tells names apart without it
        if name.lower() in taken:
            renamed[name] = free_name(plain, "own_" + name)
            plain = plain.withColumnRenamed(name, renamed[name])
    found = decontaminate(plain, items, keep=plain.columns).filter(F.col("n_hit") == 0)
    return found.select(*(F.col(renamed.get(c, c)).alias(c) for c in docs.columns))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op10_decontaminate": op10_decontaminate}
SQL = {
    "op10_decontaminate": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS key
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), places AS (
  SELECT doc_id, size, i, array_to_string(w[i : i + size - 1], ' ') AS key
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i
        FROM words, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)
), found AS (
  SELECT p.doc_id, p.i, p.size, v.item_id FROM places p JOIN windows v ON p.size = v.size AND p.key = v.key
), hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items,
       sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN hits h ON w.doc_id = h.doc_id LEFT JOIN named n ON w.doc_id = n.doc_id
"""
}
