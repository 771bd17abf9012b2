"""Ranked lexical search over a tree of documents' term vectors, and op13_lexical_search.

The terms of the items are the only ones that count, so every document becomes a vector of
those it holds. A task takes vectors a block at a time, orders each by the terms' frequency
and builds a tree of shared paths. A node knows, for the documents below it, the largest tf
of every term, the least m and the least id; from these an item's score below the node is
bounded, and the item's search goes down depth first, best bound first, leaving out what
can't reach its best documents so far. Each task hands on its best documents for each item."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.common import CHUNK_BYTES, WORD, map_text, table
from notewright.session import materialize

GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
SALTS = 32


@dataclass(frozen=True)
class SearchParams:
    """``top`` documents an item; ``block_pairs`` (document, term) pairs make a tree, whose
    leaves hold ``leaf`` documents unless more have the same terms; ``item_bytes`` of items
    are searched for in one pass over the documents."""

    top: int = 20
    block_pairs: int = 1 << 20
    leaf: int = 32
    item_bytes: int = 1 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, some at a time; a cut falls between words."""
    at = 0
    while at < len(text):
        gap = GAP.search(text, at + CHUNK_BYTES) if at + CHUNK_BYTES < len(text) else None
        end = gap.start() if gap else len(text)
        yield WORD.findall(text[at:end].lower())
        at = end


def vectors(docs: DataFrame, vocabulary, doc_id: str, text: str) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row: the number of its words, and the numbers and
    counts of those in the broadcast ``vocabulary``."""
    ints = T.ArrayType(T.IntegerType())
    fields = [T.StructField("n", T.LongType()), T.StructField("terms", ints), T.StructField("tfs", ints)]

    def make():
        number = vocabulary.value

        def work(items: list[bytes]) -> list:
            out: tuple[list, list, list] = ([], [], [])
            for item in items:
                n, found = 0, Counter()
                for words in terms(item):
                    n += len(words)
                    found.update(filter(number.__contains__, words))
                out[0].append(n)
                out[1].append([number[w] for w in found])
                out[2].append(list(found.values()))
            return out

        return work

    plain = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("body"))
    return map_text(plain, make, fields, "body", ["doc_id"])


def gains(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def largest(node: np.ndarray, term: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry a term and node, with the largest tf, in that order."""
    by = np.lexsort((node, term))
    node, term, tf = node[by], term[by], tf[by]
    heads = np.flatnonzero(np.concatenate([[len(node) > 0], (node[1:] != node[:-1]) | (term[1:] != term[:-1])])[: len(node)])
    return node[heads], term[heads], np.maximum.reduceat(tf, heads) if len(heads) else tf


class Tree:
    """Documents as a tree of their terms in order of frequency. Documents of a node, and the
    leaves below it, are a range of the sorted documents; nodes are numbered parents first."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, m: np.ndarray, first: np.ndarray, order: np.ndarray, tf: np.ndarray, leaf: int):
        """``order`` has the terms' places in the order of frequency, for each document those
        from ``first[i]`` to ``first[i + 1]``."""
        doc = np.repeat(np.arange(len(ids)), np.diff(first))
        by = np.lexsort((order, doc))
        order, tf = order[by], tf[by]
        wide = order.astype(">u4").tobytes()
        ends = (first * 4).tolist()
        row = np.array(sorted(range(len(ids)), key=lambda i: wide[ends[i] : ends[i + 1]]), np.int64)
        count = np.diff(first)[row]
        self.first = np.concatenate([[0], np.cumsum(count)])
        take = np.repeat(first[row] - self.first[:-1], count) + np.arange(self.first[-1])
        self.order, self.tf, self.ids, self.null, self.m = order[take], tf[take], ids[row], null[row], m[row]
        self.start, self.end, self.children, parent = [], [], [], []
        todo = [(0, len(ids), 0, -1)]
        leaves = []
        while todo:
            start, end, depth, above = todo.pop()
            node = len(self.start)
            self.start.append(start)
            self.end.append(end)
            self.children.append([])
            parent.append(above)
            if above >= 0:
                self.children[above].append(node)
            parts = self._split(start, end, depth, leaf) if end - start > leaf else []
            if parts:
                todo += [(*p, node) for p in parts]
            else:
                leaves.append(node)
        self.parent = np.array(parent)
        self._summarise(np.array(sorted(leaves, key=self.start.__getitem__)))

    def _split(self, start: int, end: int, depth: int, leaf: int) -> list[tuple[int, int, int]]:
        """Ranges of documents that go on with one term each, few documents put together;
        none where all have the same terms. A shared path is one step."""
        while True:
            at = self.first[start:end] + depth
            inside = at < self.first[start + 1 : end + 1]
            if not inside.any():
                return []
            step = np.where(inside, self.order[np.minimum(at, len(self.order) - 1)], -1)
            cuts = np.flatnonzero(step[1:] != step[:-1]) + 1
            if len(cuts):
                break
            depth += 1
        edges = [0, *cuts.tolist(), end - start]
        parts: list[tuple[int, int, int]] = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if parts and start + b - parts[-1][0] <= leaf:
                parts[-1] = (parts[-1][0], start + b, depth)
            else:
                parts.append((start + a, start + b, depth + 1))
        return parts

    def _summarise(self, leaves: np.ndarray) -> None:
        """Least m and id of every node, and for each term the nodes that hold it with the
        largest tf below them."""
        n = len(self.start)
        starts = np.array(self.start)[leaves]
        self.least_m, self.least_id = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).max)
        self.least_m[leaves] = np.minimum.reduceat(self.m, starts)
        self.least_id[leaves] = np.minimum.reduceat(self.ids, starts)
        owner = np.repeat(leaves, np.diff(np.append(starts, len(self.ids))))
        node, term, most = np.repeat(owner, np.diff(self.first)), self.order, self.tf
        depth = np.zeros(n, np.int64)
        for k in range(1, n):
            depth[k] = depth[self.parent[k]] + 1
        found = []
        above = (np.zeros(0, np.int64),) * 3
        for level in range(int(depth.max()), -1, -1):  # a node's entries are complete before they go up
            own = depth[node] == level
            entries = largest(*(np.concatenate([x[own], y]) for x, y in zip((node, term, most), above, strict=True)))
            found.append(entries)
            above = (self.parent[entries[0]], *entries[1:])
        for k in range(n - 1, 0, -1):
            above = self.parent[k]
            self.least_m[above] = min(self.least_m[above], self.least_m[k])
            self.least_id[above] = min(self.least_id[above], self.least_id[k])
        self.node, term, most = largest(*(np.concatenate(x) for x in zip(*found, strict=True)))
        self.gain = gains(most, self.least_m[self.node])
        self.terms, self.at = np.unique(term, return_index=True)
        self.at = np.append(self.at, len(term))

    def bounds(self, item: list[tuple[int, int]]) -> np.ndarray:
        """For every node, a score that no document below it exceeds. ``item``: pairs of a
        term's place and its weight times its occurrences."""
        out = np.zeros(len(self.start), np.int64)
        where = np.searchsorted(self.terms, [t for t, _ in item])
        for k, (t, weight) in zip(where.tolist(), item, strict=True):
            if k < len(self.terms) and self.terms[k] == t:
                some = slice(self.at[k], self.at[k + 1])
                out[self.node[some]] += weight * self.gain[some]
        return out

    def search(self, item: list[tuple[int, int]], weights: np.ndarray, best: list[tuple], top: int) -> int:
        """Brings the documents below into ``best``, a heap of (score, no null id, -id), and
        returns the number of leaves looked into. ``weights`` has the item's weights by place."""
        bound = self.bounds(item).tolist()
        looked = 0
        todo = [0]
        while todo:
            node = todo.pop()
            # equal scores are ordered by id, so a subtree that can only tie needs a smaller one
            if bound[node] == 0 or len(best) == top and (bound[node], 1, -int(self.least_id[node])) <= best[0]:
                continue
            if self.children[node]:
                todo += sorted(self.children[node], key=bound.__getitem__)
                continue
            looked += 1
            start, end = self.start[node], self.end[node]
            lo, hi = self.first[start], self.first[end]
            weight = weights[self.order[lo:hi]]
            of = np.repeat(np.arange(end - start), np.diff(self.first[start : end + 1]))
            some = np.flatnonzero(weight)
            of, part = of[some], weight[some] * gains(self.tf[lo:hi][some], self.m[start:end][of[some]])
            score = np.zeros(end - start, np.int64)
            np.add.at(score, of, part)
            ids, null = self.ids[start:end], self.null[start:end]
            for k in np.lexsort((ids, null, -score))[:top].tolist():
                if score[k] <= 0:
                    break
                entry = (int(score[k]), 0 if null[k] else 1, -int(ids[k]))
                if len(best) < top:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                else:
                    break
        return looked


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and values of a list column."""
    return np.diff(column.offsets.to_numpy()).astype(np.int64), column.flatten().to_numpy().astype(np.int64)


def best_of(found: DataFrame, items, orders, totals: tuple[int, int], params: SearchParams) -> DataFrame:
    """(item, doc_id, score): of each task's documents the best for every item. ``items`` and
    ``orders`` are broadcasts: pairs of place and weight an item, and the place of each term."""
    n_docs, n_words = totals

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, place = items.value, orders.value
        best: list[list[tuple]] = [[] for _ in wanted]
        weights = np.zeros(len(place), np.int64)

        def search(held: list[pa.RecordBatch]) -> None:
            whole = pa.Table.from_batches(held).combine_chunks()
            ids, n, lists, tfs = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in whole.columns)
            lengths, numbers = _flat(lists)
            null = np.array(ids.is_null().to_numpy(zero_copy_only=False))
            # longer products than 64 bits hold are made of Python's integers
            product = n.to_numpy().astype(object) if 25 * int(n.to_numpy().max()) * n_docs >= 1 << 63 else n.to_numpy()
            m = (75 + (25 * product * n_docs) // n_words).astype(np.int64)
            tree = Tree(
                ids.fill_null(0).to_numpy().astype(np.int64), null, m, np.concatenate([[0], np.cumsum(lengths)]), place[numbers], _flat(tfs)[1], params.leaf
            )
            for item, heap in zip(wanted, best, strict=True):
                at = [t for t, _ in item]
                weights[at] = [w for _, w in item]
                tree.search(item, weights, heap, params.top)
                weights[at] = 0

        held: list[pa.RecordBatch] = []
        pairs = 0
        for batch in batches:
            # one batch may hold more than a tree should
            lengths = np.cumsum(_flat(batch.column(2))[0])
            at = 0
            while at < batch.num_rows:
                done = lengths[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(lengths, done + params.block_pairs - pairs, "right")))
                held.append(batch.slice(at, end - at))
                pairs += int(lengths[end - 1] - done)
                at = end
                if at < batch.num_rows or pairs >= params.block_pairs:
                    search(held)
                    held, pairs = [], 0
        if held:
            search(held)
        rows = [(i, None if not known else -id_, score) for i, heap in enumerate(best) for score, known, id_ in heap]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        kinds = [pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["item", "doc_id", "score"])

    return found.filter(F.size("terms") > 0).select("doc_id", "n", "terms", "tfs").mapInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", params: SearchParams = SearchParams()) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``params.top`` best documents of each item, by
    score and then by id (a null id comes last); documents that score 0 aren't ranked. Each
    row of ``docs`` is a document and each row of ``items`` an item, also where ids or whole
    rows repeat; null and empty texts have no words. Without documents or items, no rows.
    Other columns play no part. Items beyond ``params.item_bytes`` take further passes."""
    spark = docs.sparkSession
    kind = items.schema[item_id].dataType
    asked = items.select(items[item_id].cast("string").alias("id"), F.coalesce(items[item_text].cast("binary"), F.lit("").cast("binary")).alias("body"))
    total = asked.agg(F.sum(F.octet_length("body") + F.lit(64)).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total * 5 // (4 * params.item_bytes)) if total > params.item_bytes else 1)
    if blocks > 1:
        asked = materialize(asked.withColumn("block", F.pmod(F.xxhash64("id", "body"), F.lit(blocks))), "items")
    made = []
    for block in range(blocks):
        part = asked if blocks == 1 else asked.filter(F.col("block") == block)
        # about item_bytes at most: hashed blocks, and one block only where all fits
        rows = sorted(((r["id"], bytes(r["body"])) for r in part.select("id", "body").collect()), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
        held = [Counter(w for words in terms(body) for w in words) for _, body in rows]
        number = {w: i for i, w in enumerate(sorted(set().union(*held)))}
        if not number:
            continue
        found = materialize(vectors(docs, spark.sparkContext.broadcast(number), doc_id, text), "term-vectors")
        n_docs, n_words = found.filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            continue
        # a row for each term of the block's items at most
        counted = dict(found.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weight = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * counted.get(t, 0) + 1))) for t in range(len(number))]
        place = np.empty(len(number), np.int64)
        place[sorted(range(len(number)), key=lambda t: (-counted.get(t, 0), t))] = np.arange(len(number))
        wanted = [[(int(place[number[w]]), weight[number[w]] * k) for w, k in sorted(h.items()) if weight[number[w]] > 0] for h in held]
        share = spark.sparkContext.broadcast
        best = best_of(found, share(wanted), share(place), (n_docs, n_words), params)
        names = F.broadcast(spark.createDataFrame([(i, id_) for i, (id_, _) in enumerate(rows)], "item int, id string"))  # of one block of items
        made.append(best.withColumn("block", F.lit(block)).join(names, "item"))
    if not made:
        return items.select(items[item_id].alias("item_id"), F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rows = reduce(DataFrame.unionByName, made).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    for by in (["block", "item", "salt"], ["block", "item"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= params.top)
    return rows.select(F.col("id").cast(kind).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_lexical_search": op13_lexical_search}
SQL = {
    "op13_lexical_search": r"""
WITH words AS (
  SELECT doc_id, row, len(w) AS n, w FROM (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents) WHERE len(w) > 0
), asked AS (
  SELECT item_id, item, term, count(*) AS times FROM (SELECT item_id, row_number() OVER () AS item, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM words
), counts AS (
  SELECT doc_id, row, 75 + (25 * n * docs) // length AS m, term, count(*) AS tf
  FROM (SELECT doc_id, row, n, unnest(w) AS term FROM words), totals WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM counts GROUP BY term), totals
), scores AS (
  SELECT item_id, item, doc_id, row, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN counts USING (term) GROUP BY ALL HAVING score > 0
)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS place FROM scores) WHERE place <= 20
"""
}
