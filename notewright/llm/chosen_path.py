"""N-gram Jaccard join by chosen paths, and op4_jaccard_join.

Documents with the same set of word shingles are one set. Each set has a sketch: the least
hash in each of 128 bins. A run splits the sets recursively on tokens (bin, hash) sampled
from the sketches, where sets that share a token may choose the same one; buckets that are
small, or have been split often enough, are compared by brute force, in blocks. There are
as many runs as the target recall needs. Candidates are then compared exactly on their
whole sets, again in blocks, and no pair is ever written: a block gives each set its number
of links and the root of its local component."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.common import Words, chunks, free_name, mix, prepare, table, texts
from notewright.llm.components import components
from notewright.session import materialize

NO_ID = -(2**63)
BINS = 128
AT_ONCE = 48  # groups up to this size are compared many at a time


@dataclass(frozen=True)
class JoinParams:
    """``slack`` is how far a sketch may fall short of ``similarity``: over four standard
    deviations of 128 bins. ``branching`` is the mean number of tokens a set chooses;
    buckets above ``leaf`` sets are split, at most ``depth`` times; ``sketch_block``
    sketches or ``block`` whole sets a side are compared by one task at once."""

    words: int = 5
    similarity: float = 0.8
    recall: float = 0.9999
    slack: float = 0.15
    branching: float = 2.0
    leaf: int = 4096
    depth: int = 3
    sketch_block: int = 4096
    block: int = 1024

    @property
    def runs(self) -> int:
        """Runs until a pair at the threshold has met with probability ``recall``. Its
        tokens survive one split with 1 - exp(-branching * agreement * survival below);
        the sketches' agreement is taken two standard deviations low."""
        agreement = self.similarity - 2 * math.sqrt(self.similarity * (1 - self.similarity) / BINS)
        met = 1.0
        for _ in range(self.depth):
            met = 1 - math.exp(-self.branching * agreement * met)
        return math.ceil(math.log(1 - self.recall) / math.log(1 - met))


def shingle_sets(items: list[bytes], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for start, end in chunks(items):
        docs, values = Words(items[start:end]).shingles(size)
        order = np.lexsort((values, docs))
        docs, values = docs[order], values[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
        out += np.split(values[new], np.searchsorted(docs[new], np.arange(1, end - start)))
    return out


def sketch(values: np.ndarray) -> np.ndarray:
    """Least hash in each bin; 0 where a bin is empty. ``values`` are sorted, and the bin
    is given by the high bits, so each bin's first value is its least."""
    bins = (values >> np.uint64(57)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))
    out = np.zeros(BINS, np.uint32)
    out[bins[first]] = np.maximum((values[first] >> np.uint64(25)).astype(np.uint32), 1)
    return out


def chosen(paths: np.ndarray, sketches: np.ndarray, branching: float) -> tuple[np.ndarray, np.ndarray]:
    """For each (path, sketch): the tokens it chooses, as (row, new path). A token is chosen
    by a hash of the path and the token alone, so sets that share both choose alike."""
    tokens = sketches.astype(np.uint64) << np.uint64(7) | np.arange(BINS, dtype=np.uint64)
    hashes = mix(mix(tokens + np.uint64(1)) ^ paths[:, None])
    filled = sketches != 0
    share = np.minimum(1.0, branching / np.maximum(1, filled.sum(1)))[:, None]
    picked = filled & ((hashes >> np.uint64(11)) * 2.0**-53 < share)
    rows, at = np.nonzero(picked)
    return rows, mix(hashes[rows, at] + np.uint64(1))


def documents_sets(docs: DataFrame, doc_id: str, text: str, words: int) -> DataFrame:
    """(doc, row, set_id, n, sketch) of every document row; set_id null without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingle_sets(texts(batch.column(2)), words)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found], pa.binary()),
                    pa.array([len(x) for x in found], pa.int32()),
                    pa.array([sketch(x).tobytes() if len(x) else None for x in found], pa.binary()),
                ],
                names=["doc", "row", "set_id", "n", "sketch"],
            )

    rows = docs.select(
        F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("row"),
        docs[text].cast("binary").alias("bytes"),
    )
    return rows.mapInArrow(run, "doc long, row long, set_id binary, n int, sketch binary")


def as_sketches(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BINS)


def split(rows: DataFrame, branching: float, runs: int = 0) -> DataFrame:
    """(path, set_id) from rows (set_id, sketch) and, below the first level, path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sketches = as_sketches(part.column(1))
                starts = (
                    [np.full(len(sketches), mix(np.array([r + 1], np.uint64))[0]) for r in range(runs)]
                    if runs
                    else [part.column(2).to_numpy().view(np.uint64)]
                )
                for paths in starts:
                    picked, new = chosen(paths, sketches, branching)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(new.view(np.int64)), part.column(0).take(pa.array(picked))], names=["path", "set_id"]
                    )

    return rows.mapInArrow(run, "path long, set_id binary")


def leaves(sets: DataFrame, params: JoinParams) -> Iterator[DataFrame]:
    """Buckets to compare, (path, set_id, size), level by level."""
    paths = split(sets.select("set_id", "sketch"), params.branching, params.runs)
    for level in range(1, params.depth + 1):
        paths = materialize(paths, "paths")
        sizes = paths.groupBy("path").agg(F.count("*").alias("size")).filter(F.col("size") > 1)
        buckets = materialize(paths.join(sizes, "path"), "buckets")
        small = F.col("size") <= params.leaf
        yield buckets if level == params.depth else buckets.filter(small)
        large = buckets.filter(~small)
        if level == params.depth or large.isEmpty():
            return
        paths = split(large.join(sets, "set_id").select("set_id", "sketch", "path"), params.branching)


def dealt(rows: DataFrame, group: str, size: Column, block: int) -> DataFrame:
    """Rows with ``g`` and ``block``, so that all pairs of a group of any size meet: a group
    above ``block`` rows is cut into blocks, and a task gets two of them at once."""
    cuts = F.greatest(F.lit(1), F.ceil(size / F.lit(block))).cast("int")
    own = F.pmod(F.xxhash64(F.lit(5), F.col("set_id")), F.col("cuts")).cast("int")
    cut = rows.withColumn("cuts", cuts).withColumn("block", own)
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda other: F.xxhash64(F.lit(11), F.col(group), F.least(F.col("block"), other), F.greatest(F.col("block"), other)),
    )
    alone = F.array(F.xxhash64(F.lit(11), F.col(group), F.lit(0), F.lit(0)))
    return cut.withColumn("g", F.explode(F.when(F.col("cuts") == 1, alone).otherwise(pairs)))


def whole_groups(batches: Iterator[pa.RecordBatch], at: int, rows: int = 4096) -> Iterator[pa.Table]:
    """Tables of whole groups, about ``rows`` rows each, from batches sorted by column
    ``at``; more only where one group has more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        whole = pa.Table.from_batches(held).combine_chunks()
        keys = whole.column(at).to_numpy()
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield whole.slice(0, cut)
        held = whole.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bounds(keys: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])


def roots_of(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least node that each of ``n`` nodes reaches over the links."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        new = root.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, root[left], low)
        np.minimum.at(new, root[right], low)
        new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    return root


def alike(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Whether sketches agree on enough of the bins that either has."""
    same = ((a == b) & (a != 0)).sum(-1)
    return same >= least * np.maximum(1, ((a != 0) | (b != 0)).sum(-1))


def candidates(buckets: DataFrame, sets: DataFrame, params: JoinParams) -> DataFrame:
    """Links (a, b) from each set of a bucket to its local root, by sketches."""
    least = params.similarity - params.slack
    rows = dealt(buckets.join(sets.select("set_id", "sketch"), "set_id"), "path", F.col("size"), params.sketch_block)
    ordered = rows.select("g", "block", "set_id", "sketch").repartition("g").sortWithinPartitions("g", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, 0):
            sketches = as_sketches(part.column(3).combine_chunks())
            left, right = [], []
            edges = bounds(part.column(0).to_numpy())
            sizes = np.diff(edges)
            for size in np.unique(sizes[(sizes > 1) & (sizes <= AT_ONCE)]):  # groups of one size at once
                i, j = np.triu_indices(size, 1)
                starts = edges[:-1][sizes == size]
                for some in np.array_split(starts, max(1, len(starts) * len(i) // 8192)):
                    a, b = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                    ok = alike(sketches[a], sketches[b], least)
                    left.append(a[ok])
                    right.append(b[ok])
            for k in np.flatnonzero(sizes > AT_ONCE):
                for a in range(edges[k], edges[k + 1] - 1):
                    b = np.flatnonzero(alike(sketches[a], sketches[a + 1 : edges[k + 1]], least)) + a + 1
                    left.append(np.full(len(b), a))
                    right.append(b)
            if left:
                root = roots_of(part.num_rows, np.concatenate(left), np.concatenate(right))
                moved = np.flatnonzero(root != np.arange(len(root)))
                ids = part.column(2).combine_chunks()
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(moved)), ids.take(pa.array(root[moved]))], names=["a", "b"])

    return ordered.mapInArrow(run, "a binary, b binary")


def overlaps(members: list[np.ndarray], slab: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, from slabs of shared tokens as 0/1 matrices."""
    n = len(members)
    out = np.zeros((n, n), np.float32)
    owner = np.repeat(np.arange(n), [len(m) for m in members])
    _, token, count = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(count > 1)
    place = np.full(len(count), -1)
    place[shared] = np.arange(len(shared))
    token = place[token]
    for start in range(0, len(shared), slab):
        here = (token >= start) & (token < start + slab)
        ones = np.zeros((n, min(slab, len(shared) - start)), np.float32)
        ones[owner[here], token[here] - start] = 1
        out += ones @ ones.T
    return out


def distinct_sets(of_docs: DataFrame) -> DataFrame:
    """(set_id, doc, row, copies, sketch): each set once, with the least row that has it."""
    least = F.min(F.struct("doc", "row")).alias("least")
    sets = of_docs.filter(F.col("set_id").isNotNull()).groupBy("set_id").agg(least, F.count("*").alias("copies"), F.first("sketch").alias("sketch"))
    return sets.select("set_id", "least.doc", "least.row", "copies", "sketch")


def member_texts(docs: DataFrame, members: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(bytes, set_id, copies, comp, size) of the rows that stand for the sets: joined by id
    and text, so that rows that share an id, or have none, don't multiply."""
    rows = docs.select(
        F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(F.coalesce(docs[text], F.lit(""))).alias("row"),
        docs[text].cast("binary").alias("bytes"),
    )
    return rows.join(members, ["doc", "row"]).select("bytes", "set_id", "copies", "comp", "size")


def exact_links(docs: DataFrame, members: DataFrame, doc_id: str, text: str, params: JoinParams) -> DataFrame:
    """(set_id, links, root): for each set of a candidate class, the number of document rows
    that other sets of similarity reached stand for, and its local root; several rows a
    set, one for each pair of blocks. ``members`` (doc, row, set_id, copies, comp, size)."""
    rows = member_texts(docs, members, doc_id, text)
    schema = T.StructType.fromDDL("set_id binary, copies long, comp binary, size long, tokens binary")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x.tobytes() for x in shingle_sets(texts(batch.column(0)), params.words)]
            ids = batch.column(1).to_pylist()
            # rows that share an id and a text's hash but have another text are not the set's
            own = pa.array([i for i, x in enumerate(found) if xxhash.xxh3_128_digest(x) == ids[i]], pa.int64())
            part = batch.take(own)
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(found, pa.binary()).take(own)], names=schema.names)

    sets = rows.mapInArrow(tokens, schema)
    blocks = dealt(sets, "comp", F.col("size"), params.block)
    ordered = blocks.select("g", "block", "cuts", "set_id", "copies", "tokens").repartition("g").sortWithinPartitions("g", "block", "set_id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, 0, 1024):
            edges = bounds(part.column(0).to_numpy())
            block = part.column(1).to_numpy()
            ids = part.column(3).to_pylist()
            copies = part.column(4).to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in part.column(5).to_pylist()]
            out: tuple[list, list, list] = ([], [], [])
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                at = [i for i in range(start, end) if i == start or ids[i] != ids[i - 1]]  # repeated rows once
                sizes = np.array([len(sets[i]) for i in at], np.float64)
                both = overlaps([sets[i] for i in at])
                linked = both >= params.similarity * (sizes[:, None] + sizes - both) - 1e-9
                np.fill_diagonal(linked, False)
                side = block[at]
                if side[0] != side[-1]:  # two blocks: pairs across; pairs within are another task's
                    linked &= side[:, None] != side
                root = roots_of(len(at), *np.nonzero(linked))
                out[0].extend(ids[i] for i in at)
                out[1].extend((linked @ copies[at]).tolist())
                out[2].extend(ids[at[r]] for r in root)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.binary())],
                names=["set_id", "links", "root"],
            )

    return ordered.mapInArrow(compare, "set_id binary, links long, root binary")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """One row (doc, row, class_doc, n_links, first) for each row of ``docs``, ``doc`` the id
    (-2**63 for null) and ``row`` the text's hash. ``class_doc`` is the least id of the
    class that links of similarity reach; ``n_links`` the number of other rows linked
    directly, copies counted one by one; ``first`` whether the row is the class's one to
    keep. Rows without words link with nothing. Texts of fewer words than a shingle have
    one shingle of all their words. Rows with one id are documents of their own; rows
    alike in id and text are first together, and ``keep_first`` leaves one of them."""
    prepare(docs.sparkSession)
    of_docs = materialize(documents_sets(docs, doc_id, text, params.words), "sets")
    sets = materialize(distinct_sets(of_docs), "distinct-sets")
    found = None
    for buckets in leaves(sets, params):
        some = candidates(buckets, sets, params)
        found = some if found is None else found.union(some)
    rough = components(found, "rough")
    sizes = rough.groupBy("root").agg(F.count("*").alias("size"))
    members = rough.join(sizes, "root").select(F.col("id").alias("set_id"), F.col("root").alias("comp"), "size")
    members = members.join(sets.select("set_id", "doc", "row", "copies"), "set_id").select("doc", "row", "set_id", "copies", "comp", "size")
    links = materialize(exact_links(docs, members, doc_id, text, params), "links")
    classes = components(links.select(F.col("set_id").alias("a"), F.col("root").alias("b")), "classes")
    counted = links.groupBy("set_id").agg(F.sum("links").alias("links"))
    known = materialize(
        sets.select("set_id", "doc", "copies")
        .join(counted, "set_id", "left")
        .join(classes.withColumnRenamed("id", "set_id"), "set_id", "left")
        .select("set_id", "doc", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "set_id").alias("root")),
        "known",
    )
    firsts = known.groupBy("root").agg(F.min(F.struct("doc", "set_id")).alias("least"))
    of_sets = known.join(firsts, "root").select(
        F.col("set_id"), "n_links", F.col("least.doc").alias("class_doc"), (F.col("least.set_id") == F.col("set_id")).alias("own")
    )
    rows = materialize(of_docs.select("doc", "row", "set_id").join(of_sets, "set_id", "left"), "near-copies")
    alone = F.col("set_id").isNull()
    # only rows that repeat the first one's id can tie; the number of the least row settles it
    lead = rows.filter(F.col("own") & (F.col("doc") == F.col("class_doc")))
    ties = lead.groupBy("set_id").agg(F.min("row").alias("least_row"))
    return rows.join(ties, "set_id", "left").select(
        "doc",
        "row",
        F.when(alone, F.col("doc")).otherwise(F.col("class_doc")).alias("class_doc"),
        F.when(alone, F.lit(0)).otherwise(F.col("n_links")).cast("long").alias("n_links"),
        (alone | (F.col("own") & (F.col("doc") == F.col("class_doc")) & (F.col("row") == F.col("least_row")))).alias("first"),
    )


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """``docs``, all columns, with one row left of each class of near copies."""
    found = near_copies(docs, doc_id, text, params).filter("first")
    firsts = materialize(found.groupBy("doc", "row").agg(F.count("*").alias("n")), "firsts")
    doc, row = free_name(docs, "doc"), free_name(docs, "row")
    left = docs.withColumn(doc, F.coalesce(docs[doc_id].cast("long"), F.lit(NO_ID))).withColumn(
        row, F.xxhash64(F.coalesce(docs[text], F.lit("")))
    )

    def rows(those: DataFrame) -> DataFrame:
        keys = those.select(F.col("doc").alias(doc), F.col("row").alias(row))
        return left.join(keys.hint("shuffle_hash"), [doc, row], "left_semi")

    out = rows(firsts.filter("n = 1"))
    repeated = firsts.filter("n > 1")
    if not repeated.isEmpty():
        out = out.unionByName(rows(repeated).dropDuplicates([doc, row]))
    return out.select(*docs.columns)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents"))
    no_id = F.lit(NO_ID)
    return found.select(
        F.nullif("doc", no_id).alias("doc_id"), F.nullif("class_doc", no_id).alias("class_id"), "n_links", F.col("first").alias("kept")
    )


QUERIES = {"op4_jaccard_join": op4_jaccard_join}
SQL = {
    "op4_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id
  WHERE 5 * shared.n >= 4 * (x.n + y.n - shared.n)
), reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
), classes AS (
  SELECT doc_id, min(other) AS class_id FROM reached GROUP BY doc_id
)
SELECT c.doc_id, c.class_id, (SELECT count(*) FROM links l WHERE l.a = c.doc_id) AS n_links, c.doc_id = c.class_id AS kept
FROM classes c
"""
}
