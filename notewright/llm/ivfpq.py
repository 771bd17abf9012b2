"""Embedding near-dedup by product quantisation, and op9_embedding_dedup.

A bounded sample gives coarse centroids and codebooks of residual subspaces. Every vector
is a member of its nearest inverted list and a query to several; distances are to what the
codes stand for, by one matrix product a block, and pairs near the threshold are measured again
on the whole vectors. A task has one block of a list and one block of its queries. It writes a
number of links and a local root for each vector, never pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.llm.chosen_path import bounds, roots_of, whole_groups
from notewright.llm.common import bounded_sample, table
from notewright.llm.components import components
from notewright.session import materialize


MARGIN = 1e-4  # by which estimates may differ between ways of adding them up


@dataclass(frozen=True)
class PqParams:
    """``sample_rows`` bounds the vectors that the index is fitted on; ``probes`` lists are
    searched for each vector; distances to codes may err by ``slack`` before a pair is
    passed over; ``block`` rows a side are compared by one task, four times as many of a side with more
    than four blocks, as each block of a side is sent to every block of the other."""

    cosine: float = 0.9
    lists: int = 64
    probes: int = 12
    subspaces: int = 16
    codes: int = 64
    slack: float = 0.12
    sample_rows: int = 10_000
    block: int = 2048
    seed: int = 3


def kmeans(points: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """Centroids by Lloyd's rounds; as many as there are distinct points, at most k."""
    points = np.unique(points, axis=0)
    rng = np.random.default_rng(seed)
    centres = points[rng.permutation(len(points))[:k]].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        n = np.bincount(near, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (points @ centres.T - (centres**2).sum(1) / 2).argmax(1)


@dataclass(frozen=True)
class Index:
    coarse: np.ndarray
    books: np.ndarray  # subspace, code, part of the dimensions

    @staticmethod
    def fit(vectors: np.ndarray, params: PqParams) -> Index:
        """From unit vectors, padded with zeros to a multiple of the subspaces."""
        coarse = kmeans(vectors, params.lists, params.seed)
        rest = vectors - coarse[nearest(vectors, coarse)]
        parts = np.split(rest, params.subspaces, axis=1)
        books = [kmeans(p, params.codes, params.seed + i) for i, p in enumerate(parts)]
        most = max(len(b) for b in books)
        return Index(coarse, np.stack([np.concatenate([b, np.repeat(b[:1], most - len(b), 0)]) for b in books]))

    def codes(self, vectors: np.ndarray, lists: np.ndarray) -> np.ndarray:
        parts = np.split(vectors - self.coarse[lists], len(self.books), axis=1)
        return np.stack([nearest(p, b) for p, b in zip(parts, self.books, strict=True)], 1).astype(np.uint8)

    def probes(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The lists nearest to each vector, its own first."""
        far = (self.coarse**2).sum(1) / 2 - vectors @ self.coarse.T
        return np.argsort(far, 1, kind="stable")[:, :n]

    def decoded(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes stand for, row by row."""
        parts = [book[code] for book, code in zip(self.books, codes.T, strict=True)]
        return self.coarse[lists] + np.concatenate(parts, 1)


def fixed(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Binary values of one length, as rows of ``width`` numbers."""
    column = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).cast(pa.large_binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, width)


def unit(column: pa.Array, dims: int, padded: int) -> np.ndarray:
    """Rows of float64 bytes as unit vectors of float32."""
    raw = fixed(column, np.float64, dims)
    scaled = raw / np.abs(raw).max(1, keepdims=True)
    return np.pad(scaled / np.linalg.norm(scaled, axis=1, keepdims=True), ((0, 0), (0, padded - dims))).astype(np.float32)


def distinct_vectors(vectors: DataFrame, vec_id: str, column: str) -> tuple[DataFrame, DataFrame]:
    """(vec_id, key) of every row, key null where the vector can link with nothing; and
    (key, first, copies, dims, vector) of the distinct vectors."""
    v = F.col(column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(usable, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            packed = [None if x is None else np.array(x, np.float64).tobytes() for x in batch.column(1).to_pylist()]
            keys = [None if x is None else xxhash.xxh3_128_digest(x) for x in packed]
            dims = [None if x is None else len(x) // 8 for x in packed]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(packed, pa.binary())],
                names=["vec_id", "key", "dims", "vector"],
            )

    packed = materialize(rows.mapInArrow(run, "vec_id long, key binary, dims int, vector binary"), "vectors")
    one = packed.filter(F.col("key").isNotNull()).groupBy("key").agg(
        F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("dims").alias("dims"), F.first("vector").alias("vector")
    )
    return packed.select("vec_id", "key"), one


def blocks(n: Column, block: int) -> Column:
    """Into how many blocks a side of ``n`` rows is dealt. Every block of a side is sent to every block
    of the other, so a long side has wider ones."""
    return F.ceil(n / F.when(n > 4 * block, 4 * block).otherwise(block)).cast("int")


def link_counts(one: DataFrame, dims: int, params: PqParams) -> DataFrame:
    """(key, links, root), several rows a key, for distinct vectors of one length."""
    spark = one.sparkSession
    padded = -(-dims // params.subspaces) * params.subspaces
    sample = bounded_sample(one.select("key", "vector"), params.sample_rows, "key").collect()
    fitted = Index.fit(unit(pa.array([bytes(r["vector"]) for r in sample], pa.binary()), dims, padded).astype(np.float64), params)
    shared = spark.sparkContext.broadcast(fitted)
    schema = "key binary, copies long, vector binary, codes binary, lists array<int>"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            if batch.num_rows:
                points = unit(batch.column(2), dims, padded)
                lists = index.probes(points, params.probes)
                codes = index.codes(points, lists[:, 0])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(lists.tolist(), pa.list_(pa.int32()))],
                    names=["key", "copies", "vector", "codes", "lists"],
                )

    placed = materialize(one.select("key", "copies", "vector").mapInArrow(assign, schema), "lists")
    members = placed.withColumn("list", F.col("lists")[0]).withColumn("query", F.lit(False))
    queries = placed.withColumn("list", F.explode("lists")).withColumn("query", F.lit(True))
    rows = members.unionByName(queries)
    # one row a list at most
    sizes = F.broadcast(
        rows.groupBy("list").agg(
            blocks(F.count_if(~F.col("query")), params.block).alias("mine"),
            blocks(F.count_if(F.col("query")), params.block).alias("asked"),
        )
    )
    spread = rows.join(sizes, "list").filter("mine > 0 and asked > 0")
    own = F.pmod(F.xxhash64(F.lit(9), "key"), F.when(F.col("query"), F.col("asked")).otherwise(F.col("mine"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("mine")).otherwise(F.col("asked")) - 1))
    dealt = spread.withColumn("own", own).withColumn("other", other)
    task = F.when(F.col("query"), F.xxhash64("list", "own", "other")).otherwise(F.xxhash64("list", "other", "own"))
    ordered = (
        dealt.select(task.alias("g"), "query", "list", "key", "copies", "vector", "codes", "lists")
        .repartition("g").sortWithinPartitions("g", "query")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, least = shared.value, params.cosine - params.slack
        for part in whole_groups(batches, 0, 1024):
            edges = bounds(part.column(0).to_numpy())
            asks = part.column(1).to_numpy()
            which = part.column(2).to_numpy()
            keys = fixed(part.column(3), np.uint64, 2).byteswap()
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            # numbers in the order of the keys, one for equal keys
            number = np.empty(len(keys), np.int64)
            number[order] = np.cumsum(np.concatenate([[False], (keys[order[1:]] != keys[order[:-1]]).any(1)]))
            copies = part.column(4).to_numpy()
            points = unit(part.column(5), dims, padded)
            raw = fixed(part.column(5), np.float64, dims)
            raw = raw / np.abs(raw).max(1, keepdims=True)
            norms = np.sqrt((raw * raw).sum(1))
            codes = fixed(part.column(6), np.uint8, params.subspaces)
            lists = part.column(7).combine_chunks().flatten().to_numpy().reshape(len(asks), -1)
            out: list[tuple] = []
            for start, end in zip(edges[:-1], edges[1:], strict=True):
                cut = start + int((~asks[start:end]).sum())
                if cut in (start, end):
                    continue
                here = int(which[start])
                stand = index.decoded(np.full(cut - start, here), codes[start:cut]).astype(np.float32).T
                left, right = [], []
                for q in range(cut, end, 256):
                    guess = points[q : min(q + 256, end)] @ stand
                    i, j = np.divmod(np.flatnonzero(guess >= least - MARGIN), cut - start)
                    i, j = i + q, j + start
                    for some in np.array_split(np.arange(len(i)), max(1, len(i) // 20_000)):
                        a, b = i[some], j[some]
                        exact = (raw[a] * raw[b]).sum(1) / (norms[a] * norms[b])
                        a, b = a[exact >= params.cosine], b[exact >= params.cosine]
                        if not len(a):
                            continue
                        # as each side of the pair would estimate the other, the same in any task
                        homes = lists[a, 0]
                        there = (points[a] * index.decoded(np.full(len(b), here), codes[b])).sum(1) >= least
                        back = (points[b] * index.decoded(homes, codes[a])).sum(1) >= least
                        # a pair that is found in two ways is counted in one of them
                        first = np.where(homes == here, number[a] < number[b], here < homes)
                        mutual = back & (lists[b] == homes[:, None]).any(1)
                        taken = there & (number[a] != number[b]) & (first | ~mutual)
                        left.append(a[taken] - start)
                        right.append(b[taken] - start)
                a, b = (np.concatenate([np.zeros(0, np.int64), *side]) for side in (left, right))
                if len(a):
                    links = np.zeros(end - start, np.int64)
                    np.add.at(links, a, copies[start:end][b])
                    np.add.at(links, b, copies[start:end][a])
                    linked = np.flatnonzero(links)
                    out.append((start + linked, links[linked], start + roots_of(end - start, a, b)[linked]))
            at, links, root = (np.concatenate([np.zeros(0, np.int64), *of]) for of in (zip(*out, strict=True) if out else ((), (), ())))
            named = part.column(3).combine_chunks().cast(pa.binary())
            yield pa.RecordBatch.from_arrays([named.take(pa.array(at)), pa.array(links), named.take(pa.array(root))], names=["key", "links", "root"])

    return ordered.mapInArrow(compare, "key binary, links long, root binary")


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", column: str = "embedding", params: PqParams = PqParams()) -> DataFrame:
    """One row a vector row: vec_id, n_links, component_id, kept. Links have a cosine of
    ``params.cosine`` or more in double precision, always measured; which of them are found
    is the index's recall. Copies are counted one by one. Vectors that are null, empty,
    zero or hold null or non-finite values link with nothing; vectors of unlike lengths
    don't link with each other. Rows with a null id count for others, and have a null
    component where no row of it has an id; rows that share an id are vectors of their own."""
    rows, distinct = distinct_vectors(vectors, vec_id, column)
    one = materialize(distinct, "distinct-vectors")
    found = None
    # a length of vectors is a kind of table: few, and each has an index of its own
    for length in sorted(r["dims"] for r in one.select("dims").distinct().collect()):
        some = link_counts(one.filter(F.col("dims") == length), length, params)
        found = some if found is None else found.union(some)
    if found is None:
        empty = T.StructType.fromDDL("key binary, links long, root binary")
        found = vectors.sparkSession.createDataFrame([], empty)
    links = materialize(found, "vector-links")
    classes = components(links.select("key", "root"), "vector-classes").withColumnRenamed("id", "key")
    counted = links.groupBy("key").agg(F.sum("links").alias("links"))
    known = materialize(
        one.select("key", "first", "copies").join(counted, "key", "left").join(classes, "key", "left").select(
            "key", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "key").alias("root")
        ),
        "vectors-known",
    )
    least = known.groupBy("root").agg(F.min("first").alias("component_id"))
    of_keys = known.join(least, "root").select("key", "n_links", "component_id")
    return rows.join(of_keys, "key", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("key").isNull(), F.lit(True)).otherwise(F.col("vec_id").eqNullSafe(F.col("component_id"))).alias("kept"),
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op9_embedding_dedup": op9_embedding_dedup}
SQL: dict[str, str] = {}
