"""Hard-negative mining by inner product over cover trees, and op11_hard_negatives.

With one more coordinate, sqrt(M * M - |x| * |x|), all candidates have the norm M, and a ball of
radius r around a centre bounds the inner products of a query q with what it covers: they
differ from that of the centre by |q| * r at most. Pivots fitted on a bounded sample deal the
candidates into cells, cells into blocks; a task has one block, builds its cover tree (centres
of a level are further apart than half the radius above them, and cover all their points
within their own radius), and answers its queries best first: nodes whose bounds miss a
query's window, or can't beat its results so far, are skipped, and leaves are verified in
exact integers. A query goes only to cells whose bounds meet its windows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notewright.llm.chosen_path import whole_groups
from notewright.llm.common import bounded_sample, table
from notewright.session import materialize

LONG = (1 << 63) - 1
MIXED = -1


@dataclass(frozen=True)
class MiningParams:
    """``positives`` rows of the same label an anchor, ``negatives`` others for each of them,
    with ``low`` to ``high`` percent of its score. Pivots are fitted on at most
    ``sample_rows`` candidates; a tree holds about ``block`` of them, a task about ``asks``
    queries; nodes of up to ``leaf`` candidates aren't split."""

    positives: int = 5
    negatives: int = 5
    low: int = 80
    high: int = 100
    scale: int = 256
    sample_rows: int = 4096
    pivots: int = 256
    block: int = 2048
    asks: int = 2048
    leaf: int = 8


def whole(packed: list[bytes], scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(floats, integers): floor(scale * x) of rows of float64 bytes. Integers are of 64
    bits where all inner products fit, Python's own where they might not."""
    raw = np.frombuffer(b"".join(packed), np.float64).reshape(len(packed), len(packed[0]) // 8)
    most = float(np.abs(raw).max()) if raw.size else 0.0
    if most < 1e100 and (most * scale + 1) ** 2 * max(1, raw.shape[1]) < 2.0**62:
        exact = np.floor(raw * scale).astype(np.int64)
        return exact.astype(np.float64), exact
    # a double of 2**53 or more is a whole number already
    exact = np.array([[int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in row] for row in raw.tolist()], dtype=object).reshape(raw.shape)
    with np.errstate(over="ignore"):
        return np.floor(raw * scale), exact


def far_centres(points: np.ndarray, first: int, radius: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres, the centre of each point, its distance): the furthest point becomes a centre
    until all are within ``radius`` of one, or there are ``most`` centres."""
    square = (points * points).sum(1)

    def distance(c: int) -> np.ndarray:
        return np.sqrt(np.maximum(square + square[c] - 2 * (points @ points[c]), 0))

    centres, own, near = [first], np.zeros(len(points), np.int64), distance(first)
    near[first] = 0
    while len(centres) < most:
        c = int(near.argmax())
        if not near[c] > radius:
            break
        d = distance(c)
        d[c] = 0
        closer = d < near
        own[closer], near[closer] = len(centres), d[closer]
        centres.append(c)
    return np.array(centres), own, near


class CoverTree:
    """Nodes with a centre (a point), the radius that covers all their points, their label if
    it is one, and children or, in leaves, members. ``points`` are augmented."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, leaf: int):
        self.centre, self.radius, self.label, self.children, self.members = [], [], [], [], []
        todo = [(np.arange(len(points)), 0, -1)]
        while todo:
            some, first, above = todo.pop()
            node = len(self.centre)
            if above >= 0:
                self.children[above].append(node)
            here = points[some]
            reach = float(np.sqrt(((here - here[first]) ** 2).sum(1).max()))
            kinds = labels[some]
            self.centre.append(int(some[first]))
            self.radius.append(reach)
            self.label.append(int(kinds[0]) if (kinds == kinds[0]).all() else MIXED)
            self.children.append([])
            self.members.append(some)
            if len(some) > leaf and np.isfinite(reach):
                centres, own, _ = far_centres(here, first, reach / 2, len(some))
                if len(centres) > 1:
                    by = np.argsort(own, kind="stable")
                    edges = np.searchsorted(own[by], np.arange(len(centres) + 1))
                    for k, c in enumerate(centres.tolist()):
                        inside = by[edges[k] : edges[k + 1]]
                        todo.append((some[inside], int(np.flatnonzero(inside == c)[0]), node))
        self.children = [np.array(c, np.int64) for c in self.children]
        self.centre, self.radius, self.label = np.array(self.centre), np.array(self.radius), np.array(self.label)


def slacks(norms: np.ndarray, radius: np.ndarray, centre_norms: np.ndarray) -> np.ndarray:
    """How far inner products below a node may be from its centre's, rounding included."""
    out = norms[:, None] * radius[None, :] * (1 + 1e-9) + 1 + 1e-9 * norms[:, None] * centre_norms[None, :]
    return np.where(np.isfinite(out), out, np.inf)


def in_range(mid: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower) bounds, as far as scores of 64 bits go; none where floats overflow."""
    upper, lower = np.where(np.isfinite(mid), mid + slack, np.inf), np.where(np.isfinite(mid), mid - slack, -np.inf)
    return np.clip(upper, -float(LONG), float(LONG)), np.clip(lower, -float(LONG), float(LONG))


def descend(tree: CoverTree, upper: np.ndarray, lower: np.ndarray, fits: np.ndarray, verify, window: tuple, k: int) -> list[tuple]:
    """The ``k`` best (score, id known, -id, point) with a score in ``window``, of points that
    ``verify`` gives for a leaf; nodes that ``fits`` rules out by label are skipped."""
    lo, hi = window
    best: list[tuple] = []
    nodes = np.array([0])
    heap: list[tuple] = []

    def push(nodes: np.ndarray) -> None:
        least = max(lo, best[0][0]) if len(best) == k else lo
        nodes = nodes[fits[nodes] & (upper[nodes] >= least) & (lower[nodes] <= hi)]
        if len(nodes):
            nodes = nodes[np.argsort(-upper[nodes], kind="stable")]
            heapq.heappush(heap, (-upper[nodes[0]], int(nodes[0]), 0, nodes))

    push(nodes)
    while heap:
        above, node, at, nodes = heapq.heappop(heap)
        # equal scores are ordered by id, so only a smaller bound ends the search
        if len(best) == k and -above < best[0][0]:
            break
        if at + 1 < len(nodes):
            heapq.heappush(heap, (-upper[nodes[at + 1]], int(nodes[at + 1]), at + 1, nodes))
        if len(tree.children[node]):
            push(tree.children[node])
            continue
        for entry in verify(tree.members[node]):
            if lo <= entry[0] <= hi:
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
    return best


def candidates(vectors: DataFrame, vec_id: str, label: str, column: str) -> DataFrame:
    """(vec_id, label, key, dims, vector) of the rows that take part: neither label nor
    vector null, all components finite. Equal vectors have equal keys."""
    v = F.col(column).cast("array<double>")
    usable = v.isNotNull() & F.col(label).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(vectors[vec_id].cast("long").alias("vec_id"), vectors[label].cast("long").alias("label"), v.alias("v"), usable.alias("u")).filter("u").drop("u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            packed = [(np.array(x, np.float64) + 0.0).tobytes() for x in batch.column(2).to_pylist()]
            columns = [pa.array([xxhash.xxh3_128_digest(x) for x in packed], pa.binary()), pa.array([len(x) // 8 for x in packed], pa.int32()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["vec_id", "label", "key", "dims", "vector"])

    return rows.mapInArrow(run, "vec_id long, label long, key binary, dims int, vector binary")


@dataclass(frozen=True)
class Cells:
    """Pivots, augmented; the largest norm of the candidates; the radius of each cell."""

    pivots: np.ndarray
    norm: float
    radius: np.ndarray

    def near(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each augmented point and its distance to the pivot."""
        far = np.maximum((points**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * points @ self.pivots.T, 0)
        own = far.argmin(1)
        # measured again without cancellation
        return own, np.sqrt(((points - self.pivots[own]) ** 2).sum(1))

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest inner product of each query with what each cell may hold."""
        mid = queries @ self.pivots[:, :-1].T
        slack = slacks(np.sqrt((queries**2).sum(1)), self.radius, np.sqrt((self.pivots**2).sum(1)))
        upper, lower = in_range(mid, slack)
        return lower, upper


def augmented(floats: np.ndarray, norm: float) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        rest = np.sqrt(np.maximum(norm * norm - (floats**2).sum(1), 0))
    return np.concatenate([floats, rest[:, None]], 1)


def dealt(points: DataFrame, asks: DataFrame, params: MiningParams) -> DataFrame:
    """Rows of candidates and queries of one cell, by task: each block of a cell's candidates
    meets each block of its queries. ``asks`` has a row for each query and cell."""
    empty = F.lit(None)
    left = points.select("cell", "vec_id", "label", "key", "vector", empty.cast("long").alias("ask"), empty.cast("array<bigint>").alias("lo"), empty.cast("array<bigint>").alias("hi"))
    right = asks.select("cell", "vec_id", "label", "key", "vector", "ask", "lo", "hi")
    rows = left.withColumn("query", F.lit(False)).unionByName(right.withColumn("query", F.lit(True)))
    sizes = F.broadcast(  # a row a cell, at most params.pivots
        rows.groupBy("cell").agg(
            F.ceil(F.count_if(~F.col("query")) / params.block).cast("int").alias("mine"),
            F.ceil(F.count_if(F.col("query")) / params.asks).cast("int").alias("asked"),
        )
    )
    spread = rows.join(sizes, "cell").filter("mine > 0 AND asked > 0")
    own = F.pmod(F.xxhash64(F.lit(5), "vec_id", "label", "key"), F.when(F.col("query"), F.col("asked")).otherwise(F.col("mine"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("query"), F.col("mine")).otherwise(F.col("asked")) - 1))
    spread = spread.withColumn("own", own).withColumn("other", other)
    task = F.when(F.col("query"), F.xxhash64("cell", "other", "own")).otherwise(F.xxhash64("cell", "own", "other"))
    return (
        spread.select(task.alias("g"), "query", "vec_id", "label", "key", "vector", "ask", "lo", "hi")
        .repartition("g").sortWithinPartitions("g", "query")
    )


def answers(tasks: DataFrame, same: bool, k: int, norm: float, params: MiningParams) -> DataFrame:
    """(ask, window, vec_id, score, self): for each query and window the ``k`` best candidates
    of every block, with the query's label or (not ``same``) with others. ``self`` marks rows
    equal to the query's own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, 0, 1024):
            groups = part.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(groups[1:] != groups[:-1]) + 1, [len(groups)]])
            asks = part.column(1).to_numpy()
            ids, keys = part.column(2).to_pylist(), part.column(4).to_pylist()
            labels, numbers = part.column(3).to_numpy(), part.column(6).to_pylist()
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for start, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                cut = start + int((~asks[start:end]).sum())
                if cut in (start, end):
                    continue
                floats, exact = whole(part.column(5).slice(start, end - start).to_pylist(), params.scale)
                n = cut - start
                points = augmented(floats[:n], norm)
                # labels by their place among the block's, so that any 64-bit label will do
                known, place = np.unique(labels[start:cut], return_inverse=True)
                tree = CoverTree(points, place, params.leaf)
                centres = points[tree.centre]
                lows, highs = (part.column(c).slice(cut, end - cut).to_pylist() for c in (7, 8))
                for a in range(cut, end, 256):
                    b = min(a + 256, end)
                    query = floats[a - start : b - start]
                    with np.errstate(over="ignore", invalid="ignore"):
                        mid = query @ centres[:, :-1].T
                        slack = slacks(np.sqrt((query**2).sum(1)), tree.radius, np.sqrt((centres**2).sum(1)))
                        upper, lower = in_range(mid, slack)
                    for i in range(a, b):
                        where = int(np.searchsorted(known, labels[i]))
                        mine = where if where < len(known) and known[where] == labels[i] else -2
                        fits = (mine >= 0) & ((tree.label == mine) | (tree.label == MIXED)) if same else tree.label != mine
                        vector = exact[i - start]

                        def verify(members: np.ndarray, vector=vector, mine=mine) -> list[tuple]:
                            some = members[(place[members] == mine) == same]
                            scores = (exact[some] @ vector).tolist() if len(some) else []
                            scores = [max(-LONG - 1, min(LONG, s)) for s in scores]
                            return [(s, 0 if ids[start + m] is None else 1, -(ids[start + m] or 0), m) for s, m in zip(scores, some.tolist(), strict=True)]

                        for w, (lo, hi) in enumerate(zip(lows[i - cut], highs[i - cut], strict=True)):
                            ends = (-float("inf") if lo is None else lo, float("inf") if hi is None else hi)
                            for score, _, _, m in descend(tree, upper[i - a], lower[i - a], fits, verify, ends, k):
                                out[0].append(numbers[i])
                                out[1].append(w)
                                out[2].append(ids[start + m])
                                out[3].append(score)
                                out[4].append(same and ids[start + m] == ids[i] and keys[start + m] == keys[i])
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["ask", "window", "vec_id", "score", "self"])

    return tasks.mapInArrow(run, "ask long, window int, vec_id long, score long, self boolean")


def best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` rows of highest score, then smallest id, with their ``rank``; tasks send on no
    more than ``k`` rows each for a group."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine_length(points: DataFrame, anchors: DataFrame, params: MiningParams) -> DataFrame:
    """``hard_negatives`` of vectors of one length."""
    spark = points.sparkSession
    share = spark.sparkContext.broadcast
    scale = params.scale

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                floats, _ = whole(batch.column(0).to_pylist(), scale)
                yield pa.RecordBatch.from_arrays([pa.array(np.sqrt((floats**2).sum(1)), pa.float64())], names=["norm"])

    norm = points.select("vector").mapInArrow(squares, "norm double").agg(F.max("norm")).first()[0] or 0.0
    n = points.count()
    sample = bounded_sample(points.select("key", "vector"), params.sample_rows, "key").collect()
    spots = augmented(whole([bytes(r["vector"]) for r in sorted(sample)], scale)[0], norm)
    centres, _, _ = far_centres(spots, 0, 0.0, max(1, min(params.pivots, -(-n // params.block))))
    placing = share(Cells(spots[centres], norm, np.zeros(len(centres))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = placing.value
        for batch in batches:
            if batch.num_rows:
                own, far = cells.near(augmented(whole(batch.column(3).to_pylist(), scale)[0], cells.norm))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.int32()), pa.array(far, pa.float64())], names=["vec_id", "label", "key", "vector", "cell", "far"])

    schema = "vec_id long, label long, key binary, vector binary, cell int, far double"
    placed = materialize(points.select("vec_id", "label", "key", "vector").mapInArrow(place, schema), "mining-points")
    radius = np.full(len(centres), -np.inf)
    for cell, far in placed.groupBy("cell").agg(F.max("far")).collect():  # a row a pivot
        radius[cell] = np.inf if np.isnan(far) else far * (1 + 1e-9)
    shared = share(Cells(spots[centres], norm, radius))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells in which a query looks: those that its windows meet, but for ``home``, where it
        has looked; or, if ``alone``, the one with the largest bound."""
        cells = shared.value
        for batch in batches:
            if batch.num_rows:
                floats, _ = whole(batch.column(3).to_pylist(), scale)
                with np.errstate(over="ignore", invalid="ignore"):
                    lower, upper = cells.bounds(floats)
                upper = np.where(cells.radius < 0, -np.inf, upper)
                out = []
                for k, (lo, hi, home, alone) in enumerate(zip(*(batch.column(c).to_pylist() for c in (5, 6, 7, 8)), strict=True)):
                    if alone:
                        out.append([int(upper[k].argmax())])
                        continue
                    meets = np.zeros(len(cells.radius), bool)
                    for a, b in zip(lo, hi, strict=True):
                        meets |= (upper[k] >= (-LONG if a is None else a)) & (lower[k] <= (LONG if b is None else b))
                    meets &= cells.radius >= 0
                    if home is not None:
                        meets[home] = False
                    out.append(np.flatnonzero(meets).tolist())
                yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(out, pa.list_(pa.int32()))], names=["ask", "vec_id", "label", "vector", "key", "lo", "hi", "cells"])

    def routed(asks: DataFrame, home: Column, alone: bool) -> DataFrame:
        rows = asks.select("ask", "vec_id", "label", "vector", "key", "lo", "hi", home.cast("int").alias("home"), F.lit(alone).alias("alone"))
        cells = rows.mapInArrow(route, "ask long, vec_id long, label long, vector binary, key binary, lo array<bigint>, hi array<bigint>, cells array<int>")
        return cells.withColumn("cell", F.explode("cells"))

    # the row itself is among its positives until it is taken out, hence one more
    want = params.positives + 1
    open_ = F.array(F.lit(None).cast("long"))
    asked = anchors.withColumn("lo", open_).withColumn("hi", open_)
    home = materialize(routed(asked, F.lit(None), True).drop("cells"), "mining-home")
    near = materialize(best(answers(dealt(placed, home, params), True, want, norm, params), ["ask"], want), "mining-near")
    # no row below the last of these can be among the best
    least = near.filter(F.col("rank") == want).select("ask", F.col("score").alias("least"))
    again = home.drop("lo", "hi").join(least, "ask", "left").withColumn("lo", F.array("least")).withColumn("hi", open_)
    rest = answers(dealt(placed, materialize(routed(again, F.col("cell"), False).drop("cells"), "mining-rest"), params), True, want, norm, params)
    both = best(near.drop("rank").unionByName(rest), ["ask"], want)
    ones = F.row_number().over(Window.partitionBy("ask", "self").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    others = both.withColumn("one", ones).filter(~(F.col("self") & (F.col("one") == 1))).drop("rank", "one")
    positives = materialize(best(others, ["ask"], params.positives).select("ask", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("place")), "mining-positives")

    # a positive score below zero has no negatives: 80 % of it is more than the whole
    scores = positives.filter("positive_score >= 0").groupBy("ask").agg(F.sort_array(F.collect_set("positive_score")).alias("scores"))
    # low and high percent, rounded into the window; in parts that can't overflow
    lo = f"transform(scores, s -> (s div 100) * {params.low} + ((s % 100) * {params.low} + 99) div 100)"
    hi = f"transform(scores, s -> (s div 100) * {params.high} + (s % 100) * {params.high} div 100)"
    windows = scores.select("ask", "scores", F.expr(lo).alias("lo"), F.expr(hi).alias("hi"))
    asks = anchors.join(windows, "ask")
    spread = materialize(routed(asks, F.lit(None), False).drop("cells"), "mining-windows")
    found = answers(dealt(placed, spread, params), False, params.negatives, norm, params)
    negatives = best(found, ["ask", "window"], params.negatives).join(windows.select("ask", "scores"), "ask")
    named = negatives.select(
        "ask", F.element_at("scores", F.col("window") + 1).alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    return positives.join(named, ["ask", "positive_score"]).join(anchors.select("ask", F.col("vec_id").alias("anchor_id")), "ask")


def hard_negatives(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", label: str = "label", column: str = "embedding", params: MiningParams = MiningParams()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows
    in which ``anchor``, a condition on vec_id and label, holds. Scores are inner products
    of floor(scale * x), exact; those beyond 64 bits count as the nearest that fits. An
    anchor's positives are its best other rows of its label, a positive's negatives the best
    rows of other labels within ``low`` to ``high`` percent of its score; equal scores are
    ordered by id, a null id last. Rows with a null label, a null vector or a null or
    non-finite component take no part; vectors of unlike lengths don't meet. Repeated rows
    are rows of their own as positives and negatives; an anchor that is repeated in full is
    answered once. A label with one row has no positives, and an empty table no rows."""
    rows = materialize(candidates(vectors, vec_id, label, column), "mining-rows")
    # of equal vectors with one label no more than these can be asked for: they share their score
    most = max(params.positives + 1, params.negatives)
    order = Window.partitionBy("key", "label").orderBy(F.asc_nulls_last("vec_id"))
    points = materialize(rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n"), "mining-distinct")
    chosen = rows.filter(anchor).dropDuplicates(["vec_id", "label", "key"]).withColumn("ask", F.monotonically_increasing_id())
    chosen = materialize(chosen, "mining-anchors")
    made = None
    # a length of vectors is a kind of table: few, and each has trees of its own
    for length in sorted(r["dims"] for r in chosen.select("dims").distinct().collect()):
        some = mine_length(*(df.filter(F.col("dims") == length).drop("dims") for df in (points, chosen)), params)
        made = some if made is None else made.unionByName(some)
    wanted = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if made is None:
        return vectors.sparkSession.createDataFrame([], wanted)
    return made.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", moved.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


QUERIES = {"op11_hard_negatives": op11_hard_negatives}
SQL = {
    "op11_hard_negatives": """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scores s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5
"""
}
