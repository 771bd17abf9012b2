"""Suffix-array dedup of long repeated byte strings, and op5_suffix_dedup.

A string of ``length`` bytes is dealt out by its anchor, the least-hashed gram in it, so
equal strings meet. The strings of one place with one anchor form a segment; equal segments
are counted before any text moves, and of each only one goes on. Segments of one anchor are
sorted by two-stage suffix sorting: suffixes smaller than their successors directly, the
rest induced by a scan over the buckets; neighbours with a common prefix of ``length``
bytes are repeats. Anchors with very many unlike segments (a passage in very many contexts)
would make one task long: there the digests of strings are counted instead, after tiles of
strings that can't be repeated have been left out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm.chosen_path import whole_groups
from notewright.llm.common import chunks, free_name, prefix_hashes, span_hashes, table, texts
from notewright.llm.line_dedup import identified
from notewright.session import materialize

PLACE_BITS = 24
PIECE = 4 << 20


@dataclass(frozen=True)
class RepeatParams:
    """``gram`` bytes make an anchor; more than ``sorted_segments`` unlike segments of one
    anchor are counted by digests, in tiles of ``tile`` strings."""

    length: int = 400
    gram: int = 64
    sorted_segments: int = 256
    tile: int = 16


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` neighbours, from running minima within blocks."""
    n = len(keys) - width + 1
    whole = np.full(-(-len(keys) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    whole[: len(keys)] = keys
    blocks = whole.reshape(-1, width)
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    before = np.minimum.accumulate(blocks, 1).ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def segments(items: list[bytes], params: RepeatParams) -> tuple[np.ndarray, ...]:
    """(text, start, strings, anchor's place from the start, anchor hash, digest) of every
    run of strings with one anchor. Ties between equal grams go to the first, so equal
    strings have the same anchor in the same place."""
    data = np.frombuffer(b"".join(items), np.uint8)
    if len(data) < params.length:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    prefix = prefix_hashes(data)
    at = np.arange(len(data) - params.gram + 1)
    grams = span_hashes(prefix, at, at + params.gram)
    low = np.uint64((1 << PLACE_BITS) - 1)
    least = sliding_least((grams & ~low) | at.astype(np.uint64), params.length - params.gram + 1)
    anchor = (least & low).astype(np.int64)
    begins = np.cumsum([0, *map(len, items)])
    starts = np.arange(len(anchor))
    owner = np.searchsorted(begins, starts, "right") - 1
    inside = starts + params.length <= begins[owner + 1]
    starts, owner, anchor = starts[inside], owner[inside], anchor[inside]
    if not len(starts):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.concatenate([first, [len(starts)]]))
    begin = starts[first]
    digest = span_hashes(prefix, begin, begin + count - 1 + params.length)
    place = anchor[first]
    return owner[first], begin - begins[owner[first]], count, place - begin, grams[place], digest


def all_segments(docs: DataFrame, doc_id: str, text: str, params: RepeatParams) -> DataFrame:
    schema = "doc long, row long, start long, n int, at int, h long, d long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces, owner, offset = [], [], []
            for i, item in enumerate(texts(batch.column(2))):
                for o in range(0, max(1, len(item) - params.length + 1), PIECE):
                    pieces.append(item[o : o + PIECE + params.length - 1])
                    owner.append(i)
                    offset.append(o)
            owner, offset = np.array(owner, np.int64), np.array(offset, np.int64)
            for a, b in chunks(pieces):
                which, start, n, at, h, d = segments(pieces[a:b], params)
                own = pa.array(owner[a:b][which])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(own), batch.column(1).take(own), pa.array(start + offset[a:b][which]),
                        pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32)),
                        pa.array(h.astype(np.uint64).view(np.int64)), pa.array(d.astype(np.uint64).view(np.int64)),
                    ],
                    names=["doc", "row", "start", "n", "at", "h", "d"],
                )

    return docs.select(*identified(docs, doc_id, text), docs[text].cast("binary").alias("bytes")).mapInArrow(run, schema)


def suffix_order(text: bytes, wanted: list[tuple[int, int]], depth: int) -> list[int]:
    """Suffixes that begin in the ranges ``wanted``, each of which ends with one smaller
    than its successor; those with the same first ``depth`` bytes stand together."""
    data = np.frombuffer(text, np.uint8).astype(np.int16)
    step = np.diff(data)
    changes = np.flatnonzero(step)
    # a suffix is smaller than its successor if the next unlike byte is larger
    nearest = np.minimum(np.searchsorted(changes, np.arange(len(step))), len(changes) - 1)
    smaller = np.concatenate([step[changes[nearest]] > 0, [False]]).tolist()
    induced: list[list[int]] = [[] for _ in range(256)]
    direct: list[list[int]] = [[] for _ in range(256)]
    larger = bytearray(len(text) + 1)  # suffixes to be induced; the one before the first is none
    for start, end in wanted:
        for i in range(start, end):
            if smaller[i]:
                direct[text[i]].append(i)
            else:
                larger[i] = 1
    out: list[int] = []
    for c in range(256):
        own = induced[c]
        for i in own:  # grows while it is read: equal bytes induce into their own bucket
            if larger[i - 1]:
                induced[text[i - 1]].append(i - 1)
        out += own
        own = direct[c]
        own.sort(key=lambda i: text[i : i + depth])
        for i in own:
            if larger[i - 1]:
                induced[text[i - 1]].append(i - 1)
        out += own
    return out


def repeated(parts: list[bytes], length: int) -> list[list[int]]:
    """For each text the starts of strings of ``length`` bytes that start elsewhere too."""
    text = b"\xff".join(parts) + b"\xff"  # a byte that UTF-8 doesn't have, above all others
    begins = np.cumsum([0, *(len(p) + 1 for p in parts)])[:-1].tolist()
    data = np.frombuffer(text, np.uint8).astype(np.int16)
    rises = np.flatnonzero(np.diff(data) > 0)  # each is a suffix smaller than its successor
    wanted, strings = [], []
    for b, p in zip(begins, parts, strict=True):
        n = len(p) - length + 1
        strings.append(n)
        wanted.append((b, int(rises[np.searchsorted(rises, b + n - 1)]) + 1))
    order = suffix_order(text, wanted, length)
    is_string = np.zeros(len(text), bool)
    for b, n in zip(begins, strings, strict=True):
        is_string[b : b + n] = True
    at = np.array(order)
    at = at[is_string[at]].tolist()
    again = bytearray(len(text))
    before = None
    for i in at:
        now = text[i : i + length]
        if now == before:
            again[i] = again[last] = 1
        before, last = now, i
    marks = np.frombuffer(again, np.uint8)
    return [np.flatnonzero(marks[b : b + n]).tolist() for b, n in zip(begins, strings, strict=True)]


def spans(places: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers as (first, last)."""
    if not places:
        return []
    at = np.array(places)
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.concatenate([[0], cut + 1])].tolist(), at[np.concatenate([cut, [len(at) - 1]])].tolist(), strict=True))


def by_suffixes(bodies: DataFrame, params: RepeatParams) -> DataFrame:
    """(h, d, lo, hi): runs of repeated strings in segments (h, d, at, bytes)."""
    ordered = bodies.select("h", "d", "bytes").repartition("h").sortWithinPartitions("h", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_groups(batches, 0, 128):
            h, d = part.column(0).to_pylist(), part.column(1).to_pylist()
            items = part.column(2).to_pylist()
            at = [i for i in range(len(h)) if i == 0 or (h[i], d[i]) != (h[i - 1], d[i - 1])]  # rows with one id and text
            out = [(h[i], d[i], lo, hi) for i, found in zip(at, repeated([items[i] for i in at], params.length), strict=True) for lo, hi in spans(found)]
            if out:
                a, b, c, e = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a), pa.array(b), pa.array(c, pa.int32()), pa.array(e, pa.int32())], names=["h", "d", "lo", "hi"]
                )

    return ordered.mapInArrow(run, "h long, d long, lo int, hi int")


def by_digests(bodies: DataFrame, params: RepeatParams) -> DataFrame:
    """The same for segments of anchors with very many of them. Strings that start near one
    another, counted from the anchor, are a tile: its core is in all of them, so a core
    that is unique rules the tile out, and a whole that is not covers it. Only strings of
    the tiles left are counted one by one."""
    tile, length = params.tile, params.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for h, d, at, item in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                prefix = prefix_hashes(np.frombuffer(item, np.uint8))
                n = len(item) - length + 1
                starts = np.arange(n)
                digests = span_hashes(prefix, starts, starts + length).view(np.int64)
                number = (starts - at) // tile
                for t in np.unique(number).tolist():
                    lo, hi = t * tile + at, t * tile + at + tile - 1  # of the whole tile, maybe beyond the segment
                    a, b = max(lo, 0), min(hi, n - 1)
                    core = span_hashes(prefix, np.array([hi]), np.array([lo + length])).view(np.int64)[0]
                    whole = span_hashes(prefix, np.array([lo]), np.array([hi + length])).view(np.int64)[0] if (a, b) == (lo, hi) else None
                    out.append((h, d, t, int(core), None if whole is None else int(whole), a, b, digests[a : b + 1].tolist()))
            columns = list(zip(*out, strict=True)) or [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "d", "t", "core", "whole", "lo", "hi", "digests"]
            )

    tiles = materialize(
        bodies.select("h", "d", "at", "bytes").dropDuplicates(["h", "d"])
        .mapInArrow(run, "h long, d long, t int, core long, whole long, lo int, hi int, digests array<long>"),
        "tiles",
    )
    cores = tiles.groupBy("h", "t", "core").agg(F.count("*").alias("cores")).filter("cores > 1")
    wholes = tiles.filter("whole is not null").groupBy("h", "t", "whole").agg(F.count("*").alias("wholes"), F.min("d").alias("one")).filter("wholes > 1")
    likely = tiles.join(cores, ["h", "t", "core"]).join(wholes, ["h", "t", "whole"], "left")
    likely = materialize(likely.select("h", "d", "lo", "hi", "digests", "one"), "likely-tiles")
    covered = likely.filter("one is not null").select("h", "d", "lo", "hi")
    # of tiles that are repeated whole, one stands for the others against strings of the rest
    singles = likely.filter("one is null or one = d").select("h", "d", "lo", F.posexplode("digests").alias("k", "digest"))
    often = singles.groupBy("h", "digest").agg(F.count("*").alias("n")).filter("n > 1")
    found = singles.join(often, ["h", "digest"]).select("h", "d", (F.col("lo") + F.col("k")).alias("lo"), (F.col("lo") + F.col("k")).alias("hi"))
    return covered.union(found)


def bodies_of(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """(h, d, at, nd, bytes) of one place for each wanted (h, d): one pass over the texts."""
    places = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("h", "d", "start", "n", "at", "nd")).alias("places"))
    rows = docs.select(*identified(docs, doc_id, text), docs[text].cast("binary").alias("bytes")).join(
        places.hint("shuffle_hash"), ["doc", "row"]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (p["h"], p["d"], p["at"], p["nd"], item[p["start"] : p["start"] + p["n"] - 1 + length])
                for item, places in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True)
                for p in places
            ]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["h", "d", "at", "nd", "bytes"]
            )

    return rows.select("bytes", "places").mapInArrow(run, "h long, d long, at int, nd long, bytes binary")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", params: RepeatParams = RepeatParams()) -> DataFrame:
    """(doc, row, spans): for each document row with repeats, the byte ranges (start, end)
    of strings of ``length`` bytes that also start anywhere else, in its own text as well;
    ranges may overlap and are in no order. ``doc`` is the id (-2**63 for null), ``row``
    the text's hash. Repeated rows repeat each other's bytes. Null, empty and short texts
    have none."""
    places = materialize(all_segments(docs, doc_id, text, params), "segments")
    counted = materialize(places.groupBy("h", "d").agg(F.count("*").alias("c")), "segment-counts")
    anchors = counted.groupBy("h").agg(F.sum("c").alias("total"), F.count("*").alias("nd")).filter("total > 1")
    again = materialize(places.join(counted.join(anchors, "h").select("h", "d", "c", "nd"), ["h", "d"]), "repeated-segments")
    least = F.min(F.struct("doc", "row", "start", "n", "at", "nd")).alias("one")
    wanted = again.filter("nd > 1").groupBy("h", "d").agg(least).select("h", "d", "one.*")
    bodies = materialize(bodies_of(docs, wanted, doc_id, text, params.length), "segment-bodies")
    few = F.col("nd") <= params.sorted_segments
    found = by_suffixes(bodies.filter(few), params)
    if not bodies.filter(~few).isEmpty():
        found = found.union(by_digests(bodies.filter(~few), params))
    parts = again.join(found, ["h", "d"]).select("doc", "row", F.struct((F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi") + params.length).alias("end")).alias("span"))
    whole = again.filter("c > 1").select("doc", "row", F.struct("start", (F.col("start") + F.col("n") - 1 + params.length).alias("end")).alias("span"))
    return whole.union(parts).groupBy("doc", "row").agg(F.collect_list("span").alias("spans"))


def merged(found: list[dict] | None) -> list[tuple[int, int]]:
    """Disjoint ranges in order; ranges that touch are one."""
    out: list[list[int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in found or []):
        if out and start <= out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def rest(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in ranges)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(s for s, _ in ranges), len(text)], strict=True))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeated_spans(docs)
    doc, row = free_name(docs, "doc"), free_name(docs, "row")
    rows = docs.select("doc_id", docs["text"].cast("binary").alias("bytes"), *identified(docs, "doc_id", "text"))
    joined = rows.join(found.hint("shuffle_hash"), [doc, row], "left").select("doc_id", "bytes", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, ranges in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                ranges = merged(ranges)
                kept = rest(item, ranges)
                out.append((len(item), len(item) - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, (*[pa.int64()] * 3, pa.string()), strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
SQL: dict[str, str] = {}
