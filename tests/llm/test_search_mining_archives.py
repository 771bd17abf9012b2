"""Ranked search, hard negatives and WARC archives against brute force and on odd rows."""

import gzip
import hashlib
import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.llm import covertree, fptree, warc
from notewright.llm.covertree import CoverTree, MiningParams, hard_negatives
from notewright.llm.fptree import SearchParams, Tree, ranked
from notewright.llm.warc import Decoder, WarcParams, assemble, chunked, read_records, record, resolve, write_warc

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("module", [covertree, warc, fptree])
def test_sql(spark, module):
    con = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in module.SQL.items():
        answer = con.execute(sql)
        columns = [c[0] for c in answer.description]
        wanted = sorted(map(repr, answer.fetchall()))
        assert wanted and sorted(repr(tuple(r[c] for c in columns)) for r in module.QUERIES[name](spark, SF).collect()) == wanted


# --- ranked search ---------------------------------------------------------------------


def words(text):
    text = (text or "").encode()
    return re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in text))


def ranked_plainly(docs, items, top):
    held = [(doc_id, words(text)) for doc_id, text in docs]
    held = [(i, w, Counter(w)) for i, w in held if w]
    n, length = len(held), sum(len(w) for _, w, _ in held)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, w, tf in held:
            m = 75 + 25 * len(w) * n // length
            score = 0
            for term in words(text):
                df = sum(term in c for _, _, c in held)
                if tf[term]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (1_000_000_000 * tf[term] // (1000 * tf[term] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if null else doc, -score) for rank, (score, null, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def search_rows(seed=3, n=300):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "漢字", "A1", "x_y", "don't"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda k: " ".join(draw.choices(vocabulary, weights, k=k))
    docs = [(i, text(draw.randrange(1, 30))) for i in range(n)]
    copy = text(12)
    docs += [(1000 + i, copy) for i in range(60)] + [(5, copy), (5, copy), (None, copy), (7, None), (8, ""), (9, " .,! "), (10, "w1 " * 3000)]
    items = [(i, text(draw.randrange(1, 12))) for i in range(12)] + [(3, copy), (3, copy), (50, None), (51, ""), (52, "absent words"), (None, "w0 W0 w30")]
    return docs, items


@pytest.mark.parametrize("params", [SearchParams(top=7, block_pairs=60, leaf=2), SearchParams(top=7, leaf=5, item_bytes=300), SearchParams(top=3)])
def test_ranked(spark, params):
    docs, items = search_rows()
    left = spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in docs], "doc_id long, text string, Rank int, item string, score double").repartition(5)
    right = spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id long, text string, doc_id int, block int")
    got = ranked(left, right, params=params)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == ranked_plainly(docs, items, params.top)


def test_ranked_empty(spark):
    docs, items = search_rows(n=3)
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    schema = ranked(left, right).schema.simpleString()
    for a, b in ((left.limit(0), right), (left, right.limit(0)), (left.filter("text = ''"), right), (left, right.filter("text = ''"))):
        none = ranked(a, b)
        assert none.count() == 0 and none.schema.simpleString() == schema


def test_tree_bounds_hold_and_skip(spark):
    """No document scores more than the bounds of the nodes above it, and few leaves are read."""
    draw = np.random.default_rng(5)
    n, terms = 600, 50
    lists = [np.sort(draw.choice(terms, draw.integers(1, 12), replace=False, p=1 / np.arange(1, 51) / (1 / np.arange(1, 51)).sum())) for _ in range(n)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    order, tf = np.concatenate(lists), draw.integers(1, 6, first[-1])
    m = draw.integers(75, 300, n)
    tree = Tree(np.arange(n), np.zeros(n, bool), m, first, order, tf, 4)
    looked = 0
    for _ in range(20):
        item = [(int(t), int(draw.integers(100, 9000))) for t in draw.choice(terms, 4, replace=False)]
        bound, weights = tree.bounds(item), np.zeros(terms, np.int64)
        for t, w in item:
            weights[t] = w
        plain = sorted(
            ((sum(int(weights[t]) * (10**9 * int(f) // (1000 * int(f) + 12 * int(m[d]))) for t, f in zip(lists[d], tf[first[d] : first[d + 1]])), -d) for d in range(n)),
            reverse=True,
        )
        best: list = []
        looked += tree.search(item, weights, best, 5)
        assert [(s, i) for s, _, i in sorted(best, reverse=True)] == [p for p in plain[:5] if p[0] > 0]
        scores = dict((-d, s) for s, d in plain)
        for node, (start, end) in enumerate(zip(tree.start, tree.end)):
            assert bound[node] >= max(scores[int(i)] for i in tree.ids[start:end])
    assert looked < 20 * sum(not c for c in tree.children) / 2


# --- hard negatives --------------------------------------------------------------------


def mined_plainly(rows, anchor, p=5, n=5):
    kept = []
    for vec_id, label, vector in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, label, [math.floor(256 * x) for x in vector]))
    clip = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    place = lambda v: (v is None, v or 0)
    out, seen = [], set()
    for i, (a, label, v) in enumerate(kept):
        if not anchor(a) or (a, label, tuple(v)) in seen:
            continue
        seen.add((a, label, tuple(v)))
        scored = [(clip(sum(x * y for x, y in zip(v, w))), b, other) for j, (b, other, w) in enumerate(kept) if j != i and len(w) == len(v)]
        positives = sorted(((-s, place(b), b) for s, b, other in scored if other == label))[:p]
        for s, _, b in positives:
            fit = sorted((-t, place(c), c) for t, c, other in scored if other != label and 80 * -s <= 100 * t <= 100 * -s)[:n]
            out += [(a, b, rank, c, -s, -t) for rank, (t, _, c) in enumerate(fit, 1)]
    return sorted(out, key=repr)


def vector_rows(n=260):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(9, 6))
    rows = [(i, int(draw.integers(0, 4)), (centres[draw.integers(0, 9)] + draw.normal(size=6) / 4).tolist()) for i in range(n)]
    same = [0.5, -0.25, 0.125, 1.0, 0.0, 2.0]
    rows += [(1000 + i, i % 3, same) for i in range(70)]
    rows += [(20, 1, same), (20, 1, same), (20, 1, same), (None, 2, same), (None, 1, same), (2000, 1, [0.0] * 6), (2010, 1, [-0.0] * 6)]
    rows += [(2020, None, same), (2030, 1, None), (2040, 1, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2050, 1, [float("nan")] * 6), (2060, 1, [float("inf")] + [0.0] * 5)]
    rows += [(3000, 1, [1.0, 2.0]), (3010, 2, [1.0, 1.9]), (3020, 1, [1.1, 2.0]), (3030, 2, []), (3040, 2, []), (3050, 1, [])]
    return rows


MINING = "vec_id long, label int, embedding array<double>, cell int, ask string, key double"


@pytest.mark.parametrize("params", [MiningParams(block=16, asks=5, pivots=6, sample_rows=40, leaf=2), MiningParams()])
def test_hard_negatives(spark, params):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], MINING).repartition(4)
    got = hard_negatives(df, F.col("vec_id") % 10 == 0, params=params).collect()
    assert sorted((tuple(r) for r in got), key=repr) == mined_plainly(rows, lambda i: i is not None and i % 10 == 0)


def test_hard_negatives_of_huge_values(spark):
    rows = [(i, i % 2, [x * 10.0**p for x in (1.0, -2.5 + i / 8, 0.3 * i)]) for p in (3, 12, 30, 200) for i in range(p, p + 12)]
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in rows], MINING)
    got = hard_negatives(df, F.col("vec_id") % 2 == 0, params=MiningParams(leaf=2)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == mined_plainly(rows, lambda i: i % 2 == 0)


def test_hard_negatives_empty(spark):
    df = spark.createDataFrame([(*r, 1, "x", 2.0) for r in vector_rows(5)], MINING)
    schema = hard_negatives(df, F.col("vec_id") % 10 == 0).schema.simpleString()
    for none in (df.limit(0), df.filter("label IS NULL"), df.filter("vec_id = 1")):
        got = hard_negatives(none, F.col("vec_id") % 10 == 0)
        assert got.count() == 0 and got.schema.simpleString() == schema


def test_cover_tree():
    points = np.random.default_rng(4).normal(size=(300, 3))
    points = np.concatenate([points, np.repeat(points[:1], 40, 0)])
    tree = CoverTree(points, np.zeros(len(points), np.int64), 4)
    leaves = [m for m, c in zip(tree.members, tree.children) if not len(c)]
    assert sorted(np.concatenate(leaves).tolist()) == list(range(len(points)))
    for node, kids in enumerate(tree.children):
        assert np.linalg.norm(points[tree.members[node]] - points[tree.centre[node]], axis=1).max() <= tree.radius[node] + 1e-9
        centres = points[tree.centre[kids]]
        gaps = np.linalg.norm(centres[:, None] - centres[None], axis=2) + np.eye(len(kids)) * 1e9
        assert len(kids) == 0 or gaps.min() > tree.radius[node] / 2 - 1e-6


# --- archives --------------------------------------------------------------------------

SMALL = WarcParams(segment_bytes=90, chunk_bytes=17, revisit_bytes=30)


def page_rows():
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n0\r\n\r\n" * 3
    long = "é漢字 <p>\r\n" * 400
    rows = [(1, "http://a/1", "short"), (2, "http://a/2", long), (3, None, long), (4, "http://a b/\r\nX: y", tricky), (5, "u", tricky), (6, "u", "")]
    rows += [(7, "u", None), (None, "u", long), (None, None, None), (8, "u", "x" * 30), (9, "u", "x" * 30), (9, "u", "x" * 30), (10, "u", "x" * 29), (11, "u", "x" * 29)]
    return rows + [(100 + i, "u", "copy " * 50) for i in range(40)] + [(12, "u", "\r\n\r\n"), (13, "u", "0")]


def archived(spark, rows, folder, params=SMALL):
    schema = "page_id long, url string, html string, key string, first int, row int, record string"
    pages = spark.createDataFrame([(*r, "k", 1, 2, "r") for r in rows], schema).repartition(3)
    write_warc(pages, folder, params=params)
    return folder


def test_archives_round_trip(spark, tmp_path):
    rows = page_rows()
    folder = archived(spark, rows, str(tmp_path / "w"))
    records = read_records(spark, folder)
    assert records.filter("problem IS NOT NULL").count() == 0 and records.filter("type = 'continuation'").count() > 50
    captures = assemble(records.repartition(7)).collect()
    assert len(captures) == len(rows) and not [c for c in captures if c["problem"]]
    bodies = Counter((c["page_id"], bytes(c["payload"])) for c in captures if c["type"] == "response")
    text = lambda r: (r[2] or "").encode()
    for page, body in bodies:
        assert any(str(r[0]) == page or r[0] is None and page is None for r in rows if text(r) == body)
    shared: dict = {}
    for r in rows:
        shared.setdefault(text(r), []).append(r[0])
    for body, ids in shared.items():
        n = sum(k for (page, b), k in bodies.items() if b == body)
        assert n == (len(ids) if len(body) < 30 else 1)
        if len(body) >= 30:
            top = max((i for i in ids if i is not None), default=None)
            assert (None if top is None else str(top), body) in bodies
    told = resolve(assemble(records, payloads=False)).collect()
    for r in told:
        assert r["problem"] is None
        body = [b for b in shared if hashlib.sha1(b).hexdigest() == r["payload_digest"] and len(b) == r["payload_bytes"]]
        assert len(body) == 1 and (int(r["page_id"]) if r["page_id"] else None) in shared[body[0]]
        if r["type"] == "revisit":
            assert int(r["refers_to_page"]) == max(i for i in shared[body[0]] if i is not None)
    again = read_records(spark, archived(spark, rows, str(tmp_path / "plain"), WarcParams(compression="none")))
    assert again.filter("problem IS NOT NULL").count() == 0 and again.count() == len(rows)


def test_archives_of_no_pages(spark, tmp_path):
    folder = archived(spark, page_rows()[:1], str(tmp_path / "w"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "none"))
    write_warc(spark.read.parquet(str(tmp_path / "none")), str(tmp_path / "v"))
    assert assemble(read_records(spark, str(tmp_path / "v"))).count() == 0 and assemble(read_records(spark, folder)).count() == 1


def response(name, block, **fields):
    more = [(k.replace("_", "-"), v) for k, v in fields.items()]
    return record([("WARC-Type", fields.pop("kind", "response")), ("WARC-Record-ID", name), *[m for m in more if m[0] != "kind"], ("Content-Type", "application/http")], block)


HEAD = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"


def test_archives_with_faults(spark, tmp_path):
    """What is wrong is named, and what stands behind it is read."""
    whole = HEAD + chunked(b"payload " * 20, 9)
    a, b, c = whole[:60], whole[60:120], whole[120:]
    tail = {"WARC_Segment_Total_Length": len(whole)}
    part = lambda of, n, block, **more: response(f"{of}{n}", block, kind="continuation", WARC_Segment_Origin_ID=of, WARC_Segment_Number=n, **more)
    parts = [
        response("good", whole), b"junk without a header", response("plain", b"HTTP/1.1 200 OK\r\nX: 1\r\n\r\nbody\r\n\r\nmore"),
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: nolength" + b"\r\n\r\n" + b"lost",
        b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: short\r\nContent-Length: 3" + b"\r\n\r\n" + b"too long",
        response("badchunk", HEAD + b"zz\r\nabc\r\n0\r\n\r\n"), response("cutchunk", HEAD + b"5\r\nabc"), response("nohead", b"HTTP/1.1 200 OK\r\n"),
        response("after", whole + b"x"), response("digest", whole, WARC_Payload_Digest="sha1:" + "0" * 40),
        part("three", 3, c, **tail), response("three", a, WARC_Segment_Number=1), part("three", 2, b),
        response("twice", a, WARC_Segment_Number=1), part("twice", 2, b), part("twice", 2, b), part("twice", 3, c, **tail),
        response("gap", a, WARC_Segment_Number=1), part("gap", 3, c, **tail), part("orphan", 2, b, **tail),
        response("endless", a, WARC_Segment_Number=1), part("endless", 2, b),
        response("total", a, WARC_Segment_Number=1), part("total", 2, b), part("total", 3, c, WARC_Segment_Total_Length=len(whole) + 1),
        response("re", b"HTTP/1.1 200 OK\r\n\r\n", kind="revisit", WARC_Refers_To="good"), response("lost", b"HTTP/1.1 200 OK\r\n\r\n", kind="revisit", WARC_Refers_To="nowhere"),
        record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", "info"), ("Content-Type", "text/plain")], b"software: x\r\n"),
    ]
    cut = response("cutoff", whole)[:-30]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(p + b"\r\n\r\n") for p in parts) + gzip.compress(cut))
    got = {r["record_id"]: r for r in resolve(assemble(read_records(spark, str(tmp_path)), payloads=True)).collect()}
    digest = hashlib.sha1(b"payload " * 20).hexdigest()
    for name in ("good", "three", "twice", "re"):
        assert (got[name]["problem"], got[name]["payload_digest"], got[name]["payload_bytes"]) == (None, digest, 160), name
    assert got["three"]["segments"] == 3 and got["plain"]["payload_bytes"] == len(b"body\r\n\r\nmore") and got["info"]["payload_bytes"] == 13
    assert {n: got[n]["problem"] for n in got if got[n]["problem"]} == {
        None: "no header", "nolength": "no length", "short": "bad length", "badchunk": "bad chunk", "cutchunk": "chunks cut off",
        "nohead": "bad http header", "after": "bytes after the last chunk", "digest": "bad digest", "gap": "missing segment",
        "orphan": "missing segment", "endless": "missing segment", "total": "bad total length", "lost": "unresolved", "cutoff": "cut off",
    }


@pytest.mark.parametrize("step", [1, 2, 3, 7, 1000])
def test_decoder_takes_any_cuts(step):
    body = bytes(range(256)) * 3 + b"\r\n0\r\n\r\n"
    block = HEAD + chunked(body, 50)
    one = Decoder(True, True)
    for i in range(0, len(block), step):
        one.feed(block[i : i + step])
    assert one.end() is None and bytes(one.kept) == body and one.digest.hexdigest() == hashlib.sha1(body).hexdigest()
