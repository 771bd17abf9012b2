"""The operators against brute force on small tables, and on odd rows and empty tables."""

import base64
import collections
import hashlib
import json
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from notewright.llm import bpe, chosen_path, decontaminate, ivfpq, licenses, line_dedup, repeats, resample, toolcalls, toxicity
from notewright.llm.common import Words
from notewright.llm.components import components

SF = "/root/testdata/sf0.001"
given = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PATH = public_tokenizers.path(bpe.RANKS)


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def whole():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("whole", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- SQL counterparts ------------------------------------------------------------------


@given
@pytest.mark.parametrize("module", [chosen_path, decontaminate, line_dedup], ids=lambda m: m.__name__.rpartition(".")[2])
def test_sql(spark, module):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    for name, sql in module.SQL.items():
        want = con.execute(sql)
        columns = [c[0] for c in want.description]
        got = module.QUERIES[name](spark, SF)
        assert sorted(columns) == sorted(got.columns)
        assert sorted(map(tuple, got.select(*columns).collect())) == sorted(want.fetchall())


# --- 7: byte-level BPE -----------------------------------------------------------------


@given
def test_bpe(spark):
    got = {r["doc_id"]: r for r in bpe.op7_byte_bpe(spark, SF).collect()}
    enc = whole()
    for doc_id, text in documents():
        ids = enc.encode_ordinary(text or "")
        row = got[doc_id]
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), sha(",".join(map(str, ids))))
        assert row["decoded_sha256"] == sha(text or "")


def test_bpe_cuts_are_safe(spark, odd, none):
    enc, rng = whole(), random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["a", "Z", "é", "漢", " ", "  ", "\n", "\t ", "7", "42", "'s", "'", "!", "…", " ", "don't"]) for _ in range(60))
        assert bpe.encode(text, PATH, 3) == enc.encode_ordinary(text)
    rows = bpe.encode_texts(odd, PATH)
    assert rows.columns.count("ids") == 1 and rows.count() == odd.count()
    texts = {(r["doc_id"], r["text"]): r["decoded"] for r in bpe.decode_ids(rows, PATH).collect()}
    assert all(bytes(v) == (t or "").encode() for (_, t), v in texts.items())
    assert bpe.digest(none, PATH).count() == 0


# --- 10: decontamination ---------------------------------------------------------------


def hits(text, items, size=10):
    words = WORDS.findall(low(text))
    hit, found = set(), set()
    for item_id, item in items:
        own = WORDS.findall(low(item))
        for i in range(max(1, len(own) - size + 1) if own else 0):
            window = own[i : i + size]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit |= set(range(j, j + len(window)))
                    found.add(str(item_id))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_words", [100_000, 6])
def test_decontaminate(spark, odd, none, block_words):
    items = [(1, "Quick BROWN fox"), (2, "one two three"), (3, None), (4, "..."), (5, "lazy dog and runs away the quick brown fox jumps over"), (6, "absent words")]
    bench = spark.createDataFrame(items, "item_id int, text string")
    found = decontaminate.decontaminate(odd, bench, keep=["doc_id", "text"], block_words=block_words).collect()
    assert len(found) == odd.count()
    for r in found:
        assert (r["n_words"], r["n_hit"], r["items"]) == hits(r["text"], items)
        assert sum(s["end"] - s["start"] for s in r["hit_words"]) == r["n_hit"]
        for words, chars in zip(r["hit_words"], r["hit_chars"], strict=True):
            assert len(WORDS.findall(low(r["text"][chars["start"] : chars["end"]]))) == words["end"] - words["start"]
    assert decontaminate.decontaminate(odd, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.clean(odd, bench).columns == odd.columns
    named = spark.createDataFrame([(1, "clean words", 7, "a"), (2, "a quick brown fox", 8, "b")], "doc_id long, text string, N_HIT int, Items string")
    left = decontaminate.clean(named, bench)
    assert left.columns == named.columns and [tuple(r) for r in left.collect()] == [(1, "clean words", 7, "a")]


# --- 8: line dedup ---------------------------------------------------------------------


@given
def test_line_dedup(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(line_dedup.SQL["op8_line_dedup"]).fetchall()
    got = line_dedup.op8_line_dedup(spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_line_dedup_odd(spark, odd, none):
    line = "A shared line of more than forty characters, this"
    rows = [(i, f"{i}\n {line} \nend {i}\n{line.upper()}") for i in range(1, 7)] + [(6, "6"), (None, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r[0], r[1]) for r in line_dedup.drop_lines(df).collect()}
    assert (6, rows[5][1]) in kept and (1, "1\nend 1") in kept and (None, "") in kept
    assert line_dedup.drop_lines(odd).columns == odd.columns and line_dedup.drop_lines(odd).count() == odd.count()
    assert line_dedup.keep_bitmaps(none).count() == 0


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = "a line of text that is long enough to be counted here"
    df = spark.createDataFrame([(i, f"{line}\n{i}", 1, 2, "x") for i in range(6)], "doc_id long, text string, doc_r int, Row_R int, bitmap string")
    rows = sorted(line_dedup.drop_lines(df).collect())
    assert [r["text"] for r in rows] == [*(str(i) for i in range(5)), f"{line}\n5"] and {(r["doc_r"], r["Row_R"]) for r in rows} == {(1, 2)}


def test_hashes_tell_patterns_apart():
    """Two words that a polynomial hash modulo 2**64 can't tell apart."""
    word = "a"
    for _ in range(10):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    hashes = Words([word.encode(), f"x {other} {word}".encode()]).hash
    assert hashes[0] == hashes[3] != hashes[2]


def test_line_decisions_across_tasks():
    """A key that spans sorted partitions is settled by the summaries of its ends."""
    import pyarrow as pa

    def batch(rows):
        k1, k2, doc = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(doc, pa.int64()), pa.array(doc, pa.int64()), pa.array([[0]] * len(rows), pa.list_(pa.int32()))],
            names=["k1", "k2", "doc", "row", "at"],
        )

    parts = [[(1, 1, d) for d in (9, 8, 7)], [(1, 1, 6), (1, 1, 5), (2, 2, 4), (2, 2, 3)], [(2, 2, 2), (2, 2, 1), (2, 2, 0)]]
    out = [r for p in parts for b in line_dedup.decide(iter([batch(p)]), 5) for r in b.to_pylist()]
    summaries = collections.Counter()
    for r in out:
        if r["kind"] == line_dedup.SUMMARY:
            summaries[r["k1"]] += r["n"]
    assert summaries == {1: 5, 2: 5}
    assert {(r["k1"], r["doc"]) for r in out if r["kind"] == line_dedup.PENDING} >= {(1, 8), (2, 3), (2, 0)}


# --- 4: Jaccard join -------------------------------------------------------------------


def classes(rows, alike):
    parent, links = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if alike(rows[i], rows[j]):
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return links, [find(i) for i in range(len(rows))]


def shingles(text):
    w = WORDS.findall(low(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@given
@pytest.mark.parametrize("limits", [{}, {"leaf": 2, "sketch_block": 2, "block": 2}])
def test_jaccard_join(spark, limits):
    docs = documents()
    sets = [shingles(t) for _, t in docs]
    links, roots = classes(sets, lambda a, b: bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc"]: r for r in chosen_path.near_copies(df, params=chosen_path.JoinParams(**limits)).collect()}
    for (doc_id, _), n, root in zip(docs, links, roots, strict=True):
        assert (got[doc_id]["n_links"], got[doc_id]["class_doc"]) == (n, docs[root][0])


def test_jaccard_join_odd(spark, odd, none):
    kept = chosen_path.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8]
    assert chosen_path.near_copies(none).count() == 0
    twice = spark.createDataFrame([(1, "the same text twice over again")] * 2, "doc_id long, text string")
    assert chosen_path.keep_first(twice).count() == 1


def test_jaccard_join_without_ids(spark):
    """Each set's text is looked up once, however many rows lack an id."""
    texts = [f"a text of many words that all share but the number {i}" for i in range(12)]
    df = spark.createDataFrame([(None, t) for t in texts] + [(7, t) for t in texts], "doc_id long, text string")
    sets = chosen_path.distinct_sets(chosen_path.documents_sets(df, "doc_id", "text", 5))
    members = sets.selectExpr("*", "set_id as comp", "12L as size").drop("sketch")
    got = chosen_path.member_texts(df, members, "doc_id", "text").collect()
    assert sorted(bytes(r["bytes"]).decode() for r in got) == sorted(texts)


def test_components(spark):
    chain = [(f"{i:04}", f"{i + 1:04}") for i in range(100)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = dict(components(spark.createDataFrame(chain, "a string, b string")).collect())
    assert got == {f"{i:04}": "0000" for i in range(101)} | {"x": "x", "y": "x"}


# --- 5: repeated byte strings ----------------------------------------------------------


def without_repeats(texts, length):
    seen = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        out.append(bytes(np.frombuffer(t, np.uint8)[~gone]))
    return out


@given
@pytest.mark.parametrize("limits", [{}, {"sorted_segments": 1}])
def test_repeats(spark, limits):
    docs = documents()
    want = without_repeats([(t or "").encode() for _, t in docs], 400)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc"]: r["spans"] for r in repeats.repeated_spans(df, params=repeats.RepeatParams(**limits)).collect()}
    for (doc_id, text), kept in zip(docs, want, strict=True):
        assert repeats.rest((text or "").encode(), repeats.merged(got.get(doc_id))) == kept


def test_suffix_sort():
    rng = random.Random(3)
    parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(20, 200))) for _ in range(30)]
    seen = collections.Counter(p[i : i + 8] for p in parts for i in range(len(p) - 7))
    assert repeats.repeated(parts, 8) == [[i for i in range(len(p) - 7) if seen[p[i : i + 8]] > 1] for p in parts]


def test_repeats_odd(spark, odd, none):
    rows = repeats.repeated_spans(odd).collect()
    assert {r["doc"] for r in rows} == {1, 2, 6, 8}
    assert repeats.repeated_spans(none).count() == 0


# --- 6, 1: classifiers -----------------------------------------------------------------


def test_toxicity(spark, odd, none):
    rng = random.Random(1)
    plain = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(rng.choices(plain, k=40) + (["awful"] if i % 4 == 0 else []))) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    weights = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, weights).collect()}
    assert np.mean([(got[i] >= 0.3) == (i % 4 == 0) for i, _ in rows]) > 0.97
    assert len(weights) < 2000
    scored = toxicity.score(odd, weights)
    assert scored.columns.count("score") == 1 and all(0 <= r["score"] <= 1 for r in scored.collect())
    assert toxicity.reject(odd, labels).columns == odd.columns
    assert toxicity.train(none, labels) == [] and toxicity.score(none, []).count() == 0


def test_toxicity_keeps_all_where_nothing_was_learned(spark):
    rows = [(i, f"clean words {i} of a text") for i in range(40)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    one, two = known[:2]
    tables = {
        "empty": [], "null": [(one, None), (None, 1)], "one clean": [(one, 0)], "two clean": [(one, 0), (two, 0)], "one toxic": [(one, 1)],
        "one of each": [(one, 0), (two, 1)], "no id of docs": [(i, i % 2) for i in range(1000, 1100)], "all toxic": [(i, 1) for i in known],
        "held out": [(i, i % 2) for i in range(40) if i not in known],
    }
    for name, given_labels in tables.items():
        labels = spark.createDataFrame(given_labels, "doc_id long, toxic int")
        left = toxicity.reject(docs, labels, corpus_pipeline.TOXIC)
        assert sorted(map(str, left.collect())) == sorted(map(str, docs.collect())), name


@given
@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1)], [(1, 0), (2, 1)], [(1, None)]])
def test_toxicity_predicts_by_the_score_alone(spark, tmp_path, labels):
    docs = spark.createDataFrame([(i, f"some words {i}" if i % 3 else None, "en", "s", 3) for i in range(12)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rows = toxicity.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(rows) == 12 and all(r["predicted"] == (r["score"] >= 0.3) for r in rows)
    if len({t for _, t in labels}) < 2:
        assert toxicity.reject(docs, spark.read.parquet(str(tmp_path / "labels.parquet")), 0.3).count() == 12


def ftrl_plainly(found, labels, params):
    """One coordinate at a time, in plain Python."""
    z, n, bias = {}, {}, 1 << params.bits
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= (0 if k == bias else params.l1) else -(z[k] - math.copysign(0 if k == bias else params.l1, z[k])) / ((params.beta + math.sqrt(n[k])) / params.alpha + params.l2)
    for epoch in range(params.epochs):
        for i in np.random.default_rng(epoch).permutation(len(labels)):
            at = [*found[i].tolist(), bias]
            w = {k: weight(k) for k in at}
            g = 1 / (1 + math.exp(-sum(w.values()))) - labels[i]
            for k in at:
                before = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / params.alpha * w[k]
                n[k] = before + g * g
    return {k: weight(k) for k in z if weight(k)}


def test_toxicity_weights_equal_plain_ftrl(spark):
    params = toxicity.FtrlParams()
    texts = [(f"{'awful nasty' if i % 3 == 0 else 'kind calm'} word{i % 7} text", int(i % 3 == 0), i) for i in range(60)]
    got = dict(toxicity.fit(spark.createDataFrame(texts, "text string, label int, order long"), 60, params))
    wanted = ftrl_plainly(toxicity.present([t.encode() for t, _, _ in texts], params.bits), [y for _, y, _ in texts], params)
    assert set(got) == set(wanted) and all(abs(got[k] - wanted[k]) < 1e-9 for k in got)


def test_toxicity_learns_only_from_its_rows(spark):
    """Labels of held-out rows don't matter."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    held = "pmod(crc32(cast(doc_id as string)), 4) = 2"
    assert toxicity.train(docs, labels) == toxicity.train(docs, labels.selectExpr("doc_id", f"if({held}, 1 - toxic, toxic) as toxic"))


@given
def test_resample(spark, odd, none):
    rows = resample.op1_importance_resample(spark, SF).collect()
    assert sum(r["kept"] for r in rows) == int(np.ceil(0.8 * len(rows)))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert resample.resample(odd, labels).count() == odd.count()
    assert resample.resample(none, labels).count() == 0
    keys = spark.createDataFrame([(float(x),) for x in [3, 1, 2, 2, 2, 9, -5]], "k double")
    assert [resample.kth_largest(keys, "k", i, bins=2) for i in range(1, 8)] == [9, 3, 2, 2, 2, 1, -5]


# --- 2: licences -----------------------------------------------------------------------


@given
def test_resample_scores_equal_brute_force(spark):
    """The log ratio of each text from plain counts, and the k rows of largest score."""
    draw = random.Random(4)
    docs = [(i, " ".join(draw.choices(["good", "fine", "plain", "bad,", "worse!", "é"], k=draw.randrange(0, 9)))) for i in range(80)] + [(90, None), (91, "")]
    labels = [(i, int("good" in (t or ""))) for i, t in docs]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, target_id int")
    params = resample.ResampleParams(bits=8)
    rows = resample.resample(df, spark.createDataFrame(labels, "doc_id long, quality int"), params).collect()
    grams = {i: resample.grams([(t or "").encode()], params.bits)[1].tolist() for i, t in docs}
    good = [i for i, q in labels if q and zlib.crc32(str(i).encode()) % 4 != 2]
    raw, target = np.zeros(256), np.zeros(256)
    for i, g in grams.items():
        for b in g:
            raw[b] += 1
            target[b] += i in good
    ratio = np.log((target + 1) / (target + 1).sum()) - np.log((raw + 1) / (raw + 1).sum())
    for r in rows:
        assert r["n_grams"] == len(grams[r["doc_id"]]) and abs(r["log_weight"] - sum(ratio[b] for b in grams[r["doc_id"]])) < 1e-6
    kept = [r["gumbel_key"] for r in rows if r["kept"]]
    assert len(kept) == math.ceil(params.keep * len(rows)) and min(kept) > max(r["gumbel_key"] for r in rows if not r["kept"])


def test_licenses(spark, odd, none):
    got = {r["doc_id"]: r for r in licenses.op2_license_scan(spark, SF).collect()}
    for doc_id, text in documents():
        words = WORDS.findall(low(text))
        found = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in found]
        row = got[doc_id]
        assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"]) == (len(words), len(at), min(at, default=None), max(at, default=None))
        assert row["base_labels"] == ",".join(sorted({label for _, label in found}))
        assert set(row["base_labels"].split(",")) - {""} <= set(row["labels"].split(","))
    rows = licenses.scan_licenses(odd).collect()
    assert {r["labels"] for r in rows if r["doc_id"] is None} == {"mit,mit-notice"}
    assert licenses.scan_licenses(none).count() == 0


def test_licenses_of_common_texts(spark):
    gpl = "This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU {} License as published by\n * the Free Software Foundation, {} of the License, or\n * (at your option) any later version."
    files = {
        "mit": ("mit-notice", 'Copyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
        "gpl3": ("gpl-3-notice,gpl-notice", gpl.format("General Public", "either version 3")),
        "gpl2": ("gpl-2-notice,gpl-notice", gpl.format("General Public", "either version 2")),
        "gpl2 only": ("gpl-2-notice,gpl-notice", gpl.format("General Public", "version 2")),
        "gpl2 line": ("gpl-2-notice", "This work is licensed under the GNU General Public License, version 2."),
        "no version": ("gpl-notice", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License."),
        "lgpl": ("lgpl-2.1-notice,lgpl-notice", gpl.format("Lesser General Public", "either version 2.1")),
        "isc": ("isc-notice", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
        "cc0": ("cc0-1.0-notice", "Published as CC0 1.0 Universal."),
        "unlicense": ("unlicense-notice", "This is free and unencumbered software released into the public domain."),
        "bsd3": ("bsd-3-clause-notice,bsd-notice", "3. Neither the name of Some Firm nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
        "cc": ("cc-by-sa-4.0-notice", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        "prose": ("", "The software was free of charge, and any person with a copy was free to use it for this purpose or to modify the work."),
    }
    df = spark.createDataFrame([(k, t) for k, (_, t) in files.items()], "doc_id string, text string")
    got = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(df).collect()}
    assert {k: ",".join(x for x in v.split(",") if x.endswith("-notice")) for k, v in got.items()} == {k: v for k, (v, _) in files.items()}


# --- 3: tool calls ---------------------------------------------------------------------


def test_tool_calls(spark):
    schemas = {"add": {"type": "object", "properties": {"a": {"type": "integer"}}, "required": ["a"], "additionalProperties": False}}
    calls = [
        (1, 1, "a", "add", '{"a": 1}', None), (1, 3, "b", "add", '{"b": 2}', "a"), (1, 5, "c", "add", "{", "b"), (1, 6, "a", "add", "{}", "c"),
        (2, 1, "p", "none", "{}", "q"), (2, 2, "q", "add", '{"a": true}', "p"), (2, 3, None, "add", None, None),
    ]
    results = [(1, 2, "a", "one"), (1, 2, "a", "one"), (1, 9, "zz", "lost"), (1, 4, "b", None)]
    rows = toolcalls.link(
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after string"),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"),
        schemas,
    ).collect()
    got = {r["call_id"]: r for r in rows}
    assert len(rows) == len(got) == 7
    assert [got[k]["level"] for k in "abc"] == [0, 2, 4] and got["p"]["level"] is None and got["q"]["level"] is None
    assert [got[k]["status"] for k in ("a", "c", "zz", None)] == ["linked", "no_result", "no_call", "no_result"]
    assert (got["a"]["n_calls"], got["a"]["n_results"]) == (2, 2)
    assert got["a"]["message"] == '{"arguments":{"a":1},"id":"a","name":"add","result":"one"}'
    assert got["a"]["valid"] and got["b"]["errors"] == "$.a: missing; $.b: unknown" and got["c"]["errors"] == "$: no JSON"
    assert got["p"]["errors"] == "$: no schema" and got["q"]["errors"] == "$.a: not integer"


def test_tool_calls_lose_no_row(spark):
    schemas = {"f": {"type": "object"}}
    calls = [
        (1, 1, "x", "f", '{"n": 1}', None), (1, 3, "x", "f", '{"n": 2}', "y"), (1, 5, "x", "f", '{"n": 3}', "x"), (1, 2, "y", "f", "{}", "x"),
        (2, 1, "x", "f", '{"n": 4}', None), (None, 1, "x", "f", '{"n": 5}', None), (3, 1, None, "f", '{"n": 6}', None), (3, 2, None, "f", '{"n": 7}', None),
    ]
    results = [(1, 2, "x", "r1"), (1, 4, "x", "r2"), (2, 2, "x", "r4"), (2, 3, "x", "r5"), (None, 2, "x", "r6"), (3, 3, None, "r7"), (3, 4, None, "r8")]
    rows = toolcalls.link_all(
        spark.createDataFrame(calls, "conv_id long, turn long, call_id string, name string, arguments string, after string"),
        spark.createDataFrame(results, "conv_id long, turn long, call_id string, content string"),
        schemas,
    ).collect()
    got = collections.Counter()
    for r in rows:
        message = json.loads(r["message"])
        got[r["conv_id"], r["call_id"], message.get("arguments", {}).get("n"), message.get("result"), r["level"], r["n_calls"], r["n_results"]] += 1
    assert got == collections.Counter([
        (1, "x", 1, "r1", 0, 3, 2), (1, "x", 2, "r2", 4, 3, 2), (1, "x", 3, None, 2, 3, 2), (1, "y", None, None, 2, 1, 0),
        (2, "x", 4, "r4", 0, 1, 2), (2, "x", None, "r5", None, 1, 2), (None, "x", 5, "r6", 0, 1, 1),
        (3, None, 6, None, None, 1, 0), (3, None, 7, None, None, 1, 0), (3, None, None, "r7", None, 0, 1), (3, None, None, "r8", None, 0, 1),
    ])
    turns = [(None, 1, "assistant", "a"), (None, 1, "assistant", "b"), (None, 2, "user", "c"), (5, None, "assistant", "d"), (5, None, "user", "e")]
    turns = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    made = toolcalls.link_all(*toolcalls.from_conversations(turns), toolcalls.SCHEMAS).collect()
    assert sorted(r["status"] for r in made) == ["no_call"] * 2 + ["no_result"] * 3


@given
def test_tool_calls_with_odd_arguments(spark):
    """Half characters, deep nesting, NaN and numbers beyond doubles neither fail nor pass as JSON."""
    texts = {"half": '{"query":"\\ud800"}', "deep": "[" * 100_000, "closed": "[" * 5_000 + "]" * 5_000, "nan": '{"query":NaN}', "inf": '{"x":1e999}', "big": "9" * 5_000, "key": '{"\\udfff":1}'}
    calls = spark.createDataFrame([(1, i, k, "search", t, None) for i, (k, t) in enumerate(texts.items())], "conv_id long, turn long, call_id string, name string, arguments string, after string")
    results = spark.createDataFrame([(1, 9, "half", "ok")], "conv_id long, turn long, call_id string, content string")
    rows = {r["call_id"]: r for r in toolcalls.link_all(calls, results, toolcalls.SCHEMAS).collect()}
    assert len(rows) == len(texts)
    assert rows["half"]["valid"] and rows["half"]["message"] == '{"arguments":{"query":"\\ud800"},"id":"half","name":"search","result":"ok"}'
    assert not any(rows[k]["valid"] for k in texts if k != "half")
    assert all(rows[k]["errors"] == "$: no JSON" for k in ("deep", "nan", "inf", "big"))
    for k, r in rows.items():
        assert "NaN" not in r["message"] or k == "nan"
        assert isinstance(json.loads(r["message"])["arguments"], (dict, list, str))


def test_tool_calls_of_conversations(spark):
    rows = toolcalls.op3_tool_calls(spark, SF).collect()
    turns = {(c, t): r for c, t, r in duckdb.sql(f"SELECT conv_id, turn, role FROM '{SF}/conversations.parquet'").fetchall()}
    for r in rows:
        if r["status"] == "no_call":
            continue
        conv, turn = r["conv_id"], int(r["call_id"].rsplit(":", 1)[1])
        depth = 0
        while turns.get((conv, turn - 2 * (depth + 1))) == "assistant":
            depth += 1
        assert r["level"] == 2 * depth and (r["status"] == "linked") == (turns.get((conv, turn + 1)) == "user")
    empty = spark.read.parquet(f"{SF}/conversations.parquet").limit(0)
    assert toolcalls.link(*toolcalls.from_conversations(empty), toolcalls.SCHEMAS).count() == 0


# --- 9: embeddings ---------------------------------------------------------------------


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(150, 20))
    rows = [(i, (centres[i % 150] + rng.normal(scale=rng.choice([0.05, 0.3, 0.5]), size=20)).tolist()) for i in range(1500)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 20), (2003, [1.0] * 19 + [float("nan")]), (2004, rows[0][1]), (2005, [2 * x for x in rows[0][1]]), (2006, [1.0, None]), (2007, [1.0, 0.0]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r for r in ivfpq.near_vectors(df, params=ivfpq.PqParams(block=100)).collect()}
    usable = [(i, np.array(v)) for i, v in rows if v and len(v) == 20 and None not in v and np.isfinite(v).all() and any(v)]
    unit = np.stack([v / np.linalg.norm(v) for _, v in usable])
    true = (unit @ unit.T >= 0.9).sum(1) - 1
    found = np.array([got[i]["n_links"] for i, _ in usable])
    assert (found <= true).all() and found.sum() >= 0.95 * true.sum()
    for i in (2000, 2001, 2002, 2003, 2006, 2007):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[2004]["component_id"] == got[2005]["component_id"] == got[0]["component_id"]
    assert ivfpq.near_vectors(df.limit(0)).count() == 0


def test_near_vectors_of_long_lists(spark):
    """Wide blocks of long lists, small ones, and a single one find the same links."""
    from pyspark.sql import functions as F

    n = spark.createDataFrame([(0,), (1,), (10,), (40,), (41,), (400,)], "n long")
    assert [r[0] for r in n.select(ivfpq.blocks(F.col("n"), 10)).collect()] == [0, 1, 1, 4, 2, 10]
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 20))
    rows = [(i, (centres[i % 60] + rng.normal(scale=0.2, size=20)).tolist()) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.9).sum(1) - 1
    # few lists, so that each has more rows than four small blocks
    got = [
        sorted(map(tuple, ivfpq.near_vectors(df, params=ivfpq.PqParams(lists=2, probes=2, block=block)).collect()))
        for block in (20, 600)
    ]
    assert got[0] == got[1]
    found = np.array([r[1] for r in got[0]])
    assert (found <= true).all() and found.sum() >= 0.95 * true.sum() > 0


# --- pipeline --------------------------------------------------------------------------


@given
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns, name
        now = spark.createDataFrame(after.collect(), docs.schema)
    kept = {r["doc_id"]: r["text"] for r in now.collect()}
    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert out.keys() == kept.keys()
    assert all(out[k]["decoded_sha256"] == sha(t or "") and len(out[k]["ids"]) == out[k]["n_tokens"] for k, t in kept.items())
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    assert not any(hits(t, items)[1] for t in list(kept.values())[:40])
    sets = [shingles(t) for t in kept.values()]
    links, _ = classes(sets, lambda a, b: bool(a) and bool(b) and len(a & b) >= 0.8 * len(a | b))
    assert not any(links)


def test_pipeline_odd(spark, odd, none, tmp_path):
    spark.createDataFrame([(1, 0), (7, 1)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() <= odd.count()


def test_pipeline_encodes_in_one_python_pass(spark, odd):
    import corpus_pipeline
    from pyspark.sql import functions as F

    got = corpus_pipeline.encode(spark, odd, "")
    # each Python step of a task has a worker of its own, which stays for later stages
    assert got._jdf.queryExecution().analyzed().toString().count("MapInArrow") == 1
    path = public_tokenizers.path(bpe.RANKS)
    wanted = bpe.decode_ids(bpe.encode_texts(odd, path, keep=["doc_id", "lang", "source"]), path)
    wanted = wanted.select("doc_id", "lang", "source", F.size("ids").cast("long"), "ids", F.sha2("decoded", 256))
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids", "decoded_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, map(tuple, wanted.collect())))
