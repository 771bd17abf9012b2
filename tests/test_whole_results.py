"""Nothing is lost: empty files, tables in parts, logs past the limit, timeouts, and texts
that close the JSON array they are parsed in."""

import os

import pytest

from notewright.functions.variants import is_json, with_objects
from notewright.operators.deliver import post_orders, reduce_attempts, undelivered
from notewright.operators.extract import extract_orders
from notewright.params import PostParams
from notewright.sources.notes import read_notes
from workload.queries import QUERIES

SF = "/root/testdata/sf0.001"
LIVE = PostParams(base_url="https://orders.example.org")


def test_empty_files(spark, tmp_path):
    for name, text in (("a.txt", ""), ("b.txt", "needs cpap"), ("c.json", "")):
        (tmp_path / "in" / name).parent.mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    got = extract_orders(read_notes(spark, str(tmp_path / "in")), keep=("path",)).collect()
    assert sorted((r["path"].rsplit("/", 1)[1], r["device"]) for r in got) == [("a.txt", "Unknown"), ("b.txt", "CPAP"), ("c.json", "Unknown")]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_stream_of_a_table_in_parts(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.repartition(3).write.parquet(str(tmp_path / "orders.parquet"))
    spark.read.parquet(f"{SF}/customer.parquet").write.parquet(str(tmp_path / "customer.parquet"))
    assert QUERIES["stream_extract"](spark, str(tmp_path)).count() == orders.count()


def test_attempts_above_the_limit(spark):
    log = [("a", 4, 200)] + [("b", i, 503) for i in range(4)] + [("b", 4, 200)] + [("c", i, 503) for i in range(6)]
    got = reduce_attempts(spark.createDataFrame(log, "order_id string, attempt int, status int")).collect()
    assert {(r["order_id"], r["outcome"], r["attempts"]) for r in got} == {
        ("a", "delivered", 5), ("b", "delivered", 5), ("c", "exhausted", 6),
    }


def test_timeouts_are_tried_again(spark):
    def transport(payload, key, attempt):
        if payload == "late" and attempt < 2 or payload == "never":
            raise TimeoutError("slow")
        if payload == "broken":
            raise ValueError("bad")
        return 200

    orders = spark.createDataFrame([(x, x, x) for x in ("late", "never", "broken")], "note_id string, idempotency_key string, payload string")
    report = post_orders(orders, transport, LIVE, wait=lambda s: None)
    got = {r["note_id"]: (r["outcome"], r["attempts"], r["error"]) for r in report.collect()}
    assert got["late"] == ("delivered", 3, None)
    assert got["never"][:2] == ("exhausted", 4) and "slow" in got["never"][2]
    assert got["broken"][:2] == ("permanent_failure", 1) and "bad" in got["broken"][2]
    assert {r["note_id"] for r in undelivered(orders, report).collect()} == {"never", "broken"}


def test_texts_that_close_the_array(spark):
    broken = ['{"device":"X"}] and more', '{"device":"X"}]', '{"device":"X"}],[{"a":1}', '{"device":"X"},{"device":"Y"}', ""]
    good = ['{"device":"X"}', ' {"device":"X","a":[1]} ']
    df = spark.createDataFrame([(t,) for t in broken + good], "t string")
    from pyspark.sql import functions as F

    rows = with_objects(df, {"o": (F.col("t"), ["device"])}).select("t", F.col("o").isNotNull(), is_json(F.col("t"))).collect()
    assert {r[0] for r in rows if r[1]} == set(good) and {r[0] for r in rows if r[2]} == set(good)


def test_ingested_files_are_dealt_out(spark, tmp_path, monkeypatch):
    from workload import queries

    suppliers = [(i, f"Supplier#{i:09d}") for i in [*range(2100), 7]] + [(None, "Supplier#000000001")]
    spark.createDataFrame(suppliers, "s_suppkey long, s_name string").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    folder = tmp_path / "shared"
    monkeypatch.setattr(queries, "run_dir", lambda spark, label: f"file://{folder}")
    got = sorted(r["s_suppkey"] for r in QUERIES["file_ingest"](spark, str(tmp_path)).collect())
    assert got == sorted([*range(2100), 7])  # a row that comes twice is two files, a row without a key none
    sizes = [sum(f.endswith((".txt", ".json")) for f in files) for _, _, files in os.walk(folder)]
    assert sum(sizes) == 2101 and max(sizes) <= 1000


def test_texts_that_are_no_object_are_not_parsed(spark):
    from pyspark.sql import functions as F

    from notewright.functions.variants import END, at, bracketed

    texts = ["The note", "no", "null", "1", "-1", "+1", "NaN", '"a"', "[1]", "[{}]", " \t\r\n{}", "﻿{}", "\x0b{}", "\xa0{}", ",{}", "", " ", None]
    texts += ['{"a":1}', '\n{"a":{"b":2}} ', '{"a":1', '{"a":1}{"a":2}', "/*c*/{}", "true", "False", "`{}`"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    array = F.from_json(bracketed(F.col("t")), f"array<struct<a:variant,{END}:variant>>")
    plain = F.when((F.size(array) == 2) & F.get(array, F.lit(1))[END].isNotNull(), F.get(array, F.lit(0)).dropFields(END))
    value = F.try_parse_json(bracketed(F.col("t")))
    whole = at(value, f"$[1].{END}").isNotNull() & at(value, "$[2]").isNull()
    shown = [(c.isNotNull(), F.to_json(c["a"])) for c in (plain, F.col("o"))]
    made = with_objects(df, {"o": (F.col("t"), ["a"])})
    rows = made.select("t", *shown[0], whole, *shown[1], is_json(F.col("t"))).collect()
    assert [tuple(r)[1:4] for r in rows] == [tuple(r)[4:] for r in rows]
    assert sum(r[1] for r in rows) == 3 and sum(r[3] for r in rows) >= 3
    # the parser is given null for the others
    assert "from_json" in (plan := made._jdf.queryExecution().analyzed().toString()) and "ltrim" in plan


@pytest.fixture
def small_tables(spark, tmp_path):
    """Orders with keys that repeat or are missing, and customers some of whom are missing."""
    from datetime import datetime

    orders = [(i, i % 7, datetime(2024, 1, 1 + i % 28), f"{i % 5}-LOW") for i in [*range(200), 7, 7]] + [(None, 1, None, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    customers = [(i, f"Customer#{i}", "BUILDING") for i in range(5)]
    spark.createDataFrame(customers, "c_custkey long, c_name string, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_log_of_some_stages(spark, small_tables):
    from pyspark.sql import functions as F

    from workload.queries import notes
    from workload.tables import stage_responses

    source = notes(spark, small_tables)
    rows = sorted(map(repr, stage_responses(source).collect()))
    names = sorted({r["stage"] for r in stage_responses(source).select("stage").distinct().collect()})
    assert len(names) == 7
    for some in [(n,) for n in names] + [tuple(names), ("primary_extractor", "correction")]:
        wanted = stage_responses(source).filter(F.col("stage").isin(*some))
        assert sorted(map(repr, stage_responses(source, some).collect())) == sorted(map(repr, wanted.collect())), some
    assert sorted(map(repr, stage_responses(source, tuple(names)).collect())) == rows
    for name in ("compare_paths", "compare_summary"):  # no row is made for a stage that is not read
        plan = QUERIES[name](spark, small_tables)._jdf.queryExecution().optimizedPlan().toString()
        assert "single_pass" in plan and "confidence_assessor" not in plan and "Stale" not in plan


def test_prompts_are_made_in_one_pass(spark, small_tables):
    frame = QUERIES["stage_prompts"](spark, small_tables)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") <= 4  # orders and customers, once for the notes and once for the log
    counts = {r["note_id"]: r["count"] for r in frame.groupBy("note_id").count().collect()}
    assert len(counts) == 201 and counts.pop("7") == 21 and set(counts.values()) == {7}
