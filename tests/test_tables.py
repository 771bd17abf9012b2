"""Numbering, comparison and splitting of tables, counted batches, listed files, and the sink."""

import random
import time

import pytest
from pyspark.sql import functions as F

from notewright.operators.extract import extract_orders
from notewright.operators.positions import numbered_within, with_position
from notewright.operators.quality import compare_orders
from notewright.operators.shape import add_payload
from notewright.params import PostParams
from notewright.plans.batch import presented, split_by_confidence, write_batch
from notewright.schema import ORDER_FIELDS
from notewright.sinks.orders_api import post_to_report, read_report
from notewright.sources.listing import empty_files
from notewright.sources.notes import notes_from_table, read_notes
from notewright.streaming.notes import once_per_note, order_stream, stream_files, write_stream

ORDERS = "k string, " + ", ".join(f"{n} {t}" for n, t in ORDER_FIELDS)
LIVE = PostParams(base_url="https://orders.example.org")


def test_positions(spark):
    draw = random.Random(1)
    rows = [(None if i % 11 == 0 else "hot" if i % 3 == 0 else f"k{draw.randrange(40)}", draw.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    whole = sorted(with_position(df, "k", "v").collect(), key=lambda r: r["position"])
    assert [r["position"] for r in whole] == list(range(1, 501))
    assert [(r["k"], r["v"]) for r in whole] == sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    seen: dict = {}
    for r in sorted(numbered_within(df, "k", "v").collect(), key=lambda r: ((r["k"] or ""), r["n"])):
        seen.setdefault(r["k"], []).append((r["n"], r["v"]))
    for key, got in seen.items():
        assert got == list(enumerate(sorted(v for k, v in rows if k == key), 1))
    assert with_position(df.limit(0), "k").count() == 0 and numbered_within(df.limit(0), "k", "v").count() == 0


def order(key, device, **more):
    return (key, *(more.get(n, device if n == "device" else None) for n, _ in ORDER_FIELDS))


def test_compare_orders(spark):
    rules = spark.createDataFrame(
        [order("a", "CPAP"), order("a", "Walker"), order("b", "Cane"), order(None, "Cane"), order("d", "X", add_ons=["p"])], ORDERS
    )
    models = spark.createDataFrame(
        [order("a", "Walker"), order("a", "CPAP"), order("a", "Zzz"), order("c", "Cane"), order(None, "Cane"), order("d", "X", add_ons=["q"])], ORDERS
    )
    got = {(r["k"], r["n"]): (r["side"], r["device_match"]) for r in compare_orders(rules, models, "k").collect()}
    assert got == {
        ("a", 1): ("both", True), ("a", 2): ("both", True), ("a", 3): ("model", None), ("b", 1): ("rules", None),
        ("c", 1): ("model", None), (None, 1): ("both", True), ("d", 1): ("both", True),
    }
    assert compare_orders(rules.limit(0), models, "k").filter("side = 'model'").count() == 6


def test_split_by_confidence(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.7), ("c", 0.69), ("d", None)], "note_id string, confidence double")
    accepted, review = split_by_confidence(df, str(tmp_path / "t"))
    assert sorted(r["note_id"] for r in accepted.collect()) == ["a", "b"] and accepted.columns == df.columns
    assert sorted(r["note_id"] for r in review.collect()) == ["c", "d"]
    plan = accepted._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(gate" in plan


def test_written_batch_counts_itself(spark, tmp_path):
    rows = [("1", "in/b.txt", "cpap"), ("2", "in/a.json", "[1]"), ("3", "in/c.json", '{"note":"walker"}')]
    from notewright.sources.notes import open_envelopes

    files = spark.createDataFrame(rows, "note_id string, path string, raw string")
    done = write_batch(open_envelopes(files), str(tmp_path / "out"))
    assert (done.total, done.processed, done.failed) == (3, 2, 1) and done.elapsed_ms > 0 and done.notes_per_s > 0
    placed = {r["position"]: r["path"] for r in presented(done.table).collect()}
    assert placed == {1: "in/a.json", 2: "in/b.txt", 3: "in/c.json"}
    empty = write_batch(open_envelopes(files.limit(0)), str(tmp_path / "none"))
    assert (empty.total, empty.processed, empty.failed) == (0, 0, 0)


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)


def test_listing(spark, tmp_path):
    for name, text in (("a.txt", ""), ("b c+%d.json", ""), ("full.txt", "x"), ("e.csv", ""), ("_f.txt", ""), (".g.txt", "")):
        put(tmp_path / "one", name, text)
    put(tmp_path / "one" / "deep", "h.txt", "")
    put(tmp_path / "two", "i.txt", "")

    def names(path):
        return sorted(r["path"].removeprefix("file://") for r in empty_files(spark, path, (".txt", ".json")).collect())

    one = [f"{tmp_path}/one/a.txt", f"{tmp_path}/one/b c+%d.json"]
    assert names(str(tmp_path / "one")) == names(f"file://{tmp_path}/one") == one
    assert names(f"{tmp_path}/*") == [*one, f"{tmp_path}/two/i.txt"] and names(str(tmp_path / "none")) == []
    assert read_notes(spark, str(tmp_path / "one")).count() == 3 and read_notes(spark, str(tmp_path / "one"), empties=False).count() == 1


def test_empty_files_in_a_stream(spark, tmp_path):
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    for drop in ("1", "2"):
        put(source, f"empty{drop}.txt", "")
        put(source, f"full{drop}.txt", "cpap")
        write_stream(order_stream(stream_files(spark, str(source))), str(out), str(state)).awaitTermination()
        time.sleep(0.01)
    write_stream(order_stream(stream_files(spark, str(source))), str(out), str(state)).awaitTermination()
    got = sorted((r["file_name"], r["device"]) for r in spark.read.parquet(str(out)).collect())
    assert got == [("empty1", "Unknown"), ("empty2", "Unknown"), ("full1", "CPAP"), ("full2", "CPAP")]


def test_once_per_note(spark, tmp_path):
    """Repeats within the delay go, also over a restart; later ones and new notes stay."""
    schema = "note_id string, ts timestamp"

    def deliver(*rows):
        spark.createDataFrame(list(rows), "note_id string, s string").select("note_id", F.col("s").cast("timestamp").alias("ts")).write.mode("append").parquet(str(tmp_path / "in"))
        arriving = once_per_note(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", "1 hour")
        write_stream(arriving, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()

    deliver(("a", "2024-01-01 00:00:00"), ("a", "2024-01-01 00:10:00"), ("b", "2024-01-01 02:50:00"), ("c", "2024-01-01 03:00:00"))
    deliver(("a", "2024-01-01 03:01:00"), ("b", "2024-01-01 03:02:00"), ("late", "2024-01-01 01:00:00"), ("new", "2024-01-01 03:03:00"))
    got = sorted(r["note_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == ["a", "a", "b", "c", "new"]


def ready(spark, keys):
    table = spark.createDataFrame([(k, "cpap") for k in keys], "k string, t string").repartition(3)
    return add_payload(extract_orders(notes_from_table(table, "k", "t")))


def test_sink_reports_on_commit_only(spark, tmp_path):
    report = str(tmp_path / "report")

    def accept(payload, key, attempt):
        return 200

    def die(payload, key, attempt):
        raise SystemExit("the worker is lost")

    first = post_to_report(ready(spark, "abc"), report, accept, LIVE)
    assert sorted(r["note_id"] for r in first.filter("outcome = 'delivered'").collect()) == ["a", "b", "c"]
    with pytest.raises(Exception):
        post_to_report(ready(spark, "xyz"), report, die, LIVE)
    left = [p.name for p in (tmp_path / "report").rglob("*") if p.is_file()]
    assert read_report(spark, report).count() == 3 and all(n.startswith("part-") for n in left)
    assert not any((tmp_path / "report" / "_staging").iterdir())
    assert post_to_report(ready(spark, "de"), report, accept, LIVE).count() == 5
    assert post_to_report(ready(spark, "f"), report, accept, LIVE, mode="overwrite").count() == 1
    skipped = post_to_report(ready(spark, "gh"), str(tmp_path / "gate"), die, PostParams())
    assert {r["outcome"] for r in skipped.collect()} == {"skipped"}
    with pytest.raises(Exception, match="idempotency_key"):
        from notewright.sinks.orders_api import orders_sink

        spark.dataSource.register(orders_sink(accept, LIVE))
        spark.range(1).write.format("orders_api").option("report", report).mode("append").save()


@pytest.mark.parametrize("end", ["abort", "commit"])
def test_sink_task_after_the_end(tmp_path, end):
    """A task that the scheduler started before the end, and that begins after it, posts nothing and leaves nothing."""
    from pyspark.sql.types import StringType, StructType

    from notewright.sinks.orders_api import orders_sink

    asked = []

    def accept(payload, key, attempt):
        asked.append(key)
        return 200

    order = {"note_id": "a", "idempotency_key": "k", "payload": "{}"}
    schema = StructType()
    for name in order:
        schema.add(name, StringType())
    writer = orders_sink(accept, LIVE)({"report": str(tmp_path / "report")}).writer(schema, False)
    getattr(writer, end)([])
    with pytest.raises(FileNotFoundError):
        writer.write(iter([order]))
    assert not asked and not [p for p in tmp_path.rglob("*") if p.is_file()]
    assert not any((tmp_path / "report" / "_staging").iterdir())
