import json

from pyspark.sql import functions as F

from notewright.operators.deliver import http_transport, post_orders, reduce_attempts
from notewright.operators.shape import add_payload, write_orders
from notewright.operators.extract import extract_orders
from notewright.params import JobParams, PostParams, StagedParams
from notewright.plans.batch import process_notes
from notewright.plans.staged import run_live, run_single
from notewright.sources.notes import notes_from_table, read_notes
from notewright.streaming.notes import order_stream, post_stream, stream_files, write_stream


def put(folder, name, data):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_bytes(data if isinstance(data, bytes) else data.encode())


def test_folder(spark, tmp_path):
    put(tmp_path, "a b+c.txt", b"\xef\xbb\xbfcpap")
    put(tmp_path, "bad.txt", b"oxygen \xff tank")
    put(tmp_path, "one.json", '{"physician_note": "Patient requires oxygen tank.", "text": "x"}')
    put(tmp_path, "plain.json", "cpap note")
    put(tmp_path, "null.json", '{"note":null,"text":"d"}')
    put(tmp_path, "five.json", '{"note":5}')
    put(tmp_path, "list.json", "[1]")
    put(tmp_path, "data.txt", '{"note":"cpap"}')
    put(tmp_path, "skip.csv", "cpap")
    put(tmp_path / "sub", "deep.txt", "cpap")
    rows = {r["path"].rsplit("/", 1)[1]: r for r in read_notes(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a b+c.txt", "bad.txt", "one.json", "plain.json", "null.json",
                         "five.json", "list.json", "data.txt"}
    assert rows["a b+c.txt"]["text"] == "cpap"
    assert rows["bad.txt"]["text"] == "oxygen � tank"
    assert rows["one.json"]["text"] == "Patient requires oxygen tank."
    assert rows["plain.json"]["text"] == "cpap note"
    assert rows["null.json"]["text"] == '{"note":null,"text":"d"}'
    assert rows["data.txt"]["text"] == '{"note":"cpap"}'
    assert {n for n, r in rows.items() if r["status"] == "error"} == {"five.json", "list.json"}
    done = process_notes(read_notes(spark, str(tmp_path)))
    assert done.filter("order IS NULL").count() == 2
    assert read_notes(spark, str(tmp_path / "missing")).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    source, out, state = (tmp_path / n for n in ("in", "out", "state"))
    for drop in ("first", "second"):
        put(source, f"{drop}.txt", f"Patient Name: {drop}\ncpap")
        write_stream(order_stream(stream_files(spark, str(source))), str(out), str(state)).awaitTermination()
    write_stream(order_stream(stream_files(spark, str(source))), str(out), str(state)).awaitTermination()
    streamed = {(r["patient_name"], r["device"]) for r in spark.read.parquet(str(out)).collect()}
    assert spark.read.parquet(str(out)).count() == 2
    assert streamed == {("first", "CPAP"), ("second", "CPAP")}

    def accept(payload, key, attempt):
        return 200

    job = JobParams(post=PostParams(base_url="https://orders.example.org"))
    post_stream(
        order_stream(stream_files(spark, str(source))), accept, str(tmp_path / "report"),
        str(tmp_path / "poststate"), job,
    ).awaitTermination()
    report = spark.read.parquet(str(tmp_path / "report"))
    assert report.filter("outcome = 'delivered'").count() == 2


def ready(spark, n=6):
    notes = spark.range(n).select(F.col("id").cast("string").alias("note_id"), F.lit("cpap").alias("text"))
    return add_payload(extract_orders(notes))


def test_posting(spark):
    scripts = {"0": [200], "1": [404], "2": [503, 200], "3": [503] * 4, "4": [None, 201], "5": ["boom"]}
    keys = {r["idempotency_key"]: scripts[r["note_id"]] for r in ready(spark).collect()}

    def scripted(payload, key, attempt):
        status = keys[key][attempt]
        if status == "boom":
            raise ValueError("broken transport")
        return status

    live = PostParams(base_url="https://orders.example.org")
    report = {r["note_id"]: r for r in post_orders(ready(spark), scripted, live, lambda s: None).collect()}
    got = [(report[k]["outcome"], report[k]["attempts"], report[k]["backoff_s"]) for k in sorted(report)]
    assert got == [
        ("delivered", 1, 0.0), ("permanent_failure", 1, 0.0), ("delivered", 2, 1.0),
        ("exhausted", 4, 7.0), ("delivered", 2, 1.0), ("permanent_failure", 1, 0.0),
    ]
    for gate in (PostParams(), PostParams(base_url="https://orders.example.org", enabled=False)):
        skipped = post_orders(ready(spark), scripted, gate).collect()
        assert {r["outcome"] for r in skipped} == {"skipped"}
    assert callable(http_transport(live))


def test_attempt_log(spark):
    log = [("a", 0, 200), ("b", 0, 503), ("b", 1, 404), ("c", 0, 503), ("d", 0, None),
           ("d", 1, 500), ("d", 2, 429), ("d", 3, 408), ("e", 0, 503), ("e", 1, 201), ("e", 2, 500)]
    df = spark.createDataFrame(log, "order_id string, attempt int, status int")
    got = {r[0]: (r["outcome"], r["attempts"], r["last_status"], r["backoff_s"]) for r in reduce_attempts(df).collect()}
    assert got == {
        "a": ("delivered", 1, 200, 0.0), "b": ("permanent_failure", 2, 404, 1.0),
        "c": ("pending", 1, 503, 0.0), "d": ("exhausted", 4, 408, 7.0), "e": ("delivered", 2, 201, 1.0),
    }


def test_written_json(spark, tmp_path):
    notes = spark.createDataFrame([("1", "cpap with humidifier, Ordered by X")], "note_id string, text string")
    write_orders(extract_orders(notes), str(tmp_path / "j"))
    line = json.loads("".join(part.read_text() for part in (tmp_path / "j").glob("*.json")))
    assert line == {"note_id": "1", "device": "CPAP", "diagnosis": "Unknown", "ordering_provider": "Dr. X",
                    "patient_name": "Unknown", "dob": "Unknown", "add_ons": ["humidifier"]}
    write_orders(extract_orders(notes), str(tmp_path / "p"), "pretty")
    pretty = "".join(part.read_text() for part in (tmp_path / "p").glob("*.txt"))
    assert "\n" in pretty.strip() and json.loads(pretty)["device"] == "CPAP"


def test_live_run(spark):
    """Every stage is asked, the poor score leads to one correction, and it is used."""

    def model(request):
        return {
            "primary_extractor": '{"device_order":{"device":"CPAP"}}',
            "confidence_assessor": '{"overall_confidence":0.9,"tokens_used":7}',
            "validation": '{"is_valid":false,"validation_score":0.2,"issues":[{"field":"dob"}]}',
            "correction": '{"device":"BiPAP","dob":"01/02/1990"}',
        }.get(request["stage"])

    table = spark.createDataFrame([("1", "cpap"), ("2", "walker")], "k string, t string")
    result = run_live(notes_from_table(table, "k", "t"), model, JobParams(staged=StagedParams(enabled=True)))
    for row in result.collect():
        assert row["order"]["device"] == "BiPAP" and row["was_corrected"]
        assert row["confidence"] == 0.9 and row["tokens_used"] == 7 and len(row["steps"]) == 4
        assert [s["state"] for s in row["steps"]] == ["fallback", "ok", "fallback", "ok"]


def test_live_run_without_model(spark):
    table = spark.createDataFrame([("1", "cpap")], "k string, t string")
    notes = notes_from_table(table, "k", "t")
    for policy, device, confidence in (("rules", "CPAP", 0.5), ("unknown", "Unknown", 0.8)):
        staged = StagedParams(enabled=True, on_model_failure=policy, require_validation=False)
        row = run_live(notes, lambda r: None, JobParams(staged=staged)).first()
        assert (row["order"]["device"], row["confidence"]) == (device, confidence)


def test_live_run_asks_in_a_single_pass_where_stages_fail(spark):
    def model(request):
        if request["stage"] != "single_pass":
            raise TimeoutError("slow")
        return '{"device":"Nebulizer"}' if "neb" in request["prompt"] else None

    table = spark.createDataFrame([("1", "neb, cpap"), ("2", "walker")], "k string, t string")
    notes = notes_from_table(table, "k", "t")
    staged = StagedParams(enabled=True, require_validation=False)
    rows = {r["note_id"]: r for r in run_live(notes, model, JobParams(staged=staged)).collect()}
    assert rows["1"]["order"]["device"] == "Nebulizer" and rows["2"]["order"]["device"] == "Walker"
    assert rows["1"]["model_errors"]["primary_extractor"] == "TimeoutError: slow"
    assert len(rows["1"]["model_errors"]) == 4 and rows["1"]["confidence"] == 0.5
    single = {r["note_id"]: r["order"]["device"] for r in run_single(notes, model).collect()}
    assert single == {"1": "Nebulizer", "2": "Walker"}


def test_live_run_corrects_in_rounds(spark, tmp_path):
    seen = str(tmp_path / "seen")

    def model(request):
        import os

        if request["stage"] == "correction":
            if os.path.exists(seen):
                return '{"device":"BiPAP"}'
            open(seen, "w").close()
            return "no idea"
        return {
            "primary_extractor": '{"device_order":{"device":"CPAP"}}',
            "validation": '{"is_valid":false,"validation_score":0.2,"issues":[{"field":"dob"}]}',
        }.get(request["stage"])

    notes = notes_from_table(spark.createDataFrame([("1", "cpap")], "k string, t string"), "k", "t")
    row = run_live(notes, model, JobParams(staged=StagedParams(enabled=True, max_corrections=2))).first()
    assert row["order"]["device"] == "BiPAP" and row["was_corrected"]
