"""Rounds of checking and correcting, attempts by rank, and what a run tells of itself."""

import json
import time

import pytest
from pyspark.sql import functions as F

from notewright.operators.validate import latest_corrections, worst_severity
from notewright.params import JobParams, ModelParams, StagedParams
from notewright.plans.staged import replay, run_live, run_single
from notewright.schema import ISSUE_TYPE
from notewright.sources.notes import notes_from_table

LOG = "note_id string, stage string, attempt int, response string"
GOOD = '{"is_valid":true,"validation_score":0.9,"issues":[]}'
POOR = '{"is_valid":false,"validation_score":0.2,"issues":[{"issue":"x"}]}'


def fixed(name):
    return json.dumps({"device": name, "patient_name": "P"})


def staged(**changes):
    return JobParams(staged=StagedParams(enabled=True, **changes), run_id="r1")


def some_notes(spark, keys):
    return notes_from_table(spark.createDataFrame([(k, "cpap") for k in keys], "k string, t string"), "k", "t")


def log_of(verdicts, fixes):
    rows = []
    for note, told in verdicts.items():
        rows.append((note, "primary_extractor", 1, '{"device_order":{"device":"First","patient_name":"P"}}'))
        rows += [(note, "validation", i, r) for i, r in enumerate(told, 1)]
        rows += [(note, "correction", i, r) for i, r in enumerate(fixes.get(note, []), 1)]
    return rows


VERDICTS = {
    "good": [GOOD, POOR],
    "once": [POOR, GOOD, POOR],
    "twice": [POOR, POOR, GOOD],
    "never": [POOR, POOR, POOR],
    "unread": [POOR, GOOD],
    "silent": [POOR],
    "basic": [POOR],
}
FIXES = {
    "good": [fixed("No")],
    "once": [fixed("A"), fixed("B")],
    "twice": [fixed("A"), fixed("B"), fixed("C")],
    "never": [fixed("A"), fixed("B"), fixed("C")],
    "unread": ["no idea", fixed("B")],
    "basic": [fixed("A"), fixed("B")],
}
# device, corrected, verdicts, score
THOROUGH = {
    "good": ("First", False, 1, 0.9),
    "once": ("A", True, 2, 0.9),
    "twice": ("B", True, 3, 0.9),
    "never": ("B", True, 3, 0.2),
    "unread": ("B", True, 2, 0.9),
    "silent": ("First", False, 1, 0.2),
    "basic": ("A", True, 2, 1.0),  # no second verdict on record: the order has device and patient
}


def test_thorough_replay(spark):
    log = spark.createDataFrame(log_of(VERDICTS, FIXES), LOG)
    rows = replay(some_notes(spark, VERDICTS), log, staged(mode="Thorough")).collect()
    got = {r["note_id"]: (r["order"]["device"], r["was_corrected"], r["rounds"], r["validation"]["score"]) for r in rows}
    assert got == THOROUGH
    # Standard: the last verdict, and the last correction that can be read
    rows = replay(some_notes(spark, VERDICTS), log, staged()).collect()
    got = {r["note_id"]: (r["order"]["device"], r["rounds"]) for r in rows}
    assert got["never"] == ("B", 1) and got["once"] == ("B", 1) and got["silent"] == ("First", 1)


@pytest.mark.parametrize("limit,device,rounds", [(0, "First", 1), (1, "A", 2), (3, "C", 4)])
def test_rounds_are_bounded(spark, limit, device, rounds):
    log = spark.createDataFrame(log_of({"n": [POOR] * 5}, {"n": [fixed(x) for x in "ABCDE"]}), LOG)
    row = replay(some_notes(spark, ["n"]), log, staged(mode="Thorough", max_corrections=limit)).first()
    assert (row["order"]["device"], row["rounds"]) == (device, rounds)


def test_thorough_live(spark, tmp_path):
    """A live run asks each note as many times as it needs, and its log replays to the same."""
    folder = str(tmp_path)

    def model(request):
        import os

        if request["stage"] == "primary_extractor":
            name = request["prompt"].split("for ")[1].split(".")[0]
            return json.dumps({"device_order": {"device": "First", "patient_name": name}})
        if request["stage"] not in ("validation", "correction"):
            return None
        name = next(n for n in VERDICTS if f"for {n}." in request["prompt"])
        mine = [f for f in os.listdir(folder) if f.startswith(f"{name}-{request['stage']}-")]
        open(f"{folder}/{name}-{request['stage']}-{len(mine)}", "w").close()
        told = (VERDICTS if request["stage"] == "validation" else FIXES).get(name, [])
        return told[len(mine)] if len(mine) < len(told) else None

    table = spark.createDataFrame([(n, f"for {n}. cpap") for n in VERDICTS], "k string, t string")
    result = run_live(notes_from_table(table, "k", "t"), model, staged(mode="Thorough")).collect()
    got = {r["note_id"]: (r["order"]["device"], r["was_corrected"], r["rounds"], r["validation"]["score"]) for r in result}
    assert got == THOROUGH
    asked = [p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()]
    assert asked.count("good-validation") == 1 and "good-correction" not in asked
    assert asked.count("twice-validation") == 3 and asked.count("twice-correction") == 2
    assert asked.count("silent-validation") == 1 and asked.count("silent-correction") == 2


@pytest.mark.parametrize("first", [0, 1, 7, 100])
def test_attempts_count_from_the_least(spark, first):
    logs = {
        "both": ["{}", '{"device":"B"}', '{"device":"C"}'],
        "first": ['{"device":"A"}', "no", '{"device":"C"}'],
        "none": ["no", None, '{"device":"C"}'],
        "one": ['{"device":"A"}'],
    }
    rows = [(n, first + i, r) for n, told in logs.items() for i, r in enumerate(told)]
    rows += [("gap", first, '{"device":"A"}'), ("gap", first + 5, '{"device":"F"}')]
    df = spark.createDataFrame(rows, "note_id string, attempt int, response string")
    got = {r["note_id"]: (r["correction"], r["n_passed_over"]) for r in latest_corrections(df).collect()}
    assert got == {
        "both": ('{"device":"B"}', 2), "first": ('{"device":"A"}', 2), "none": (None, 3), "one": ('{"device":"A"}', 0),
        "gap": ('{"device":"A"}', 1),
    }


def test_run_metadata(spark):
    def model(request):
        time.sleep(0.03)
        return '{"device_order":{"device":"CPAP"},"tokens_used":5}' if request["stage"] == "primary_extractor" else None

    notes = some_notes(spark, ["a", "b"])
    rows = run_live(notes, model, staged(require_validation=False)).collect()
    for row in rows:
        assert row["run_id"] == "r1" and row["processed_at"] is not None
        assert [s["duration_ms"] >= 25 for s in row["steps"]] == [True] * 4 and row["n_steps"] == 4
        assert row["duration_ms"] >= sum(s["duration_ms"] for s in row["steps"])
        assert row["additional"]["ExtractionMode"] == "Standard" and row["additional"]["RequiredValidation"] == "False"
    other = spark.createDataFrame([("z", "primary_extractor", 1, "{}")], LOG)
    back = replay(notes, other, JobParams(staged=StagedParams(require_validation=False))).first()
    assert len(back["run_id"]) == 32 and back["run_id"] != "r1"
    assert back["additional"] is None and back["duration_ms"] is None and back["extractor_version"] == "FallbackParser"


def test_rules_over_an_unreadable_answer(spark):
    notes = some_notes(spark, ["a"])
    for policy, device in (("note", "CPAP"), ("response", "Walker")):
        assert run_single(notes, lambda r: "It is a walker.", ModelParams(on_bad_response=policy)).first()["order"]["device"] == device
        assert run_single(notes, lambda r: None, ModelParams(on_bad_response=policy)).first()["order"]["device"] == "CPAP"
    with pytest.raises(ValueError):
        ModelParams(on_bad_response="else")


def test_worst_severity(spark):
    issues = F.from_json(F.col("j"), f"array<{ISSUE_TYPE}>")
    rows = [('[{"severity":"Info"},{"severity":"Critical"},{"severity":"Error"}]',), ("[]",)]
    df = spark.createDataFrame(rows, "j string").select(worst_severity(issues).alias("w"))
    assert [r["w"] for r in df.collect()] == ["Critical", None]


def test_modes_are_read_once(spark):
    from notewright.params import MODES, JobParams, StagedParams
    from notewright.plans.staged import replay, replay_modes

    good, bad = '{"device_order":{"device":"Cane"},"tokens_used":3}', '{"overall_confidence":"high"}'
    log = [
        ("a", "primary_extractor", 1, good), ("b", "primary_extractor", 1, good), ("b", "confidence_assessor", 1, bad),
        ("b", "single_pass", 1, '{"device":"Walker"}'), ("c", "medical_validator", 1, '{"tokens_used":"many"}'),
        ("d", "primary_extractor", 1, '{"device_order":{"device":"Cane"},"tokens_used":"many"}'),
    ]
    notes = spark.createDataFrame([(n, n, "needs cpap") for n in "abcde"], "note_id string, path string, text string")
    log = spark.createDataFrame(log, "note_id string, stage string, attempt int, response string")
    for failure in ("rules", "unknown"):
        found = replay_modes(notes, log, MODES, JobParams(staged=StagedParams(on_model_failure=failure)))
        got = {(r["note_id"], r["mode"]): r["order"] for r in found.collect()}
        for mode in MODES:
            job = JobParams(staged=StagedParams(on_model_failure=failure, mode=mode, require_validation=False))
            assert {r["note_id"]: r["order"] for r in replay(notes, log, job).collect()} == {n: got[n, mode] for n in "abcde"}
        plan = found._jdf.queryExecution().analyzed().toString()
        one = replay_modes(notes, log, ("Standard",), JobParams(staged=StagedParams(on_model_failure=failure)))
        assert plan.count("from_json(") == one._jdf.queryExecution().analyzed().toString().count("from_json(")


def test_log_of_verdict_rounds_is_made_in_one_pass(spark, tmp_path):
    from datetime import datetime

    from notewright.plans.prompts import VALIDATION
    from workload.queries import notes, thorough_result
    from workload.tables import VERDICT_ROUNDS, stage_responses, verdict_rounds

    day = datetime(2020, 1, 2)
    orders = [(k, (k or 0) % 3, day, "1-URGENT") for k in [*range(60), 7, None]]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(
        str(tmp_path / "orders.parquet")
    )
    # a key that repeats, and an order without a customer
    spark.createDataFrame([(0, "A", "X"), (0, "B", "Y"), (1, "C", None)], "c_custkey long, c_name string, c_mktsegment string").write.parquet(
        str(tmp_path / "customer.parquet")
    )
    source = notes(spark, str(tmp_path))
    made = stage_responses(source, verdicts=VERDICT_ROUNDS)
    wanted = stage_responses(source).filter(F.col("stage") != VALIDATION).unionByName(verdict_rounds(source))
    assert made.count() == wanted.count() > 0
    assert made.exceptAll(wanted).isEmpty() and wanted.exceptAll(made).isEmpty()
    plan = thorough_result(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("Relation [") == 4  # orders and customers, for the notes and for the log


def test_prose_is_no_json(spark):
    from notewright.functions.variants import begins, is_json

    prose = ["no structure", "the note", "for now", "If so", "t", "n", "", "nul", "nan", "Note", "-", "word"]
    values = ["true", "false", "null", " \n null ", "1", "-2.5", '"x"', "[]", "{}", "0", "1e3"]
    rows = spark.createDataFrame([(t,) for t in [*prose, *values]], "t string")
    got = {r[0]: r[1] for r in rows.select("t", F.coalesce(is_json(F.col("t")), F.lit(False))).collect()}
    assert [got[t] for t in prose] == [False] * len(prose) and all(got[t] for t in values)
    assert [r[0] for r in rows.limit(2).select(begins(F.col("t"), "tr", "nu")).collect()] == [False, False]
