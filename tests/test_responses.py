import json

import pytest
from pyspark.sql import functions as F

from notewright.functions.text import strip_fence
from notewright.functions.variants import with_objects
from notewright.operators.responses import ANSWER_KEYS, merge_outputs, parse_answer, parse_response
from notewright.operators.validate import add_basic_validation, add_model_validation
from notewright.schema import order_struct


def test_single_pass(spark):
    texts = {
        "strict": '{"device":"\\"CPAP\\",","dob":null,"add_ons":["a",1,"b"],"patient_name":5,"diagnosis":" "}',
        "fenced": '```json\n{"device":"X"}\n```',
        "trailing": '{"device":"X"} and more',
        "comma": '{"device":"X",}',
        "array": "[1]",
        "repeated": '{"device":"a","device":"b"}',
        "empty": "",
        "none": None,
    }
    df = spark.createDataFrame(list(texts.items()), "k string, r string")
    got = {r["k"]: r["model_order"] for r in parse_response(df, "r").collect()}
    strict = got["strict"]
    assert strict["device"] == "CPAP" and strict["add_ons"] == ["a", "b"]
    assert strict["patient_name"] is None and strict["diagnosis"] is None
    assert strict["ordering_provider"] == "Dr. Unknown"
    assert got["fenced"]["device"] == "X" and got["repeated"]["device"] == "b"
    assert all(got[k] is None for k in ("trailing", "comma", "array", "empty", "none"))


ANSWERS = [
    ({"device_order": {"device": " CPAP ", "add_ons": ["x"]}}, "device_order", "CPAP"),
    ({"device_order": '{"device":" Y "}'}, "device_order", "Y"),
    ({"device_order": "bad", "findings": '{"device":"Q"}', "device": True}, "loose", "True"),
    ({"device_order": None, "findings": {"device_order": {"device_type": " W "}}}, "findings_order", " W "),
    ({"device_order": "", "findings": '{"device":"Q"}'}, "findings_root", "Q"),
    ({"findings": {"other": 1}}, "findings_root", "Unknown"),
    ({"findings": {"device_order": {"device_type": 4}}, "device_type": "DT"}, "loose", "DT"),
    ({"findings": "prose", "device": "D"}, "loose", "D"),
    ({"device": None, "device_type": "z"}, "loose", ""),
    ({"device_order": [1]}, "loose", "Unknown"),
    ({}, "loose", "Unknown"),
]


def test_answer_cascade(spark):
    rows = [(i, json.dumps(a)) for i, (a, _, _) in enumerate(ANSWERS)]
    df = with_objects(spark.createDataFrame(rows, "i int, r string"), {"o": (F.col("r"), ANSWER_KEYS)})
    for row in parse_answer(df, "o").collect():
        _, state, device = ANSWERS[row["i"]]
        assert (row["parse_state"], row["staged_order"]["device"]) == (state, device), row["i"]


def test_merge_last_wins(spark):
    a, b = (F.parse_json(F.lit(t)) for t in ('{"k":1,"a":[1]}', '{"k":"two"}'))
    merged = json.loads(spark.range(1).select(F.to_json(merge_outputs(a, b)).alias("j")).first()["j"])
    assert merged == {"k": "two", "a": [1]}


@pytest.mark.parametrize(
    "text,bare", [("```json\n{}\n```", "{}"), ("``` {} ```", "{}"), (" {} ", "{}"), ("a```b", "a```b")]
)
def test_fence(spark, text, bare):
    assert spark.range(1).select(strip_fence(F.lit(text)).alias("t")).first()["t"] == bare


@pytest.mark.parametrize(
    "device,patient,score,valid",
    [("CPAP", "A", 1.0, True), ("CPAP", None, 0.8, True), ("Unknown", None, 0.6, False), ("", "A", 0.8, False)],
)
def test_basic_validation(spark, device, patient, score, valid):
    df = spark.range(1).select(
        order_struct(device=F.lit(device), patient_name=F.lit(patient)).alias("o")
    )
    v = add_basic_validation(df, "o").first()["validation"]
    assert (round(v["score"], 9), v["is_valid"]) == (score, valid)


def test_model_validation_kinds(spark):
    texts = [
        ('{"is_valid":true,"validation_score":0.9,"issues":[{"severity":"ERROR"},{"severity":"3"}]}', True),
        ('{"is_valid":"yes"}', False),
        ('{"validation_score":"0.9"}', False),
        ('{"issues":["x"]}', False),
        ("[]", False),
        ("{}", True),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, r string")
    for row in add_model_validation(df, "r", "v").collect():
        assert (row["v"] is not None) == texts[row["i"]][1], texts[row["i"]][0]
    first = add_model_validation(df.filter("i = 0"), "r", "v").first()["v"]
    assert [i["severity"] for i in first["issues"]] == ["Error", "Critical"]
