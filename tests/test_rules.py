"""Golden notes and the order each must yield."""

import pytest
from pyspark.sql import functions as F

from notewright.operators.extract import extract_orders
from notewright.operators.rules import DEVICE_LABELS
from notewright.params import RuleParams

# Golden notes, and the orders that they must give.
HEADER = "Patient Name: {}\nDOB: {}\nDiagnosis: {}\nOrdering Physician: {}\n"

CASES = [
    (
        HEADER.format("Harold Finch", "04/12/1952", "COPD", "Dr. Cuddy")
        + "Patient requires oxygen tank with 2 L flow rate for sleep and exertion.",
        dict(device="Oxygen Tank", liters="2 L", usage="sleep and exertion", diagnosis="COPD",
             ordering_provider="Dr. Cuddy", patient_name="Harold Finch", dob="04/12/1952"),
    ),
    (
        HEADER.format("Lisa Turner", "09/23/1984", "Severe sleep apnea", "Dr. Foreman")
        + "Patient requires CPAP machine with full face mask with heated humidifier. AHI > 20.",
        dict(device="CPAP", mask_type="full face", add_ons=["humidifier"], qualifier="AHI > 20",
             patient_name="Lisa Turner", liters=None, usage=None),
    ),
    (
        HEADER.format("Maria Gonzalez", "03/15/1965", "Post-surgical recovery", "Dr. Stevens")
        + "Patient requires hospital bed with side rails and pressure relief due to sore risk.",
        dict(device="Hospital Bed", add_ons=None, qualifier=None),
    ),
    (
        "Patient needs a CPAP with full face mask and humidifier. AHI > 20. Ordered by Dr. Cameron.",
        dict(device="CPAP", ordering_provider="Dr. Cameron", qualifier="AHI > 20"),
    ),
    ("Patient needs CPAP machine\nOrdering Provider: Dr. Smith",
     dict(device="CPAP", ordering_provider="Dr. Smith")),
    ("CPAP machine needed.", dict(device="CPAP", ordering_provider="Dr. Unknown", dob="Unknown")),
    ("Patient needs some medical device.", dict(device="Unknown")),
    ("Requires bilevel machine", dict(device="BiPAP")),
    ("Requires breathing machine", dict(device="Nebulizer")),
    ("O2 concentrator needed", dict(device="Oxygen Tank")),
    ("Blood glucose meter prescribed", dict(device="Blood Glucose Monitor")),
    ("wheelchair, walker, CPAP and oxygen tank", dict(device="CPAP")),
    ("raised toilet seat", dict(device="Raised Toilet Seat")),
    ("toilet seat", dict(device="Unknown")),
    ("\nPatient Name: José García-Rodriguez  \nOrdering Physician: Dr. François Dubois, M.D.\n\ncpap",
     dict(patient_name="José García-Rodriguez", ordering_provider="Dr. François Dubois, M.D")),
    ("DOB:\nDiagnosis: X", dict(dob="Diagnosis: X", diagnosis="X")),
    ("Diagnosis: ", dict(diagnosis="")),
    ("Ordered by dr. smith", dict(ordering_provider="Dr. dr. smith")),
    ("Patient Name: A\r\nDOB: 1\r\nDiagnosis: c\r\noxygen 12 Lpm",
     dict(patient_name="A", dob="1", diagnosis="c", liters="12 L", usage=None)),
    ("history of hypertension", dict(device="TENS Unit")),
    ("CO2 retention", dict(device="Oxygen Tank", liters=None)),
    ("ahi > 20 cpap", dict(qualifier=None)),
    ("oxygen at 2.5 l per minute", dict(liters="2.5 L")),
    ("Diagnosis: wide ", dict(diagnosis="wide")),
    ("", dict(device="Unknown", ordering_provider="Dr. Unknown", patient_name="Unknown")),
    ("   \n\t   ", dict(device="Unknown", ordering_provider="Dr. Unknown")),
    ("Very " + "x" * 1000, dict(device="Unknown")),
]


@pytest.fixture(scope="module")
def found(spark):
    notes = spark.createDataFrame(
        [(str(i), text) for i, (text, _) in enumerate(CASES)], "note_id string, text string"
    )
    return {int(r["note_id"]): r for r in extract_orders(notes).collect()}


@pytest.mark.parametrize("case", range(len(CASES)))
def test_golden(found, case):
    for name, value in CASES[case][1].items():
        assert found[case][name] == value, name


def test_every_label_survives_the_template(spark):
    notes = spark.createDataFrame(
        [(label, f"Patient requires {label.lower()}.") for label in DEVICE_LABELS],
        "note_id string, text string",
    )
    # rules before these two claim their words
    claimed = {"Pulse Oximeter": "Pulse Oximeter"}
    for row in extract_orders(notes).collect():
        assert row["device"] == claimed.get(row["note_id"], row["note_id"])


def test_options(spark):
    notes = spark.createDataFrame(
        [("1", "hypertension\nDOB:\nDiagnosis: X")], "note_id string, text string"
    )
    row = extract_orders(notes, params=RuleParams(word_boundary=True, same_line=True)).first()
    assert (row["device"], row["dob"], row["diagnosis"]) == ("Unknown", "Unknown", "X")


def test_plan_is_narrow_and_native(spark):
    notes = spark.range(10).select(F.col("id").alias("note_id"), F.lit("cpap").alias("text"))
    plan = extract_orders(notes)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
