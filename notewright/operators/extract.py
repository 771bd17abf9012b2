"""Rule extraction: a note's text to the ten order columns, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, SPACE_IN_LINE, capture, trim_all
from ..params import RuleParams
from ..schema import ORDER_COLUMNS, UNKNOWN, UNKNOWN_PROVIDER
from .rules import DEVICE_RULES, DeviceRule, classify

# Field patterns ({s} is any whitespace), defaults, and detail words.
PATIENT_PATTERN = r"Patient{s}*Name:{s}*(.+)"
DOB_PATTERN = r"DOB:{s}*(.+)"
DIAGNOSIS_PATTERN = r"Diagnosis:{s}*(.+)"
PHYSICIAN_PATTERN = r"Ordering Physician:{s}*(.+?)(?:\r?\n|$)"
ORDERED_BY_PATTERN = r"(?:Ordered by|Dr\.){s}*(.+?)\.?$"
LITERS_PATTERN = r"(\p{{Nd}}+(?:\.\p{{Nd}}+)?){s}*L(?:{s}*per{s}*minute)?"
PROVIDER_PREFIX = "Dr."
MASK = "full face"
ADD_ON = "humidifier"
QUALIFIER = "AHI > 20"
USAGES = ("sleep", "exertion")

# Words a text must hold, lower-cased, for the pattern to be worth running.
PATTERN_GUARDS = {
    PATIENT_PATTERN: ("name:",),
    DOB_PATTERN: ("dob:",),
    DIAGNOSIS_PATTERN: ("diagnosis:",),
    PHYSICIAN_PATTERN: ("ordering physician:",),
    ORDERED_BY_PATTERN: ("ordered by", "dr."),
}


def labelled(text: Column, lowered: Column, pattern: str, params: RuleParams) -> Column:
    """Raw capture of a labelled field, ``''`` if absent. A substring test on the folded
    text comes first: it costs a fraction of a case-insensitive scan of a long note."""
    space = SPACE_IN_LINE if params.same_line else SPACE
    found = capture(text, pattern.format(s=space))
    guards = PATTERN_GUARDS.get(pattern)
    if not guards:
        return found
    worth = lowered.contains(guards[0])
    for word in guards[1:]:
        worth = worth | lowered.contains(word)
    return F.when(worth, found).otherwise("")


def field_value(raw: Column) -> Column:
    """A captured header field: trimmed, or the unknown label where nothing matched."""
    return F.when(raw == "", UNKNOWN).otherwise(trim_all(raw))


def provider_value(raw: Column) -> Column:
    """A captured provider: no trailing dots, always titled."""
    name = F.rtrim(trim_all(raw), F.lit("."))
    return F.when(raw == "", UNKNOWN_PROVIDER).otherwise(
        F.when(name.startswith(PROVIDER_PREFIX), name).otherwise(
            F.concat(F.lit(PROVIDER_PREFIX + " "), name)
        )
    )


def liters_value(raw: Column) -> Column:
    return F.when(raw != "", F.concat(raw, F.lit(" L")))


def usage_value(lowered: Column) -> Column:
    said = [F.when(lowered.contains(word), F.lit(word)) for word in USAGES]
    return F.nullif(F.concat_ws(" and ", *said), F.lit(""))


def extract_orders(
    notes: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("note_id",),
    params: RuleParams = RuleParams(),
    rules: tuple[DeviceRule, ...] = DEVICE_RULES,
) -> DataFrame:
    """``keep`` columns of ``notes`` plus the ten order columns.

    Three projections over one scan: fold the text once; classify and capture; shape the
    captures. No shuffle, no Python, and columns that nobody selects are pruned with the
    expressions behind them."""
    folded = notes.select(
        *keep,
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
        F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"),
    )
    body, low = F.col("_text"), F.col("_low")
    device = F.col("device")
    physician, oxygen, cpap = F.col("_physician"), device == "Oxygen Tank", device == "CPAP"
    captured = folded.select(
        *keep,
        body,
        low,
        classify(low, rules, params.word_boundary).alias("device"),
        labelled(body, low, PATIENT_PATTERN, params).alias("_patient"),
        labelled(body, low, DOB_PATTERN, params).alias("_dob"),
        labelled(body, low, DIAGNOSIS_PATTERN, params).alias("_diagnosis"),
        labelled(body, low, PHYSICIAN_PATTERN, params).alias("_physician"),
    ).select(
        *keep,
        body,
        low,
        device,
        "_patient",
        "_dob",
        "_diagnosis",
        F.when(physician != "", physician)
        .otherwise(labelled(body, low, ORDERED_BY_PATTERN, params))
        .alias("_provider"),
        F.when(oxygen, labelled(body, low, LITERS_PATTERN, params))
        .otherwise("")
        .alias("_liters"),
    )
    shaped = {
        "device": device,
        "liters": liters_value(F.col("_liters")),
        "usage": F.when(oxygen, usage_value(low)),
        "diagnosis": field_value(F.col("_diagnosis")),
        "ordering_provider": provider_value(F.col("_provider")),
        "patient_name": field_value(F.col("_patient")),
        "dob": field_value(F.col("_dob")),
        "mask_type": F.when(cpap & low.contains(MASK), F.lit(MASK)),
        "add_ons": F.when(cpap & low.contains(ADD_ON), F.array(F.lit(ADD_ON))),
        "qualifier": F.when(cpap & body.contains(QUALIFIER), F.lit(QUALIFIER)),
    }
    return captured.select(*keep, *[shaped[name].alias(name) for name in ORDER_COLUMNS])
