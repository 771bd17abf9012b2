"""Keyword classification of a note into one device label."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import any_word
from ..schema import UNKNOWN


@dataclass(frozen=True)
class DeviceRule:
    """Hits where any of ``any_of`` and all of ``all_of`` occur, in lower case."""

    label: str
    any_of: tuple[str, ...]
    all_of: tuple[str, ...] = ()


# Labels and keywords, first hit wins.
DEVICE_RULES = (
    DeviceRule("CPAP", ("cpap", "continuous positive airway pressure")),
    DeviceRule("BiPAP", ("bipap", "bilevel")),
    DeviceRule("Oxygen Tank", ("oxygen", "o2")),
    DeviceRule("Wheelchair", ("wheelchair",)),
    DeviceRule("Walker", ("walker", "rollator")),
    DeviceRule("Nebulizer", ("nebulizer", "breathing machine")),
    DeviceRule("Hospital Bed", ("hospital bed", "adjustable bed")),
    DeviceRule("Pressure Relief Mattress", ("mattress", "pressure relieving")),
    DeviceRule("Crutches", ("crutches",)),
    DeviceRule("Cane", ("cane", "walking stick")),
    DeviceRule("Mobility Scooter", ("scooter", "mobility scooter")),
    DeviceRule("Suction Machine", ("suction", "aspirator")),
    DeviceRule("Ventilator", ("ventilator", "respirator")),
    DeviceRule("Pulse Oximeter", ("pulse oximeter", "oxygen monitor")),
    DeviceRule("TENS Unit", ("tens", "electrical stimulation")),
    DeviceRule("Compression Pump", ("compression pump", "lymphedema pump")),
    DeviceRule("Commode", ("commode", "bedside toilet")),
    DeviceRule("Shower Chair", ("shower chair", "bath bench")),
    DeviceRule("Raised Toilet Seat", ("toilet seat",), ("raised",)),
    DeviceRule("Blood Glucose Monitor", ("blood glucose", "glucometer")),
    DeviceRule("Blood Pressure Monitor", ("blood pressure",), ("monitor",)),
)
DEVICE_LABELS = tuple(rule.label for rule in DEVICE_RULES)


def rule_hit(lowered: Column, rule: DeviceRule, word_boundary: bool = False) -> Column:
    hit = any_word(lowered, rule.any_of, word_boundary)
    for word in rule.all_of:
        hit = hit & any_word(lowered, (word,), word_boundary)
    return hit


def classify(
    lowered: Column,
    rules: tuple[DeviceRule, ...] = DEVICE_RULES,
    word_boundary: bool = False,
) -> Column:
    """Label of the first rule that hits; one CASE, so later rules cost nothing then."""
    label = F
    for rule in rules:
        label = label.when(rule_hit(lowered, rule, word_boundary), F.lit(rule.label))
    return label.otherwise(F.lit(UNKNOWN))


def rule_hits(
    lowered: Column,
    rules: tuple[DeviceRule, ...] = DEVICE_RULES,
    word_boundary: bool = False,
) -> Column:
    """Labels of all rules that hit, in rule order: shows what first-hit-wins hides."""
    return F.array_compact(
        F.array(
            *[
                F.when(rule_hit(lowered, rule, word_boundary), F.lit(rule.label))
                for rule in rules
            ]
        )
    )
