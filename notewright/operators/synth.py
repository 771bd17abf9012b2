"""Notes made from order-like tables, with the order each note should yield beside it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fill
from ..schema import ORDER_COLUMNS, order_struct

# Devices of random orders, and how often liters and usage are given.
RANDOM_DEVICES = ("CPAP", "Oxygen Tank", "Hospital Bed", "TENS Unit", "Nebulizer")
RANDOM_LITERS = 10
USAGE_WORDS = ("sleep", "exertion", "rest", "travel", "daytime", "night")


def pick(key: Column, salt: str, n: int) -> Column:
    """A number in [0, n) that depends on ``key`` and ``salt`` alone, so that a re-run or
    a retried task draws the same one."""
    digest = F.md5(F.concat(F.lit(f"{salt}|"), key.cast("string")))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(n))


def choose(key: Column, salt: str, values: tuple) -> Column:
    """One of ``values`` by ``pick``; None stands for null."""
    options = F.array(*[F.lit(v) for v in values])
    return F.element_at(options, (pick(key, salt, len(values)) + 1).cast("int"))


def random_orders(df: DataFrame, key: str, devices: tuple[str, ...] = RANDOM_DEVICES) -> DataFrame:
    """Add ``device``, ``liters`` and ``usage`` drawn per ``key``; half the rows get each
    of the last two."""
    k = F.col(key)
    words = [choose(k, f"usage{i}", USAGE_WORDS) for i in range(3)]
    return (
        df.withColumn("device", choose(k, "device", devices))
        .withColumn(
            "liters",
            F.when(
                pick(k, "has_liters", 2) == 1,
                F.concat((pick(k, "liters", RANDOM_LITERS) + 1).cast("string"), F.lit(" L")),
            ),
        )
        .withColumn(
            "usage", F.when(pick(k, "has_usage", 2) == 1, F.concat_ws(" ", *words))
        )
    )


# The sentences and the labelled lines that notes are made of, below.


def note_sentence() -> Column:
    """The request sentence for the order columns of the row."""
    device, add_ons = F.col("device"), F.col("add_ons")
    liters, usage = F.col("liters"), F.col("usage")
    mask, qualifier = F.col("mask_type"), F.col("qualifier")
    listed = F.array_join(add_ons, " and ")
    accessorised = F.coalesce(F.size(add_ons) > 0, F.lit(False))

    def clause(present: Column, lead: str, value: Column, otherwise: str = "") -> Column:
        return F.when(present, F.concat(F.lit(lead), value)).otherwise(otherwise)

    return (
        F.when(
            (device == "Oxygen Tank") & liters.isNotNull() & usage.isNotNull(),
            fill("Patient requires oxygen tank with %s flow rate for %s.", liters, usage),
        )
        .when(
            (device == "CPAP") & mask.isNotNull(),
            F.concat(
                fill("Patient requires CPAP machine with %s mask", mask),
                clause(accessorised, " with ", listed),
                clause(qualifier.isNotNull(), ". ", qualifier),
                F.lit("."),
            ),
        )
        .when(device == "CPAP", F.lit("Patient requires CPAP machine for sleep apnea."))
        .when(
            (device == "Hospital Bed") & accessorised,
            F.concat(
                F.lit("Patient requires hospital bed with "),
                listed,
                clause(qualifier.isNotNull(), " due to ", qualifier),
                F.lit("."),
            ),
        )
        .when(device == "TENS Unit", F.lit("Patient requires TENS unit for pain management."))
        .otherwise(fill("Patient requires %s.", F.lower(device)))
    )


def note_header() -> Column:
    """The four labelled lines for the order columns of the row."""
    return fill(
        "Patient Name: %s\nDOB: %s\nDiagnosis: %s\nOrdering Physician: %s\n",
        F.col("patient_name"),
        F.col("dob"),
        F.col("diagnosis"),
        F.col("ordering_provider"),
    )


def render_notes(orders: DataFrame, text: str = "text", expected: str = "expected") -> DataFrame:
    """Add the note text and, as one struct, the order it was made from. Order columns the
    table lacks count as null."""
    missing = [name for name in ORDER_COLUMNS if name not in orders.columns]
    full = orders.select(
        "*",
        *[
            F.lit(None).cast("array<string>" if name == "add_ons" else "string").alias(name)
            for name in missing
        ],
    )
    return full.select(
        *[c for c in orders.columns if c not in ORDER_COLUMNS],
        F.concat(note_header(), note_sentence()).alias(text),
        order_struct(**{name: F.col(name) for name in ORDER_COLUMNS}).alias(expected),
    )
