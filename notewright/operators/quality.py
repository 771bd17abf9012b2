"""Measures over extracted orders: completeness, agreement, accuracy, timing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_set
from ..schema import ORDER_COLUMNS
from .positions import numbered_within


def field_set(name: str, order: str | None = None) -> Column:
    """True where the field holds something: non-empty text, or a non-empty list."""
    column = F.col(f"{order}.{name}" if order else name)
    if name == "add_ons":
        return F.coalesce(F.size(column) > 0, F.lit(False))
    return is_set(column)


def field_count(order: str | None = None) -> Column:
    total = F.lit(0)
    for name in ORDER_COLUMNS:
        total = total + field_set(name, order).cast("int")
    return total


def presence_flags(order: str | None = None) -> list[Column]:
    names = {
        "has_device": "device",
        "has_patient_info": "patient_name",
        "has_provider": "ordering_provider",
        "has_mask_type": "mask_type",
        "has_liters": "liters",
        "has_usage": "usage",
        "has_add_ons": "add_ons",
        "has_qualifier": "qualifier",
    }
    return [field_set(field, order).alias(flag) for flag, field in names.items()]


def fill_rates(orders: DataFrame, by: str = "device") -> DataFrame:
    """Per group: orders, mean fields set, and how many orders have each field. Few groups,
    fixed-size buffers: every task sends one row per group, however uneven the groups."""
    filled = [
        F.count_if(field_set(name)).alias(f"with_{name}") for name in ORDER_COLUMNS
    ]
    return orders.groupBy(by).agg(
        F.count("*").alias("orders"),
        F.sum(field_count()).alias("fields_set"),
        F.min(field_count()).alias("fewest_fields"),
        F.max(field_count()).alias("most_fields"),
        *filled,
    )


def compare_columns(rule: str, model: str) -> list[Column]:
    """Two orders for one note side by side; nulls agree with nulls."""

    def same(name: str) -> Column:
        return F.col(f"{rule}.{name}").eqNullSafe(F.col(f"{model}.{name}"))

    def chars(order: str) -> Column:
        return F.coalesce(F.length(f"{order}.diagnosis"), F.lit(0))

    return [
        same("device").alias("device_match"),
        same("patient_name").alias("patient_match"),
        same("ordering_provider").alias("provider_match"),
        (chars(model) > chars(rule)).alias("longer_diagnosis"),
        field_set("mask_type", model).alias("model_mask_type"),
        field_set("add_ons", model).alias("model_add_ons"),
        field_set("liters", model).alias("model_liters"),
        field_set("usage", model).alias("model_usage"),
        field_set("qualifier", model).alias("model_qualifier"),
    ]


def content_text(name: str) -> Column:
    """A field as text by which orders of one key can be put in order; null is a sign of its own."""
    return F.coalesce(F.array_join(name, "\x01") if name == "add_ons" else F.col(name), F.lit("\x03"))


def compare_orders(rules: DataFrame, models: DataFrame, key: str = "note_id") -> DataFrame:
    """Join two order tables ``(key, order columns)`` and compare them row by row: ``key``, ``n``,
    ``side`` (``both``, ``rules`` or ``model``) and the comparisons, null where a side is missing.

    Where a key has several orders, those of each side are numbered by their content and the
    n-th of one meets the n-th of the other, so rows never multiply; a key with very many
    orders is spread over tasks, in the numbering and, by key and number, in the join. Rows
    with a null key are one key. Equal orders may be numbered either way."""

    def numbered(side: DataFrame, order: str) -> DataFrame:
        content = F.concat_ws("\x02", *[content_text(name) for name in ORDER_COLUMNS])
        packed = side.select(F.col(key).alias("_key"), content.alias("_content"), F.struct(*ORDER_COLUMNS).alias(order))
        return numbered_within(packed, "_key", "_content", name="_n", label=f"{order}s").drop("_content")

    left, right = numbered(rules, "rule_order").alias("l"), numbered(models, "model_order").alias("r")
    same = F.col("l._key").eqNullSafe(F.col("r._key")) & (F.col("l._n") == F.col("r._n"))
    joined = left.join(right, same, "full")
    both = F.col("l._n").isNotNull() & F.col("r._n").isNotNull()
    pairs = joined.select(
        F.coalesce("l._key", "r._key").alias(key),
        F.coalesce("l._n", "r._n").alias("n"),
        F.when(both, "both").when(F.col("l._n").isNotNull(), "rules").otherwise("model").alias("side"),
        "rule_order",
        "model_order",
    )
    told = compare_columns("rule_order", "model_order")
    names = pairs.select(*told).columns
    return pairs.select(key, "n", "side", *[F.when(F.col("side") == "both", c).alias(n) for c, n in zip(told, names)])


def accuracy(
    pairs: DataFrame, found: str, expected: str, by: Column | None = None
) -> DataFrame:
    """Matching fields of ``found`` against ``expected``, per group of ``by``."""
    matches = [
        F.count_if(F.col(f"{found}.{name}").eqNullSafe(F.col(f"{expected}.{name}"))).alias(
            f"{name}_matches"
        )
        for name in ORDER_COLUMNS
    ]
    everything = F.lit(True)
    for name in ORDER_COLUMNS:
        everything = everything & F.col(f"{found}.{name}").eqNullSafe(
            F.col(f"{expected}.{name}")
        )
    group = by if by is not None else F.col(f"{expected}.device").alias("device")
    return pairs.groupBy(group).agg(
        F.count("*").alias("notes"), *matches, F.count_if(everything).alias("exact_matches")
    )


def consistency(repeats: DataFrame, key: str, value: str) -> DataFrame:
    """Per key: readings, distinct readings, and whether all agree. Equal readings of a key
    are merged before the shuffle, so a key read very often stays small."""
    return (
        repeats.groupBy(key, value)
        .agg(F.count("*").alias("_times"))
        .groupBy(key)
        .agg(
            F.sum("_times").alias("readings"),
            F.count(value).alias("distinct_values"),
        )
        .withColumn("consistent", F.col("distinct_values") == 1)
    )


def consistency_markers(device: Column, wanted: Column) -> Column:
    """True where the found device names the wanted one, in any case."""
    return F.lower(device).contains(F.lower(wanted))


def timing_stats(timings: DataFrame, ms: str, by: str | None = None) -> DataFrame:
    """Mean, extremes, spread and total of a duration column, and rows per second."""
    groups = [by] if by else []
    return (
        timings.groupBy(*groups)
        .agg(
            F.count(ms).alias("notes"),
            F.avg(ms).alias("avg_ms"),
            F.min(ms).alias("min_ms"),
            F.max(ms).alias("max_ms"),
            F.stddev_pop(ms).alias("stddev_ms"),
            F.sum(ms).alias("total_ms"),
        )
        .withColumn("notes_per_s", F.try_divide(F.col("notes") * 1000.0, F.col("total_ms")))
    )


def all_rows(df: DataFrame, **checks: Column) -> DataFrame:
    """One row: for each named check, whether it holds on every row."""
    return df.agg(
        F.count("*").alias("rows"),
        *[
            F.coalesce(F.every(F.coalesce(check, F.lit(False))), F.lit(True)).alias(name)
            for name, check in checks.items()
        ],
    )
