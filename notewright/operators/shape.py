"""Orders as JSON: the published form and the posted form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import ORDER_COLUMNS, REQUIRED_COLUMNS


def published_fields() -> list[Column]:
    """Device and provider always; the others only where they hold something."""

    def field(name: str) -> Column:
        if name in REQUIRED_COLUMNS:
            return F.coalesce(F.col(name), F.lit("")).alias(name)
        if name == "add_ons":
            return F.when(F.size(name) > 0, F.col(name)).alias(name)
        return F.nullif(F.col(name), F.lit("")).alias(name)

    return [field(name) for name in ORDER_COLUMNS]


def output_json(pretty: bool = False) -> Column:
    """The published JSON of the row's order columns; null fields are left out."""
    options = {"pretty": "true"} if pretty else {}
    return F.to_json(F.struct(*published_fields()), options)


def payload_json() -> Column:
    """The posted JSON: nulls are left out, empty strings are kept."""
    fields = [
        F.coalesce(F.col(n), F.lit("")).alias(n) if n in REQUIRED_COLUMNS else F.col(n)
        for n in ORDER_COLUMNS
    ]
    return F.to_json(F.struct(*fields))


def add_payload(orders: DataFrame, key: str = "note_id") -> DataFrame:
    """Add ``payload``, its size in characters, and a key that is the same on every run
    for the same note and content, by which a receiver or a re-run can spot repeats."""
    return orders.withColumn("payload", payload_json()).select(
        "*",
        F.length("payload").alias("payload_chars"),
        F.sha2(F.concat_ws("|", F.col(key), "payload"), 256).alias("idempotency_key"),
    )


def write_orders(orders: DataFrame, path: str, form: str = "json", mode: str = "error") -> None:
    """Write published orders as JSON lines, pretty JSON text, or parquet."""
    others = [c for c in orders.columns if c not in ORDER_COLUMNS]
    if form == "pretty":
        orders.select(output_json(pretty=True).alias("value")).write.mode(mode).text(path)
        return
    shaped = orders.select(*others, *published_fields())
    shaped.write.mode(mode).format(form).save(path)
