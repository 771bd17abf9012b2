"""Column names and struct types that the stages of a job hand to each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The order record, in output order.
ORDER_FIELDS = (
    ("device", "string"),
    ("liters", "string"),
    ("usage", "string"),
    ("diagnosis", "string"),
    ("ordering_provider", "string"),
    ("patient_name", "string"),
    ("dob", "string"),
    ("mask_type", "string"),
    ("add_ons", "array<string>"),
    ("qualifier", "string"),
)
ORDER_COLUMNS = tuple(name for name, _ in ORDER_FIELDS)
REQUIRED_COLUMNS = ("device", "ordering_provider")
ORDER_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in ORDER_FIELDS) + ">"

ISSUE_TYPE = "struct<field:string,issue:string,severity:string,suggested_fix:string>"
VALIDATION_TYPE = (
    f"struct<is_valid:boolean,score:double,issues:array<{ISSUE_TYPE}>,"
    "field_confidences:map<string,double>,suggestions:array<string>>"
)
RESPONSE_TYPE = "note_id string, stage string, attempt int, response string"

# Severities, least to most serious.
SEVERITIES = ("Info", "Warning", "Error", "Critical")

UNKNOWN = "Unknown"
UNKNOWN_PROVIDER = "Dr. Unknown"


def order_struct(**columns: Column) -> Column:
    """An order struct with the given fields; the rest are null."""
    return F.struct(
        *[
            columns.get(name, F.lit(None)).cast(dtype).alias(name)
            for name, dtype in ORDER_FIELDS
        ]
    )


def blank_order() -> Column:
    """The default record: empty device and provider, nothing else."""
    return order_struct(device=F.lit(""), ordering_provider=F.lit(""))


def or_blank(order: str | Column) -> Column:
    """``order``, or the default record where there is none."""
    column = F.col(order) if isinstance(order, str) else order
    return F.coalesce(column, blank_order())


def order_columns(order: str) -> list[Column]:
    """The ten columns of the order struct called ``order``."""
    return [F.col(f"{order}.{name}").alias(name) for name in ORDER_COLUMNS]


def pack_order() -> Column:
    """The ten flat order columns as one struct."""
    return F.struct(*[F.col(name) for name in ORDER_COLUMNS])


def severity_rank(severity: Column) -> Column:
    """Position of a severity in the scale, for ordering and thresholds."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1
