"""Model responses to orders: one response text, or the answer of the extractor stage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_fence
from ..functions.variants import (
    at,
    cleaned_text,
    is_object,
    is_text,
    kind,
    printed,
    raw_text,
    shown,
    text_items,
    trimmed_text,
    with_objects,
)
from ..schema import ORDER_COLUMNS, ORDER_TYPE, UNKNOWN, UNKNOWN_PROVIDER, order_struct

# Names under which an answer may give the order or its parts.
ORDER_KEY = "device_order"
FINDINGS_KEY = "findings"
FINDINGS_DIAGNOSIS = "diagnosis_or_medical_justification"
FINDINGS_SPECS = "medical_specifications"
LOOSE_KEYS = {
    "device": ("device", "device_type"),
    "ordering_provider": ("ordering_provider", "provider"),
    "patient_name": ("patient_name", "patient"),
    "diagnosis": ("diagnosis",),
    "mask_type": ("mask_type",),
    "liters": ("liters",),
    "usage": ("usage",),
}
ANSWER_KEYS = (ORDER_KEY, FINDINGS_KEY, *[key for keys in LOOSE_KEYS.values() for key in keys])


def order_from_object(parsed: Column, field=trimmed_text) -> Column:
    """Order struct of a parsed object; ``field`` sets how strictly text is cleaned."""
    fields = {name: field(parsed[name]) for name in ORDER_COLUMNS if name != "add_ons"}
    fields["device"] = F.coalesce(fields["device"], F.lit(UNKNOWN))
    fields["ordering_provider"] = F.coalesce(
        fields["ordering_provider"], F.lit(UNKNOWN_PROVIDER)
    )
    return order_struct(add_ons=text_items(parsed["add_ons"]), **fields)


def parse_response(df: DataFrame, response: str, order: str = "model_order") -> DataFrame:
    """Single-pass response text to the order struct ``order``; null where the text is not
    one JSON object, so that the caller can fall back."""
    texts = {"_answer": (strip_fence(F.col(response)), ORDER_COLUMNS)}
    answer = F.col("_answer")
    return with_objects(df, texts).select(
        *df.columns,
        F.when(answer.isNotNull(), order_from_object(answer, cleaned_text)).alias(order),
    )


def findings_order(v: Column) -> Column:
    """Order struct of the nested findings shape (variant); see ``findings_readable``."""

    def text(path: str) -> Column:
        return raw_text(at(v, path))

    specs = f"$.{FINDINGS_SPECS}"
    features = at(v, f"{specs}.additional_features")
    typed = F.when(at(v, "$.device_type").isNotNull(), text("$.device_type"))
    return order_struct(
        device=F.coalesce(typed.otherwise(text("$.device")), F.lit(UNKNOWN)),
        ordering_provider=F.coalesce(text("$.ordering_provider"), F.lit(UNKNOWN_PROVIDER)),
        diagnosis=text(f"$.{FINDINGS_DIAGNOSIS}"),
        mask_type=text(f"{specs}.mask_type"),
        add_ons=F.when(is_text(features), F.array(shown(features))).otherwise(
            text_items(features)
        ),
    )


def findings_readable(v: Column) -> Column:
    """False where a field that must be text is some other kind; JSON null is fine."""

    def fits(path: str) -> Column:
        return F.coalesce(kind(at(v, path)).isin("STRING", "VOID"), F.lit(True))

    specs = at(v, f"$.{FINDINGS_SPECS}")
    typed = F.when(at(v, "$.device_type").isNotNull(), fits("$.device_type"))
    return (
        is_object(v)
        & typed.otherwise(fits("$.device"))
        & fits("$.ordering_provider")
        & fits(f"$.{FINDINGS_DIAGNOSIS}")
        & (specs.isNull() | (is_object(specs) & fits(f"$.{FINDINGS_SPECS}.mask_type")))
    )


def loose_order(answer: Column) -> Column:
    """Order struct from whatever top-level keys the answer has. The first key present
    counts, even if its value is blank."""
    fields = {
        name: F.coalesce(*[printed(answer[key]) for key in keys])
        for name, keys in LOOSE_KEYS.items()
    }
    fields["device"] = F.coalesce(fields["device"], F.lit(UNKNOWN))
    fields["ordering_provider"] = F.coalesce(
        fields["ordering_provider"], F.lit(UNKNOWN_PROVIDER)
    )
    return order_struct(**fields)


def parse_answer(df: DataFrame, answer: str, order: str = "staged_order") -> DataFrame:
    """The extractor's parsed answer, a struct with ``ANSWER_KEYS``, to the order ``order``.

    Adds ``parse_state``, which names the level that gave the order: ``device_order``,
    ``findings_order``, ``findings_root`` or ``loose``. An unreadable ``device_order`` goes
    straight to ``loose``; ``findings`` is looked at only where ``device_order`` is absent
    or empty."""
    out = F.col(answer)

    order_object, findings_object = (is_object(out[k]) for k in (ORDER_KEY, FINDINGS_KEY))

    def embedded(key: str) -> Column:
        """Text that may hold JSON; '' where absent, null or empty."""
        return F.coalesce(shown(out[key]), F.lit(""))

    texts = df.select(
        "*",
        order_object.alias("_order_object"),
        F.when(~order_object, embedded(ORDER_KEY)).alias("_order_text"),
    ).select(
        "*",
        (findings_object & (F.col("_order_text") == "")).alias("_findings_object"),
        F.when(
            ~findings_object & (F.col("_order_text") == ""), embedded(FINDINGS_KEY)
        ).alias("_findings_text"),
    )
    given = F.col("_order_object") | (F.col("_order_text") != "")
    parsed = with_objects(
        texts,
        {
            f"_{part}_json": (
                F.when(F.col(f"_{part}_text") != "", strip_fence(F.col(f"_{part}_text"))),
                (ORDER_KEY, *ORDER_COLUMNS),
            )
            for part in ("order", "findings")
        },
    )

    def opened(part: str, key: str) -> Column:
        """The object under ``key``, whether it came as an object or as text."""
        direct = [at(out[key], f"$.{n}").alias(n) for n in (ORDER_KEY, *ORDER_COLUMNS)]
        return F.when(F.col(f"_{part}_object"), F.struct(*direct)).otherwise(
            F.col(f"_{part}_json")
        )

    parsed = parsed.select(
        *df.columns,
        given.alias("_given"),
        opened("order", ORDER_KEY).alias("_order"),
        opened("findings", FINDINGS_KEY).alias("_findings"),
    )
    order_json, findings = F.col("_order"), F.col("_findings")
    nested = findings[ORDER_KEY]
    state = (
        F.when(order_json.isNotNull(), "device_order")
        .when(F.col("_given") | findings.isNull(), "loose")
        .when(nested.isNull(), "findings_root")
        .when(findings_readable(nested), "findings_order")
        .otherwise("loose")
    )
    flat = F.coalesce(order_json, findings)
    level = F.col("parse_state")
    return parsed.select(
        *df.columns,
        state.alias("parse_state"),
        flat.alias("_flat"),
        nested.alias("_nested"),
    ).select(
        *df.columns,
        level,
        F.when(
            level.isin("device_order", "findings_root"), order_from_object(F.col("_flat"))
        )
        .when(level == "findings_order", findings_order(F.col("_nested")))
        .otherwise(loose_order(out))
        .cast(ORDER_TYPE)
        .alias(order),
    )


def merge_outputs(first: Column, second: Column) -> Column:
    """Both outputs as one map; on a shared key the second wins."""
    none = F.parse_json(F.lit("{}"))

    def as_map(v: Column) -> Column:
        return F.try_variant_get(F.coalesce(v, none), "$", "map<string,variant>")

    return F.map_zip_with(
        as_map(first), as_map(second), lambda key, a, b: F.coalesce(b, a)
    )
