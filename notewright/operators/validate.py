"""Checking an order and choosing its correction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_set, strip_fence
from ..functions.variants import (
    at,
    is_boolean,
    is_number,
    is_object,
    trimmed_text,
    with_objects,
)
from ..params import StagedParams
from ..schema import (
    ISSUE_TYPE,
    ORDER_COLUMNS,
    ORDER_TYPE,
    SEVERITIES,
    UNKNOWN,
    VALIDATION_TYPE,
    blank_order,
    severity_rank,
)
from ..sources.completions import first_attempts, ranked_attempts
from .responses import order_from_object

# Issues of the basic check, penalty per issue, scores without a verdict.
NO_DEVICE = ("Device", "Device type not identified", "Error")
NO_PATIENT = ("PatientName", "Patient name missing", "Warning")
PENALTY = 0.2
LOWEST_SCORE = 0.1
DEFAULT_SCORE = 0.5
DEFAULT_SEVERITY = "Warning"
VERDICT_KEYS = ("is_valid", "validation_score", "issues")


def issue(field: str, text: str, severity: str) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        F.lit(text).alias("issue"),
        F.lit(severity).alias("severity"),
        F.lit(None).cast("string").alias("suggested_fix"),
    )


def verdict(is_valid: Column, score: Column, issues: Column) -> Column:
    return F.struct(
        is_valid.alias("is_valid"),
        score.alias("score"),
        issues.alias("issues"),
        F.create_map().alias("field_confidences"),
        F.array().alias("suggestions"),
    ).cast(VALIDATION_TYPE)


def basic_issues(order: Column) -> Column:
    """Issues of an order; where there is no order there is nothing to object to."""
    device, given = order["device"], order.isNotNull()
    return F.array_compact(
        F.array(
            F.when(given & (~is_set(device) | (device == UNKNOWN)), issue(*NO_DEVICE)),
            F.when(given & ~is_set(order["patient_name"]), issue(*NO_PATIENT)),
        )
    ).cast(f"array<{ISSUE_TYPE}>")


def error_count(issues: Column) -> Column:
    return F.size(F.filter(issues, lambda i: i["severity"] == "Error"))


def worst_severity(issues: Column) -> Column:
    """The most serious severity among the issues, null without any."""
    return F.get(F.array(*map(F.lit, SEVERITIES)), F.array_max(F.transform(issues, lambda i: severity_rank(i["severity"]))).cast("int"))


def add_basic_validation(df: DataFrame, order: str, out: str = "validation") -> DataFrame:
    """The check that needs no model: is there a device, is there a patient."""
    found = F.col("_issues")
    score = F.greatest(F.lit(LOWEST_SCORE), 1.0 - F.size(found) * F.lit(PENALTY))
    return df.select("*", basic_issues(F.col(order)).alias("_issues")).select(
        *df.columns, verdict(error_count(found) == 0, score, found).alias(out)
    )


def clean_verdict() -> Column:
    """What the basic check says when it is given no order at all."""
    return verdict(F.lit(True), F.lit(1.0), F.array().cast(f"array<{ISSUE_TYPE}>"))


def read_severity(text: Column) -> Column:
    """A severity by name, in any case, or by its number; anything else is a warning."""
    named = F.lower(text)
    level = F
    for number, severity in enumerate(SEVERITIES):
        level = level.when(named.isin(severity.lower(), str(number)), F.lit(severity))
    return level.otherwise(F.lit(DEFAULT_SEVERITY))


def add_model_validation(
    df: DataFrame, response: str, out: str = "model_validation"
) -> DataFrame:
    """Parse a validation response; null where it cannot be used: not a JSON object, a
    verdict or score of the wrong kind, or an issue that is not an object."""
    texts = {"_verdict": (strip_fence(F.col(response)), VERDICT_KEYS)}
    told = F.col("_verdict")
    items = F.try_variant_get(told["issues"], "$", "array<variant>")
    usable = (
        told.isNotNull()
        & (told["is_valid"].isNull() | is_boolean(told["is_valid"]))
        & (told["validation_score"].isNull() | is_number(told["validation_score"]))
        & F.coalesce(F.forall(items, is_object), F.lit(True))
    )
    issues = F.transform(
        items,
        lambda item: F.struct(
            F.coalesce(trimmed_text(at(item, "$.field")), F.lit("")).alias("field"),
            F.coalesce(trimmed_text(at(item, "$.issue")), F.lit("")).alias("issue"),
            read_severity(trimmed_text(at(item, "$.severity"))).alias("severity"),
            trimmed_text(at(item, "$.suggested_fix")).alias("suggested_fix"),
        ),
    )
    none = F.array().cast(f"array<{ISSUE_TYPE}>")
    score = F.try_variant_get(told["validation_score"], "$", "double")
    return with_objects(df, texts).select(
        *df.columns,
        F.when(
            usable,
            verdict(
                F.coalesce(F.try_variant_get(told["is_valid"], "$", "boolean"), F.lit(False)),
                F.coalesce(score, F.lit(DEFAULT_SCORE)),
                F.coalesce(issues, none),
            ),
        ).alias(out),
    )


def validate(
    df: DataFrame,
    order: str,
    response: str | None = None,
    params: StagedParams = StagedParams(),
    out: str = "validation",
) -> DataFrame:
    """Model verdict where there is a usable one, else the basic check."""
    if response is None:
        return add_basic_validation(df, order, out)
    checked = add_model_validation(add_basic_validation(df, order, "_basic"), response, "_model")
    unreadable = F.col(response).isNotNull() & (params.on_bad_validation == "accept")
    chosen = (
        F.when(F.col("_model").isNotNull(), F.col("_model"))
        .when(unreadable, clean_verdict())
        .otherwise(F.col("_basic"))
    )
    return checked.select(*df.columns, chosen.alias(out))


def needs_correction(validation: str = "validation", params: StagedParams = StagedParams()) -> Column:
    """Below the score threshold, with something to correct."""
    column = F.col(validation)
    return (column["score"] < params.score_threshold) & (F.size(column["issues"]) > 0)


def chosen_correction(df: DataFrame, fixes: list[str], due: Column, params: StagedParams, out: str, text: str | None = None) -> DataFrame:
    """Add ``out``, the order of the last of the responses ``fixes`` that can be read, and
    ``text``, if named, that response; null unless ``due``. With ``on_bad_correction`` ``blank`` the
    last response counts, and the default record stands for one that can't be read."""
    texts = {f"_fix_{i}": (F.when(due, strip_fence(F.col(fix))), ORDER_COLUMNS) for i, fix in enumerate(fixes)}
    orders, taken = [], []
    for i, fix in enumerate(fixes):
        parsed = F.col(f"_fix_{i}")
        order = F.when(parsed.isNotNull(), order_from_object(parsed))
        if params.on_bad_correction == "blank":
            given = due & F.col(fix).isNotNull()
            orders.append(F.when(given, F.coalesce(order, blank_order())).cast(ORDER_TYPE))
            taken.append(F.when(given, F.col(fix)))
        else:
            orders.append(order.cast(ORDER_TYPE))
            taken.append(F.when(parsed.isNotNull(), F.col(fix)))
    shown = [F.coalesce(*reversed(orders)).alias(out)] + ([F.coalesce(*reversed(taken)).alias(text)] if text else [])
    return with_objects(df, texts).select(*df.columns, *shown)


def latest_corrections(
    corrections: DataFrame, params: StagedParams = StagedParams(), key: str = "note_id"
) -> DataFrame:
    """``(note_id, correction, n_passed_over)``: per note with attempts on record the last usable
    one among its first ``max_corrections``, counted from its least attempt, and how many
    attempts were not taken: unreadable ones, those without an answer, and those beyond the
    limit. One aggregate with buffers of a fixed size, which combines map-side."""
    n = params.max_corrections
    name = "correction"
    read = corrections.groupBy(key).agg(F.count("*").alias("_n"), *first_attempts(F.lit(True), n, name))
    fixes = [f"_text_{i}" for i in range(n)]
    texts = read.select(key, "_n", *[t.alias(f) for t, f in zip(ranked_attempts(n, name), fixes)])
    chosen = chosen_correction(texts, fixes, F.lit(True), params, "_order", "correction")
    return chosen.select(key, "correction", (F.col("_n") - F.col("correction").isNotNull().cast("int")).alias("n_passed_over"))


def apply_correction(
    df: DataFrame,
    order: str,
    fixes: list[str],
    params: StagedParams = StagedParams(),
    out: str = "final_order",
) -> DataFrame:
    """The corrected order where one was needed and is there, else the order as it was. Only
    responses of orders that need one are parsed."""
    if not params.self_correction or not fixes:
        return df.select("*", F.col(order).alias(out), F.lit(False).alias("was_corrected"))
    needed = F.coalesce(needs_correction(params=params), F.lit(False))
    fixed = chosen_correction(df.select("*", needed.alias("_needed")), fixes, F.col("_needed"), params, "_corrected")
    return fixed.select(
        *df.columns,
        F.coalesce("_corrected", order).alias(out),
        F.col("_corrected").isNotNull().alias("was_corrected"),
    )


def validation_rounds(
    df: DataFrame,
    order: str,
    due: Column,
    verdicts: list[str],
    fixes: list[str],
    params: StagedParams = StagedParams(),
    out: str = "final_order",
) -> DataFrame:
    """Check, correct, and check again, for the rows where ``due``: adds ``out``, ``was_corrected``,
    ``validation``, the last verdict, and ``rounds``, the number of verdicts.

    An order that scores too low is corrected by the next of ``fixes``; a corrected order has
    a verdict of its own, the next of ``verdicts`` or, where that is missing or unreadable, the basic
    check. A correction that can't be read leaves order and verdict as they are. It ends where a
    verdict is good enough or the corrections are used up, so with n corrections there are n + 1
    verdicts at most. Texts of rounds that a row doesn't reach are not parsed."""
    kept = df.columns
    state = df.select(
        "*", F.col(order).alias("_now"), F.coalesce(due, F.lit(False)).alias("_due"),
        F.lit(None).cast(VALIDATION_TYPE).alias("_verdict_now"), F.lit(0).alias("_rounds"), F.lit(False).alias("_was"),
    )
    told = F.array(*map(F.col, verdicts)) if verdicts else F.array(F.lit(None).cast("string"))
    for fix in [*(fixes if params.self_correction else []), None]:
        asked = state.select("*", F.when(F.col("_due"), F.get(told, F.col("_rounds"))).alias("_told"))
        checked = validate(asked, "_now", "_told", params, "_checked")
        verdict_now = F.when(F.col("_due"), F.col("_checked")).otherwise(F.col("_verdict_now"))
        state = checked.select(
            *kept, "_now", "_due", "_was", verdict_now.alias("_verdict_now"), (F.col("_rounds") + F.col("_due").cast("int")).alias("_rounds")
        )
        if fix is None:
            break
        needed = F.coalesce(needs_correction("_verdict_now", params), F.lit(False))
        fixed = chosen_correction(state.select("*", needed.alias("_needed")), [fix], F.col("_needed"), params, "_fixed")
        took = F.col("_fixed").isNotNull()
        state = fixed.select(
            *kept, F.coalesce("_fixed", "_now").alias("_now"), took.alias("_due"), (F.col("_was") | took).alias("_was"), "_verdict_now", "_rounds"
        )
    return state.select(
        *kept, F.col("_now").alias(out), F.col("_was").alias("was_corrected"), F.col("_verdict_now").alias("validation"), F.col("_rounds").alias("rounds")
    )


def confidence_gate(confidence: Column, params: StagedParams = StagedParams()) -> Column:
    """``accepted`` at or above the minimum confidence, else ``review``."""
    return F.when(confidence >= params.min_confidence, "accepted").otherwise("review")
