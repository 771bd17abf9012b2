"""Request columns for a completion source: what to ask for which note."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fill
from ..operators.responses import merge_outputs
from ..operators.stages import ASSESSOR, EXTRACTOR, STAGE_BY_ID, VALIDATOR
from ..params import STAGE_TEMPERATURE_CAP, ModelParams, StagedParams

SINGLE_PASS, VALIDATION, CORRECTION = "single_pass", "validation", "correction"

SINGLE_SYSTEM = "You extract medical equipment orders from clinical notes."
STAGE_SYSTEM = "You are the %s step of a medical equipment order pipeline."

SINGLE_PROMPT = """Read this clinical note and answer with one JSON object.

Note:
%s

Keys, each left out if the note does not say: device, patient_name, dob, diagnosis,
ordering_provider, liters (oxygen flow such as "2 L"), usage, mask_type, qualifier, and
add_ons, an array naming every accessory or modification mentioned.
Answer with JSON only."""

# What each stage is asked to do.
STAGE_TASKS = {
    "document_analyzer": "Describe how the note is organised and where it speaks of "
    "equipment, the patient and the clinical background.",
    "primary_extractor": "Extract the equipment order as a JSON object under device_order "
    "with the keys device, ordering_provider, patient_name, dob (MM/DD/YYYY), diagnosis, "
    "mask_type, liters, usage, qualifier and add_ons, always an array.",
    "medical_validator": "Check the extracted order against the note and against usual "
    "medical practice.",
    "confidence_assessor": "Say how sure each extracted field and the order as a whole are.",
}

# Keys every stage answers with.
COMMON_FIELDS = ("reasoning", "confidence", "findings", "recommendations", "tokens_used")

STAGE_PROMPT = """%s

Document type: %s
Mode: %s
File: %s
%s
Note:
%s

Answer with one JSON object with the keys %s."""

VALIDATION_PROMPT = """Check this order against the note it was taken from.

Order:
%s

Note:
%s

Look at medical accuracy, missing fields, and whether the fields fit each other. Answer
with one JSON object with the keys is_valid (boolean), validation_score (0 to 1), issues
(array of objects with field, issue, severity, suggested_fix), field_confidences and
suggestions."""

CORRECTION_PROMPT = """Correct this order where the issues say it is wrong.

Order:
%s

Issues:
%s

Note:
%s

Answer with the whole order as one JSON object with the same keys."""


def request_parts(stage: str, system: str, prompt: Column, model: ModelParams) -> list[Column]:
    """The request columns for ``stage``."""
    temperature = model.temperature
    if stage != SINGLE_PASS:
        temperature = min(temperature, STAGE_TEMPERATURE_CAP)
    return [
        F.lit(stage).alias("stage"),
        F.lit(system).alias("system"),
        prompt.alias("prompt"),
        F.lit(model.model).alias("model"),
        F.lit(model.max_tokens).alias("max_tokens"),
        F.lit(temperature).alias("temperature"),
    ]


def all_requests(df: DataFrame, parts: list[list[Column]], keep: tuple[str, ...] = ("note_id",)) -> DataFrame:
    """The columns ``keep`` and a row a request for every row, so that several requests about a note are
    made from one pass over the notes."""
    return df.select(*keep, F.inline(F.array(*[F.struct(*columns) for columns in parts])))


def single_parts(model: ModelParams = ModelParams()) -> list[Column]:
    return request_parts(SINGLE_PASS, SINGLE_SYSTEM, fill(SINGLE_PROMPT, F.col("text")), model)


def single_request(notes: DataFrame, model: ModelParams = ModelParams()) -> DataFrame:
    """Add the request columns of the single pass."""
    return notes.select("*", *single_parts(model))


def quoted(text: Column) -> Column:
    """A text as a JSON string: what is between the brackets of an array that holds it alone."""
    array = F.to_json(F.array(text))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def previous_outputs(stage: str, available: tuple[str, ...]) -> Column | None:
    """What a stage is told of the ones before it: the extractor sees the analysis, the
    validator the extraction, the assessor extraction and validation merged. JSON with its keys in
    order, so that the same outputs make the same request."""
    if stage == ASSESSOR and {EXTRACTOR, VALIDATOR} <= set(available):
        merged = merge_outputs(F.col(f"out_{EXTRACTOR}"), F.col(f"out_{VALIDATOR}"))
        by_key = F.array_sort(
            F.map_entries(merged),
            lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0),
        )
        members = F.transform(by_key, lambda e: F.concat(quoted(e["key"]), F.lit(":"), F.to_json(e["value"])))
        return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))
    if stage == VALIDATOR and EXTRACTOR in available:
        return F.to_json(F.col(f"out_{EXTRACTOR}"))
    if stage == EXTRACTOR and available:
        return F.to_json(F.col(f"out_{available[-1]}"))
    return None


def stage_prompt(stage: str, staged: StagedParams, previous: Column | None) -> Column:
    earlier = F.lit("")
    if previous is not None:
        earlier = F.concat(F.lit("Earlier findings:\n"), previous, F.lit("\n"))
    keys = ", ".join(COMMON_FIELDS + STAGE_BY_ID[stage].fields)
    return fill(
        STAGE_PROMPT,
        F.lit(STAGE_TASKS[stage]),
        F.lit(staged.document_type),
        F.lit(staged.mode),
        F.col("path"),
        earlier,
        F.col("text"),
        F.lit(keys),
    )


def stage_parts(
    stage: str,
    model: ModelParams = ModelParams(),
    staged: StagedParams = StagedParams(),
    available: tuple[str, ...] = (),
) -> list[Column]:
    prompt = stage_prompt(stage, staged, previous_outputs(stage, available))
    return request_parts(stage, STAGE_SYSTEM % stage, prompt, model)


def stage_request(
    df: DataFrame,
    stage: str,
    model: ModelParams = ModelParams(),
    staged: StagedParams = StagedParams(),
    available: tuple[str, ...] = (),
) -> DataFrame:
    return df.select("*", *stage_parts(stage, model, staged, available))


def validation_parts(order: str, model: ModelParams = ModelParams()) -> list[Column]:
    prompt = fill(VALIDATION_PROMPT, F.to_json(order), F.col("text"))
    return request_parts(VALIDATION, STAGE_SYSTEM % VALIDATION, prompt, model)


def validation_request(df: DataFrame, order: str, model: ModelParams = ModelParams()) -> DataFrame:
    return df.select("*", *validation_parts(order, model))


def correction_parts(order: str, validation: str, model: ModelParams = ModelParams()) -> list[Column]:
    issues = F.to_json(F.col(validation)["issues"])
    prompt = fill(CORRECTION_PROMPT, F.to_json(order), issues, F.col("text"))
    return request_parts(CORRECTION, STAGE_SYSTEM % CORRECTION, prompt, model)


def correction_request(
    df: DataFrame, order: str, validation: str, model: ModelParams = ModelParams()
) -> DataFrame:
    return df.select("*", *correction_parts(order, validation, model))
