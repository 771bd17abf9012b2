"""The four stages of staged extraction: response text to step, steps to result."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_fence
from ..functions.variants import (
    is_boolean,
    is_json,
    is_number,
    is_text,
    printed,
    shown,
    with_objects,
)
from .responses import ANSWER_KEYS


@dataclass(frozen=True)
class Stage:
    stage: str
    name: str
    role: str
    fields: tuple[str, ...]


# Stages in running order, their roles, and the fields each adds to its answer.
STAGES = (
    Stage(
        "document_analyzer",
        "Document Analysis Agent",
        "Analyze document structure and identify key sections",
        ("document_structure", "key_sections", "data_quality"),
    ),
    Stage(
        "primary_extractor",
        "Primary Extraction Agent",
        "Extract device order information with medical context",
        ("device_order", "extraction_certainty", "missing_fields"),
    ),
    Stage(
        "medical_validator",
        "Medical Validation Agent",
        "Validate medical accuracy and completeness",
        ("validation_issues", "completeness_score", "medical_flags"),
    ),
    Stage(
        "confidence_assessor",
        "Confidence Assessment Agent",
        "Assess extraction confidence and identify uncertainties",
        ("overall_confidence", "field_confidences", "uncertainty_areas"),
    ),
)
STAGE_BY_ID = {stage.stage: stage for stage in STAGES}
ANALYZER, EXTRACTOR, VALIDATOR, ASSESSOR = (stage.stage for stage in STAGES)
MODE_STAGES = {
    "Fast": (EXTRACTOR,),
    "Standard": tuple(STAGE_BY_ID),
    "Thorough": tuple(STAGE_BY_ID),
}

# Defaults of a step and of the run.
DEFAULT_CONFIDENCE = 0.8
DEFAULT_REASONING = "Agent reasoning not provided"
UNREADABLE_REASONING = "Response parsing failed"
UNREADABLE_CONFIDENCE = 0.3
FALLBACK_CONFIDENCE = 0.5
FALLBACK_REASONING = "OpenAI client not available, using fallback logic"
FALLBACK_OUTPUTS = (
    '{"reasoning":"Fallback execution - no AI analysis performed","confidence":0.5,'
    '"findings":"Limited analysis available without AI","tokens_used":0}'
)
EXTRACTOR_VERSION = "AgenticExtractor_v1.0"
FALLBACK_VERSION = "FallbackParser"
FALLBACK_AGENT = "fallback_parser"


STEP_KEYS = ("reasoning", "confidence", "tokens_used", "overall_confidence")


def number(v: Column) -> Column:
    """A number given as such or as text."""
    return shown(v).try_cast("double")


def add_steps(
    df: DataFrame, responses: dict[str, str], extractor: str, durations: dict[str, str] | None = None
) -> DataFrame:
    """For every ``stage: response column`` add ``step_<stage>``, the step struct,
    ``out_<stage>``, its outputs as variant, and ``ans_<stage>``, the answer's parsed keys.
    ``durations`` names the columns with the stages' milliseconds.

    No response, JSON that is not an object, or a confidence that is no number gives the
    fallback step; text that is not JSON is kept as findings at low confidence. Those have
    no parsed answer. All stages go through each projection together, so that the plan
    does not grow with their number."""
    kept = df.columns
    texts = df.select(
        "*", *[strip_fence(F.col(response)).alias(f"_text_{s}") for s, response in responses.items()]
    )
    parsed = with_objects(
        texts,
        {
            f"_object_{s}": (
                F.col(f"_text_{s}"),
                STEP_KEYS + (ANSWER_KEYS if s == extractor else ()),
            )
            for s in responses
        },
    )

    def state(s: str) -> Column:
        text, found = F.col(f"_text_{s}"), F.col(f"_object_{s}")
        told = found["confidence"]
        return (
            F.when(text.isNull(), "fallback")
            .when(
                found.isNotNull(),
                F.when(told.isNull() | number(told).isNotNull(), "ok").otherwise("fallback"),
            )
            .when(text.startswith("{"), "unreadable")
            .when(is_json(text), "fallback")
            .otherwise("unreadable")
        )

    states = parsed.select("*", *[state(s).alias(f"_state_{s}") for s in responses])

    def outputs(s: str) -> Column:
        level = F.col(f"_state_{s}")
        unreadable = F.to_json(
            F.struct(
                F.lit(UNREADABLE_REASONING).alias("reasoning"),
                F.lit(UNREADABLE_CONFIDENCE).alias("confidence"),
                F.col(responses[s]).alias("findings"),
                F.lit(0).alias("tokens_used"),
            )
        )
        return F.parse_json(
            F.when(level == "ok", F.col(f"_text_{s}"))
            .when(level == "unreadable", unreadable)
            .otherwise(FALLBACK_OUTPUTS)
        )

    answers = [
        F.when(F.col(f"_state_{s}") == "ok", F.col(f"_object_{s}")).alias(f"ans_{s}")
        for s in responses
    ]
    read = states.select(
        *kept,
        *[f"_state_{s}" for s in responses],
        *answers,
        *[outputs(s).alias(f"out_{s}") for s in responses],
    )

    def step(s: str) -> Column:
        level, answer = F.col(f"_state_{s}"), F.col(f"ans_{s}")
        reasoning = F.coalesce(printed(answer["reasoning"]), F.lit(DEFAULT_REASONING))
        confidence = F.coalesce(number(answer["confidence"]), F.lit(DEFAULT_CONFIDENCE))
        return F.struct(
            F.lit(s).alias("agent_name"),
            F.lit(STAGE_BY_ID[s].role).alias("action"),
            F.when(level == "ok", reasoning)
            .when(level == "unreadable", UNREADABLE_REASONING)
            .otherwise(FALLBACK_REASONING)
            .alias("reasoning"),
            F.when(level == "ok", confidence)
            .when(level == "unreadable", UNREADABLE_CONFIDENCE)
            .otherwise(FALLBACK_CONFIDENCE)
            .alias("confidence"),
            F.col(f"out_{s}").alias("outputs"),
            level.alias("state"),
            (F.col(durations[s]) if durations else F.lit(None)).cast("long").alias("duration_ms"),
        )

    return read.select(
        *kept,
        *[f"{part}_{s}" for s in responses for part in ("ans", "out")],
        *[step(s).alias(f"step_{s}") for s in responses],
    )


def tokens_used(answer: Column) -> Column:
    """Tokens a step reports: 0 if it says nothing, null if it says something that is no
    count. Halves round to even."""
    found = answer["tokens_used"]
    whole = F.when(F.trim(shown(found)).rlike(r"^[+-]?\d+$"), F.trim(shown(found)).try_cast("int"))
    return (
        F.when(found.isNull(), 0)
        .when(is_number(found), F.bround(number(found)).try_cast("int"))
        .when(is_text(found), whole)
        .when(is_boolean(found), F.when(shown(found) == "true", 1).otherwise(0))
    )


def overall_confidence(answer: Column) -> Column:
    """Confidence of the whole run, 0.8 if not given; null if given but no number."""
    found = answer["overall_confidence"]
    return F.when(found.isNull(), DEFAULT_CONFIDENCE).otherwise(number(found))
