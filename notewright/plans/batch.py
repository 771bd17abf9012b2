"""A batch job: route each note, extract, report."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import fill
from ..operators.positions import with_position
from ..operators.validate import confidence_gate
from ..params import JobParams, StagedParams
from ..schema import or_blank
from ..sources.completions import attach_responses, response_column
from ..sources.notes import with_stem
from .prompts import SINGLE_PASS
from .staged import replay, with_rule_order, with_single_or_rules

PROCESSED_COLUMNS = ("note_id", "path", "file_name", "route", "order", "status", "error")


def choose_route(staged: Column, model: Column) -> Column:
    """Staged if switched on, else the single pass if there is a model, else rules."""
    return F.when(staged, "staged").when(model, "single").otherwise("rules")


def route_order(route: Column, staged: str, single: str, rule: str) -> Column:
    """The order of the chosen route, falling back to the next simpler one."""
    return (
        F.when(route == "staged", F.coalesce(F.col(staged), F.col(single), F.col(rule)))
        .when(route == "single", F.coalesce(F.col(single), F.col(rule)))
        .otherwise(F.col(rule))
    )


def process_notes(
    notes: DataFrame, job: JobParams = JobParams(), responses: DataFrame | None = None
) -> DataFrame:
    """Notes ``(note_id, path, text, status, error)`` to one row per note with its order.

    The route is a job setting, so the plan holds that route only. A note that could not
    be read keeps its row, with no order and the reason in ``error``."""
    if job.staged.enabled and responses is not None:
        route, df = "staged", replay(notes, responses, job)
    elif job.model.available and responses is not None:
        df = attach_responses(notes, responses, (SINGLE_PASS,))
        route, df = "single", with_single_or_rules(df, response_column(SINGLE_PASS), "order", job)
    else:
        route, df = "rules", with_rule_order(notes, "order", job.rules, job.device_rules)
    df = with_stem(df).withColumn("route", F.lit(route))
    order = F.when(F.col("status") == "ok", or_blank("order"))
    return df.withColumn("order", order).select(*PROCESSED_COLUMNS)


@dataclass(frozen=True)
class Batch:
    """A written batch: the table of processed notes, and what was counted while it was written."""

    table: DataFrame
    total: int
    processed: int
    failed: int
    elapsed_ms: int

    @property
    def notes_per_s(self) -> float | None:
        """Null where the clock shows no time."""
        return 1000 * self.total / self.elapsed_ms if self.elapsed_ms else None


def write_batch(
    notes: DataFrame, path: str, job: JobParams = JobParams(), responses: DataFrame | None = None, mode: str = "error"
) -> Batch:
    """Process ``notes`` into Parquet at ``path`` and count them on the way: the counts are taken of
    the rows as they go by, so nothing is read a second time. Tasks that are repeated count once."""
    counted = Observation(f"batch-{uuid.uuid4().hex}")
    ok = F.col("status") == "ok"
    processed = process_notes(notes, job, responses).observe(
        counted, F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("processed"), F.count_if(~ok).alias("failed")
    )
    start = time.monotonic()
    processed.write.mode(mode).parquet(path)
    elapsed = round(1000 * (time.monotonic() - start))
    told = counted.get
    table = notes.sparkSession.read.schema(processed.schema).parquet(path)
    return Batch(table, told["total"], told["processed"], told["failed"], elapsed)


def split_by_confidence(
    results: DataFrame, path: str, params: StagedParams = StagedParams(), mode: str = "error"
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, review)``: the results at or above the minimum confidence, and the others. They
    are computed once and written into a folder for each, and a table reads its own folder."""
    # what is no number is not enough confidence
    gated = results.withColumn("gate", confidence_gate(F.coalesce("confidence", F.lit(0.0)), params))
    gated.write.mode(mode).partitionBy("gate").parquet(path)
    written = results.sparkSession.read.schema(gated.schema).parquet(path)
    accepted, review = (written.filter(F.col("gate") == gate).drop("gate") for gate in ("accepted", "review"))
    return accepted, review


def presented(processed: DataFrame) -> DataFrame:
    """Processed notes with ``position``, their place in the order of their paths."""
    return with_position(processed, "path", "note_id")


def batch_lines(processed: DataFrame) -> DataFrame:
    """One report line per processed note. The line is made before the failed notes go, so
    that the filter reads it and repeats none of the parsing behind it."""
    line = fill(
        "%s → %s for %s",
        F.col("file_name"),
        F.col("order.device"),
        F.col("order.patient_name"),
    )
    made = F.explode_outer(F.array(F.when(F.col("status") == "ok", line)))
    return processed.select("note_id", "path", made.alias("line")).filter("line is not null")


def batch_summary(processed: DataFrame) -> DataFrame:
    """Notes in, processed and failed, over the whole batch."""
    ok = F.col("status") == "ok"
    return processed.agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("processed"),
        F.count_if(~ok).alias("failed"),
    )


def device_report(processed: DataFrame) -> DataFrame:
    """Processed notes per device. Failed notes are in the group without a device and count
    nothing; a filter on the count can't repeat the parsing."""
    return (
        processed.groupBy(F.col("order.device").alias("device"))
        .agg(F.count_if(F.col("status") == "ok").alias("notes"))
        .filter("notes > 0")
    )


def failed_inputs(inputs: DataFrame, processed: DataFrame, key: str = "path") -> DataFrame:
    """Inputs that yielded no order."""
    done = processed.groupBy(key).agg(F.max(F.col("status") == "ok").alias("_done"))
    marked = inputs.join(done, key, "left")
    return marked.filter(~F.coalesce("_done", F.lit(False))).select(*inputs.columns)
