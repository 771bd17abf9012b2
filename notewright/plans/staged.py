"""Staged extraction: four answers per note, one order, a verdict, and one correction."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.extract import extract_orders
from ..operators.responses import parse_answer, parse_response
from ..operators.rules import DEVICE_RULES, DeviceRule
from ..operators.stages import (
    ASSESSOR,
    DEFAULT_CONFIDENCE,
    EXTRACTOR,
    EXTRACTOR_VERSION,
    FALLBACK_AGENT,
    FALLBACK_CONFIDENCE,
    FALLBACK_VERSION,
    MODE_STAGES,
    STAGES,
    add_steps,
    overall_confidence,
    tokens_used,
)
from ..operators.validate import (
    apply_correction,
    chosen_correction,
    needs_correction,
    validate,
    validation_rounds,
)
from ..params import JobParams, ModelParams, RuleParams, StagedParams
from ..schema import VALIDATION_TYPE, or_blank, pack_order
from ..session import materialize
from ..sources.completions import (
    REQUEST_COLUMNS,
    Completion,
    attach_responses,
    complete,
    duration_column,
    response_column,
)
from .prompts import (
    CORRECTION,
    SINGLE_PASS,
    VALIDATION,
    correction_request,
    single_request,
    stage_request,
    validation_request,
)

RESULT_COLUMNS = (
    "order",
    "confidence",
    "extractor_version",
    "tokens_used",
    "agents_used",
    "steps",
    "validation",
    "was_corrected",
    "rounds",
    "parse_state",
)


def stage_table(spark: SparkSession) -> DataFrame:
    """The stages as a table of four rows, for lookups by stage id."""
    rows = [(s.stage, i, s.name, s.role, ", ".join(s.fields)) for i, s in enumerate(STAGES)]
    return spark.createDataFrame(
        rows, "stage string, ordinal int, name string, role string, fields string"
    )


def with_rule_order(
    df: DataFrame,
    out: str = "rule_order",
    params: RuleParams = RuleParams(),
    rules: tuple[DeviceRule, ...] = DEVICE_RULES,
    text: str = "text",
) -> DataFrame:
    """Add the rule order of ``text`` as a struct."""
    kept = tuple(df.columns)
    orders = extract_orders(df, text, kept, params, rules)
    return orders.select(*kept, pack_order().alias(out))


def with_single_order(df: DataFrame, response: str, out: str = "single_order") -> DataFrame:
    """The single-pass model order, or the rule order where it gave none."""
    order = F.coalesce(F.col("_single"), F.col("rule_order"))
    return parse_response(df, response, "_single").select(*df.columns, order.alias(out))


def with_single_or_rules(df: DataFrame, response: str, out: str, job: JobParams, text: str = "text") -> DataFrame:
    """The single-pass model order as ``out``, or else the rule order: of the note, or of an answer
    that is there and can't be read if ``on_bad_response`` says so."""
    kept, read = df.columns, parse_response(df, response, "_single")
    source = F.col(text)
    if job.model.on_bad_response == "response":
        source = F.when(F.col("_single").isNull() & F.col(response).isNotNull(), F.col(response)).otherwise(source)
    ruled = with_rule_order(read.withColumn("_rule_text", source), "_ruled", job.rules, job.device_rules, "_rule_text")
    return ruled.select(*kept, F.coalesce("_single", "_ruled").alias(out))


def run_totals(stages: tuple[str, ...]) -> tuple[Column, Column]:
    """Tokens and confidence of a run of ``stages``, each null where it cannot be read."""
    tokens = reduce(Column.__add__, [tokens_used(F.col(f"ans_{s}")) for s in stages])
    confidence = overall_confidence(F.col(f"ans_{ASSESSOR}")) if ASSESSOR in stages else F.lit(DEFAULT_CONFIDENCE)
    return tokens, confidence


def run_failed(tokens: Column, confidence: Column, state: Column, params: StagedParams) -> Column:
    """A confidence or token count that cannot be read fails the whole run of that note; no
    usable extractor answer does so too unless ``on_model_failure`` is ``unknown``."""
    failed = confidence.isNull() | tokens.isNull()
    return failed | (state == "fallback") if params.on_model_failure == "rules" else failed


def run_stages(df: DataFrame, params: StagedParams) -> DataFrame:
    """Response columns to ``steps``, the extractor's order and the run's confidence."""
    stages = MODE_STAGES[params.mode]
    timed = {s: duration_column(s) for s in stages}
    timed = timed if set(timed.values()) <= set(df.columns) else None
    stepped = add_steps(df, {s: response_column(s) for s in stages}, EXTRACTOR, timed)
    parsed = parse_answer(stepped, f"ans_{EXTRACTOR}", "staged_order")
    tokens, confidence = run_totals(stages)
    return parsed.select(
        *df.columns,
        "staged_order",
        "parse_state",
        F.array(*[F.col(f"step_{s}") for s in stages]).alias("steps"),
        F.col(f"step_{EXTRACTOR}")["state"].alias("_extractor_state"),
        tokens.alias("_tokens"),
        confidence.alias("_confidence"),
    )


def settle(df: DataFrame, params: StagedParams) -> DataFrame:
    """Decide per note whether the staged order holds or the note falls back."""
    failed = run_failed(F.col("_tokens"), F.col("_confidence"), F.col("_extractor_state"), params)
    back = F.col("_fell_back")
    agents = F.array(*[F.lit(stage) for stage in MODE_STAGES[params.mode]])
    kept = [c for c in df.columns if c not in ("_tokens", "_confidence", "_extractor_state")]
    return df.select("*", failed.alias("_fell_back")).select(
        *kept,
        back,
        F.when(back, FALLBACK_CONFIDENCE).otherwise(F.col("_confidence")).alias("confidence"),
        F.when(back, FALLBACK_VERSION).otherwise(EXTRACTOR_VERSION).alias("extractor_version"),
        F.when(back, 0).otherwise(F.col("_tokens")).alias("tokens_used"),
        F.when(back, F.array(F.lit(FALLBACK_AGENT))).otherwise(agents).alias("agents_used"),
    )


def with_fallback(df: DataFrame, job: JobParams, single_response: str | None) -> DataFrame:
    """Settled notes with ``_order``: for a note that fell back the single-pass order, else
    the rule order. Both read a text that is null for every other note, so that only notes
    that need them pay for them."""
    back, kept = F.col("_fell_back"), df.columns
    needed = df.select("*", F.when(back, F.col("text")).alias("_back_text"))
    if single_response is None:
        needed = with_rule_order(needed, "_back_order", job.rules, job.device_rules, "_back_text")
    else:
        given = needed.withColumn("_back_response", F.when(back, F.col(single_response)))
        needed = with_single_or_rules(given, "_back_response", "_back_order", job, "_back_text")
    order = F.when(back, F.col("_back_order")).otherwise(F.col("staged_order"))
    return needed.select(*kept, order.alias("_order"))


def run_metadata(df: DataFrame, job: JobParams, run_id: str) -> list[Column]:
    """What a result tells of its run. The time is that of all attempts on record, null where the log
    has none; a note that fell back has no further map, as no stages ran to an end for it."""
    staged = job.staged
    spent = [F.col(c) for c in df.columns if c.startswith(duration_column(""))]
    total = reduce(Column.__add__, [F.coalesce(c, F.lit(0)) for c in spent]) if spent else F.lit(None)
    more = F.create_map(
        F.lit("ExtractionMode"), F.lit(staged.mode), F.lit("RequiredValidation"), F.lit(str(staged.require_validation)),
        F.lit("ProcessingTimestamp"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    )
    return [
        F.lit(run_id).alias("run_id"),
        F.current_timestamp().alias("processed_at"),
        total.cast("long").alias("duration_ms"),
        F.when(~F.col("_fell_back"), more).alias("additional"),
        F.lit(len(MODE_STAGES[staged.mode])).alias("n_steps"),
    ]


def staged_extract(
    df: DataFrame,
    job: JobParams = JobParams(),
    single_response: str | None = None,
    verdicts: list[str] | None = None,
    fixes: list[str] | None = None,
) -> DataFrame:
    """Notes with ``resp_<stage>`` columns to the result columns. ``verdicts`` and ``fixes`` name
    the columns of the validation and correction responses, in the order of asking.

    Everything from here on is a projection: the only shuffle of a replayed run is the one
    that brought the responses to the notes."""
    params, verdicts, fixes = job.staged, verdicts or [], fixes or []
    result = with_fallback(settle(run_stages(df, params), params), job, single_response)
    # a note that fell back is not validated: its order did not come from the stages
    stands = ~F.col("_fell_back")
    if not params.require_validation:
        result = result.select(
            "*", F.lit(None).cast(VALIDATION_TYPE).alias("validation"), F.col("_order").alias("_final"),
            F.lit(False).alias("was_corrected"), F.lit(0).alias("rounds"),
        )
    elif params.mode == "Thorough":
        result = validation_rounds(result, "_order", stands, verdicts, fixes, params, "_final")
    else:
        result = validate(result, "_order", verdicts[-1] if verdicts else None, params, "_checked")
        result = result.select("*", F.when(stands, F.col("_checked")).alias("validation"), stands.cast("int").alias("rounds"))
        result = apply_correction(result, "_order", fixes, params, "_final")
    told = run_metadata(df, job, job.run_id or uuid.uuid4().hex)
    return result.select(*df.columns, or_blank("_final").alias("order"), *RESULT_COLUMNS[1:], *told)


def asked_for(params: StagedParams) -> tuple[tuple[str, ...], dict[str, int], list[str], list[str]]:
    """Stages whose responses a run reads, how many attempts of which count one by one, and the
    columns of its verdicts and corrections."""
    stages, ranked = MODE_STAGES[params.mode] + (SINGLE_PASS, VALIDATION, CORRECTION), {}
    verdicts, fixes = [response_column(VALIDATION)], []
    if params.max_corrections > 0:
        ranked[CORRECTION] = params.max_corrections
        fixes = [response_column(CORRECTION, i) for i in range(1, params.max_corrections + 1)]
    else:
        stages = stages[:-1]
    if params.mode == "Thorough":
        ranked[VALIDATION] = params.max_corrections + 1
        verdicts = [response_column(VALIDATION, i) for i in range(1, params.max_corrections + 2)]
    return stages, ranked, verdicts, fixes


def replay(notes: DataFrame, responses: DataFrame, job: JobParams = JobParams()) -> DataFrame:
    """Staged extraction from a table of past responses ``(note_id, stage, attempt,
    response)``; single-pass, validation and correction answers are in the same table
    under their stage names, so that one join brings everything. In ``Thorough`` mode the
    attempts at validation are the verdicts of one round after the other."""
    stages, ranked, verdicts, fixes = asked_for(job.staged)
    df = attach_responses(notes, responses, stages, ranked)
    result = staged_extract(df, job, response_column(SINGLE_PASS), verdicts, fixes)
    made = [c for c in result.columns if c not in df.columns]
    return result.select(*notes.columns, *made)


def replay_modes(
    notes: DataFrame, responses: DataFrame, modes: tuple[str, ...], job: JobParams = JobParams()
) -> DataFrame:
    """``(note_id, mode, order)``: the unvalidated order of every note in each mode. The responses
    are attached and read once: the extractor's order and the one to fall back on are the same in
    every mode, and a mode only says, by the stages that it asks, whether a note falls back."""
    stages = tuple(dict.fromkeys(s for mode in modes for s in MODE_STAGES[mode]))
    df = attach_responses(notes, responses, (*stages, SINGLE_PASS))
    stepped = add_steps(df, {s: response_column(s) for s in stages}, EXTRACTOR)
    parsed = parse_answer(stepped, f"ans_{EXTRACTOR}", "staged_order")
    state = F.col(f"step_{EXTRACTOR}")["state"]
    backs = [run_failed(*run_totals(MODE_STAGES[m]), state, job.staged).alias(f"_back_{m}") for m in modes]
    read = parsed.select(*df.columns, "staged_order", *backs)
    back = {m: F.col(f"_back_{m}") for m in modes}
    settled = read.withColumn("_fell_back", reduce(Column.__or__, back.values()))
    fallen = with_fallback(settled, job, response_column(SINGLE_PASS))
    orders = {m: or_blank(F.when(back[m], F.col("_order")).otherwise(F.col("staged_order"))) for m in modes}
    found = [F.struct(F.lit(m).alias("mode"), order.alias("order")) for m, order in orders.items()]
    return fallen.select("note_id", F.inline(F.array(*found)))


class Log:
    """What a live run has asked so far: written tables ``(note_id, stage, attempt, response,
    error, duration_ms)``, without the notes' texts."""

    def __init__(self, completion: Completion, model: ModelParams):
        self.completion, self.model, self.parts = completion, model, []

    def ask(self, requests: DataFrame, stage: str, attempt: Column | int) -> DataFrame:
        """Put a request for every row and keep the answers; a lost executor repeats no request of a
        table that is written."""
        number = (attempt if isinstance(attempt, Column) else F.lit(attempt)).cast("int")
        asked = requests.select("note_id", number.alias("attempt"), *REQUEST_COLUMNS)
        told = complete(asked, self.completion, "response", error="error", duration="duration_ms")
        self.parts.append(materialize(told, f"{stage}-answers"))
        return self.parts[-1]

    def table(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)


def run_live(
    notes: DataFrame, completion: Completion, job: JobParams = JobParams()
) -> DataFrame:
    """Staged extraction that asks ``completion`` as it goes.

    The answers of each stage are written to the shared folder before the next stage reads
    them, as rows of a log without the notes' texts, so that a lost executor never causes a
    second round of requests for finished stages; the result is the replay of that log.
    Notes whose stages fail are asked about in a single pass, and only where that gives
    nothing do the rules stand in. An order that fails the check is asked about again, at
    most ``max_corrections`` times: until an answer can be read, and in ``Thorough`` mode until
    the corrected order passes a check of its own. Each round takes the notes that the one
    before left over. ``model_errors`` names the exception of each failed request."""
    model, staged = job.model, job.staged
    log, done = Log(completion, model), ()
    for stage in MODE_STAGES[staged.mode]:
        df = notes
        if done:
            attached = attach_responses(notes, log.table(), done)
            df = add_steps(attached, {s: response_column(s) for s in done}, EXTRACTOR).select(*notes.columns, *[f"out_{s}" for s in done])
        log.ask(stage_request(df, stage, model, staged, done), stage, 1)
        done = (*done, stage)
    # written first, so that the filter reads a flag and does not repeat the work behind it
    settled = settle(run_stages(attach_responses(notes, log.table(), done), staged), staged)
    settled = materialize(settled.select("note_id", "path", "text", "_fell_back", "staged_order"), "settled")
    log.ask(single_request(settled.filter("_fell_back"), model), SINGLE_PASS, 1)
    if staged.require_validation:
        check_live(settled.filter("NOT _fell_back"), log, job)
    told = log.table()
    failed = F.map_from_entries(F.collect_list(F.struct("stage", "error")))
    # a row a failed stage of a note, so a few a note
    errors = told.groupBy("note_id", "stage").agg(F.max_by("error", "attempt").alias("error")).filter("error IS NOT NULL")
    errors = errors.groupBy("note_id").agg(failed.alias("model_errors"))
    none = F.create_map().cast("map<string,string>")
    result = replay(notes, told.drop("error"), job).join(errors, "note_id", "left")
    return result.withColumn("model_errors", F.coalesce("model_errors", none))


PENDING = ("note_id", "path", "text", "_draft", "_rounds", "validation")


def check_live(settled: DataFrame, log: Log, job: JobParams) -> None:
    """Verdicts and corrections of the notes whose stages gave an order, round by round. What is
    pending, the notes whose order scored too low, with that order and verdict, shrinks from one
    round to the next."""
    model, staged = job.model, job.staged
    drafts = settled.select("note_id", "path", "text", F.col("staged_order").alias("_draft"), F.lit(0).alias("_rounds"))
    waiting: list[DataFrame] = []
    for number in range(1, staged.max_corrections + 2):
        if drafts is not None:
            told = log.ask(validation_request(drafts, "_draft", model), VALIDATION, F.col("_rounds") + 1)
            asked = drafts.drop("validation").join(told.select("note_id", "response"), "note_id", "left")
            checked = validate(asked.withColumn("_rounds", F.col("_rounds") + 1), "_draft", "response", staged)
            waiting = [*waiting, checked.select(*PENDING)]
        verdicts = reduce(DataFrame.unionByName, waiting)
        verdicts = materialize(verdicts.withColumn("_needed", needs_correction(params=staged)), f"verdicts-{number}")
        pending = verdicts.filter("_needed")
        if number > staged.max_corrections or not staged.self_correction or pending.isEmpty():
            return
        answers = log.ask(correction_request(pending, "_draft", "validation", model), CORRECTION, number)
        answered = pending.join(answers.select("note_id", "response"), "note_id", "left")
        fixed = materialize(chosen_correction(answered, ["response"], F.lit(True), staged, "_fixed"), f"corrected-{number}")
        waiting = [fixed.filter("_fixed IS NULL").select(*PENDING)]
        # without further rounds an order that was corrected is done
        changed = fixed.filter("_fixed IS NOT NULL").withColumn("_draft", F.col("_fixed")).select(*PENDING)
        drafts = changed if staged.mode == "Thorough" else None


def run_single(notes: DataFrame, completion: Completion, model: ModelParams = ModelParams()) -> DataFrame:
    """Single-pass extraction that asks ``completion``; rules where it gives nothing."""
    answered = complete(
        single_request(notes, model), completion, response_column(SINGLE_PASS)
    ).drop("stage")
    job = JobParams(model=model)
    return with_single_or_rules(materialize(answered, "single"), response_column(SINGLE_PASS), "order", job)
