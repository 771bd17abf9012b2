"""One query per operator, each over whole tables: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.text import strip_fence
from notewright.functions.variants import with_objects
from notewright.operators.deliver import (
    is_retryable,
    planned_delays,
    post_orders,
    posting_skipped,
    reduce_attempts,
    undelivered,
)
from notewright.operators.extract import extract_orders
from notewright.operators.quality import (
    accuracy,
    all_rows,
    compare_columns,
    compare_orders,
    consistency,
    consistency_markers,
    field_count,
    field_set,
    fill_rates,
    presence_flags,
    timing_stats,
)
from notewright.operators.responses import (
    findings_order,
    findings_readable,
    merge_outputs,
    parse_answer,
    parse_response,
)
from notewright.operators.rules import DEVICE_RULES, DeviceRule, rule_hits
from notewright.operators.shape import add_payload, output_json, write_orders
from notewright.operators.stages import ANALYZER, EXTRACTOR, STAGES, VALIDATOR, add_steps
from notewright.operators.synth import pick, random_orders
from notewright.operators.validate import (
    add_basic_validation,
    add_model_validation,
    confidence_gate,
    error_count,
    latest_corrections,
    worst_severity,
)
from notewright.params import MODES, JobParams, ModelParams, PostParams, RuleParams, StagedParams
from notewright.plans.batch import (
    batch_lines,
    choose_route,
    device_report,
    failed_inputs,
    presented,
    process_notes,
    route_order,
    split_by_confidence,
    write_batch,
)
from notewright.plans.prompts import (
    CORRECTION,
    SINGLE_PASS,
    VALIDATION,
    all_requests,
    correction_parts,
    single_parts,
    stage_parts,
    validation_parts,
)
from notewright.plans.staged import replay, replay_modes, stage_table, with_rule_order, with_single_order
from notewright.schema import ORDER_COLUMNS
from notewright.session import configure, materialize, run_dir
from notewright.sources.completions import attach_responses, response_column
from notewright.sinks.orders_api import post_to_report
from notewright.sources.notes import notes_from_table, open_envelopes, read_notes
from notewright.streaming.notes import once_per_note, order_stream, stream_files, write_stream

from .tables import (
    VERDICT_ROUNDS,
    attempt_log,
    clean_notes,
    delivered_again,
    extractor_response,
    messy_notes,
    patient_rows,
    shifted_attempts,
    single_response,
    stage_responses,
    table,
    timed_responses,
    validation_response,
    write_files,
)


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark, plan=False)
    return patient_rows(table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer"))


def note_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids alone, for queries that draw all the rest from them: no join."""
    configure(spark, plan=False)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("note_id"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy_notes(patients(spark, sf_dir))


def listed(name: str = "add_ons") -> Column:
    return F.array_join(name, "; ").alias("add_ons")


def flat_order(order: str) -> list:
    """Order columns with the list as text, so that rows compare as plain values."""
    return [
        listed(f"{order}.add_ons") if name == "add_ons" else F.col(f"{order}.{name}").alias(name)
        for name in ORDER_COLUMNS
    ]


def flat_columns() -> list:
    return [listed() if name == "add_ons" else F.col(name) for name in ORDER_COLUMNS]


# --- notes and rules -------------------------------------------------------------------


def notes_render(spark, sf_dir):
    rendered = clean_notes(patients(spark, sf_dir))
    return rendered.select("note_id", "text", *flat_order("expected"))


def random_order_draws(spark, sf_dir):
    drawn = random_orders(patients(spark, sf_dir), "note_id")
    return drawn.select("note_id", "device", "liters", "usage")


def device_classify(spark, sf_dir):
    return extract_orders(notes(spark, sf_dir)).select("note_id", "device")


def device_classify_words(spark, sf_dir):
    params = RuleParams(word_boundary=True)
    return extract_orders(notes(spark, sf_dir), params=params).select("note_id", "device")


def rule_hit_list(spark, sf_dir):
    hits = rule_hits(F.lower("text"))
    return notes(spark, sf_dir).select("note_id", F.array_join(hits, "; ").alias("hits"))


EXTRA_RULE = DeviceRule("Portable Widget", ("portable widget",))


def caller_rules(spark, sf_dir):
    """A whole batch with a device rule of the caller's before the usual ones."""
    job = JobParams(device_rules=(EXTRA_RULE, *DEVICE_RULES))
    done = process_notes(notes(spark, sf_dir), job)
    return done.select("note_id", "route", F.col("order.device").alias("device"))


def header_fields(spark, sf_dir):
    found = extract_orders(notes(spark, sf_dir))
    return found.select("note_id", "patient_name", "dob", "diagnosis")


def header_fields_same_line(spark, sf_dir):
    found = extract_orders(notes(spark, sf_dir), params=RuleParams(same_line=True))
    return found.select("note_id", "patient_name", "dob", "diagnosis")


def provider(spark, sf_dir):
    return extract_orders(notes(spark, sf_dir)).select("note_id", "ordering_provider")


def cpap_details(spark, sf_dir):
    found = extract_orders(notes(spark, sf_dir))
    return found.select("note_id", "device", "mask_type", listed(), "qualifier")


def oxygen_details(spark, sf_dir):
    found = extract_orders(notes(spark, sf_dir))
    return found.select("note_id", "device", "liters", "usage")


def orders_extract(spark, sf_dir):
    return extract_orders(notes(spark, sf_dir)).select("note_id", *flat_columns())


def device_counts(spark, sf_dir):
    found = extract_orders(notes(spark, sf_dir))
    return found.groupBy("device").agg(F.count("*").alias("notes"))


def documents_extract(spark, sf_dir):
    docs = notes_from_table(table(spark, sf_dir, "documents"), "doc_id", "text")
    return extract_orders(docs).select("note_id", *flat_columns())


def conversations_extract(spark, sf_dir):
    key = F.concat_ws("-", "conv_id", "turn")
    turns = table(spark, sf_dir, "conversations").select(key.alias("key"), "text")
    return extract_orders(notes_from_table(turns, "key", "text")).select(
        "note_id", *flat_columns()
    )


def pages_extract(spark, sf_dir):
    pages = notes_from_table(table(spark, sf_dir, "pages"), "page_id", "html")
    return extract_orders(pages).select("note_id", *flat_columns())


# --- files and envelopes ---------------------------------------------------------------

ENVELOPE_KINDS = 11


def envelope_files(docs: DataFrame) -> DataFrame:
    """Documents as files of eleven kinds: each envelope key, and each way one can fail."""
    kind = pick(F.col("doc_id"), "envelope", ENVELOPE_KINDS)
    whole = {
        key: F.to_json(F.struct(F.col("text").alias(key)))
        for key in ("note", "physician_note", "text", "content", "data")
    }
    doc = F.col("doc_id").cast("string")
    raw = (
        F.when(kind == 0, whole["note"])
        .when(kind == 1, whole["physician_note"])
        .when(kind == 2, whole["text"])
        .when(kind == 3, whole["content"])
        .when(kind == 4, F.concat(F.lit('{"data":"'), doc, F.lit('"}')))
        .when(kind == 5, F.concat(F.lit('{"note":null,"text":"'), doc, F.lit('"}')))
        .when(kind == 6, F.concat(F.lit('{"note":'), doc, F.lit("}")))
        .when(kind == 7, F.concat(F.lit("["), doc, F.lit("]")))
        .when(kind == 8, F.concat(F.lit('{"text":"T'), doc, F.lit('","note":"N'), doc, F.lit('"}')))
        .otherwise(F.col("text"))
    )
    name = F.when(kind == 9, ".txt").when(kind == 1, ".JSON").otherwise(".json")
    path = F.concat(F.lit("in/doc_"), doc, name)
    return docs.select(doc.alias("note_id"), path.alias("path"), raw.alias("raw"))


def envelope_unwrap(spark, sf_dir):
    configure(spark, plan=False)
    opened = open_envelopes(envelope_files(table(spark, sf_dir, "documents")))
    return opened.select("note_id", "path", "text", "status", "error")


def failed_input_files(spark, sf_dir):
    configure(spark, plan=False)
    files = envelope_files(table(spark, sf_dir, "documents"))
    processed = process_notes(open_envelopes(files))
    return failed_inputs(files.select("path"), processed)


FILES_A_FOLDER = 1000


def file_ingest(spark, sf_dir):
    """One file per supplier, written and read back: every second as a JSON envelope."""
    configure(spark)
    suppliers = table(spark, sf_dir, "supplier")
    sentence = F.format_string(
        "Patient Name: %s\nPatient requires oxygen tank with %d L flow rate for sleep.",
        "s_name",
        F.pmod(F.col("s_suppkey"), F.lit(9)) + 1,
    )
    folder = run_dir(spark, "ingest")
    even = F.pmod(F.col("s_suppkey"), F.lit(2)) == 0
    # numbered as read, so that a task that is repeated writes the same files again
    rows = suppliers.select(sentence.alias("note"), even.alias("even"), F.monotonically_increasing_id().alias("n"))
    form = F.when(F.col("even"), "txt").otherwise("json")
    content = F.when(F.col("even"), F.col("note")).otherwise(F.to_json(F.struct("note")))
    # a file a note is what is tested; they stand in folders of a thousand, written by all cores
    path = F.format_string(f"{folder}/%s-%d/%d.%s", form, F.floor(F.col("n") / FILES_A_FOLDER), "n", form)
    files = rows.filter("even IS NOT NULL").select("n", path.alias("path"), F.concat(content, F.lit("\n")).alias("content"))
    dealt = files.repartition(4 * spark.sparkContext.defaultParallelism, "n")
    materialize(write_files(dealt), "ingest-files")
    read = read_notes(spark, f"{folder}/*")
    found = extract_orders(read, keep=("path", "status"))
    key = F.regexp_extract("patient_name", r"(\d+)$", 1).cast("bigint")
    return found.select(
        key.alias("s_suppkey"), "status", "device", "liters", "usage", "patient_name"
    )


def stream_extract(spark, sf_dir):
    """Orders as a file stream joined to customers, through to a committed output table."""
    configure(spark, plan=False)
    schema = table(spark, sf_dir, "orders").schema
    arriving = (
        spark.readStream.schema(schema)
        # a pattern, as a stream takes no single file; it also fits a folder of part files
        .parquet(f"{sf_dir}/[o]rders.parquet")
    )
    rows = patient_rows(arriving, table(spark, sf_dir, "customer"))
    folder = run_dir(spark, "stream")
    stream = order_stream(messy_notes(rows))
    write_stream(stream, f"{folder}/orders", f"{folder}/progress").awaitTermination()
    written = spark.read.schema(stream.schema).parquet(f"{folder}/orders")
    return written.select("note_id", "file_name", "status", *flat_columns())


def empty_inputs(spark, sf_dir):
    """One file per supplier, every fifth of them empty, arriving as a stream."""
    configure(spark)
    suppliers, folder = table(spark, sf_dir, "supplier"), run_dir(spark, "arriving")
    note = F.format_string("Patient Name: %s\nPatient requires walker.", "s_name")
    path = F.concat(F.lit(f"{folder}/in/"), F.col("s_suppkey").cast("string"), F.lit(".txt"))
    content = F.when(F.pmod(F.col("s_suppkey"), F.lit(5)) == 0, "").otherwise(note)
    materialize(write_files(suppliers.select(path.alias("path"), content.alias("content"))), "arriving-files")
    stream = order_stream(stream_files(spark, f"{folder}/in"))
    write_stream(stream, f"{folder}/orders", f"{folder}/progress").awaitTermination()
    written = spark.read.schema(stream.schema).parquet(f"{folder}/orders")
    return written.select(F.col("file_name").cast("bigint").alias("s_suppkey"), "status", "device", "patient_name")


DELIVERY_DELAY = "2 hours"


def stream_once(spark, sf_dir):
    """Events as notes that arrive in two deliveries, the second with repeats, new notes and one that
    is too late, through a stream that is stopped between them and keeps its state."""
    configure(spark, plan=False)
    events, folder = table(spark, sf_dir, "events"), run_dir(spark, "deliveries")
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    newest = events.agg(F.max("ts")).first()[0]
    first = events.select(F.col("event_id").cast("string").alias("note_id"), "ts", F.lit(1).alias("delivery"))
    for delivery in (first, delivered_again(events, newest)):
        delivery.write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(first.schema).parquet(f"{folder}/in")
        write_stream(once_per_note(arriving, "ts", DELIVERY_DELAY), f"{folder}/once", f"{folder}/progress").awaitTermination()
    once = spark.read.schema(first.schema).parquet(f"{folder}/once")
    return once.select("note_id", F.unix_micros("ts").alias("ts_us"), "delivery")


# --- published and posted orders -------------------------------------------------------


def output_json_lines(spark, sf_dir):
    found = extract_orders(notes(spark, sf_dir))
    return found.select("note_id", output_json().alias("json"))


def output_written(spark, sf_dir):
    """Published orders as they stand in the written files."""
    folder = run_dir(spark, "published")
    write_orders(extract_orders(notes(spark, sf_dir)), folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


def payloads(spark, sf_dir):
    """Posted form of loosely read orders, where empty strings occur and are kept."""
    answers = with_objects(
        clean_notes(patients(spark, sf_dir)),
        {"_answer": (strip_fence(single_response()), ORDER_COLUMNS)},
    )
    fields = [
        F.try_variant_get(F.col("_answer")["liters"], "$", "string").alias("liters"),
        F.lit("").alias("qualifier"),
        *[F.col(f"expected.{n}").alias(n) for n in ORDER_COLUMNS if n not in ("liters", "qualifier")],
    ]
    return add_payload(answers.select("note_id", *fields)).select(
        "note_id", "payload", F.col("payload_chars").cast("bigint").alias("payload_chars")
    )


def retry_plan(spark, sf_dir):
    rows = note_ids(spark, sf_dir).select(
        "note_id", pick(F.col("note_id"), "retries", 6).cast("int").alias("retries")
    )
    delays = planned_delays(F.col("retries"))
    total = F.aggregate(delays, F.lit(0.0), lambda a, b: a + b)
    return rows.select("note_id", "retries", F.size(delays).alias("waits"), total.alias("total_s"))


def retryable_statuses(spark, sf_dir):
    log = attempt_log(table(spark, sf_dir, "orders"))
    return log.groupBy("status").agg(
        F.count("*").alias("attempts"),
        F.count_if(is_retryable(F.col("status"))).alias("retryable"),
    )


def delivery_outcomes(spark, sf_dir):
    return reduce_attempts(attempt_log(table(spark, sf_dir, "orders")))


def posting_gate(spark, sf_dir):
    draw = F.col("note_id")
    rows = note_ids(spark, sf_dir).select(
        "note_id",
        F.element_at(
            F.array(
                F.lit("https://orders.example.org"),
                F.lit("https://alert-api.com"),
                F.lit("http://test-api.com/v1"),
            ),
            (pick(draw, "host", 3) + 1).cast("int"),
        ).alias("base_url"),
        (pick(draw, "posting", 4) > 0).alias("enabled"),
    )
    skipped = posting_skipped(F.col("base_url"), F.col("enabled"))
    return rows.select("note_id", F.when(skipped, "skipped").otherwise("post").alias("gate"))


def scripted_transport():
    """A transport that answers from the payload alone: the status digits the order's
    qualifier carries, one per attempt."""

    def answer(payload: str, key: str, attempt: int):
        import json

        script = json.loads(payload)["qualifier"].split(",")
        status = script[min(attempt, len(script) - 1)]
        return int(status) if status else None

    return answer


SCRIPTS = ("200", "503,503,201", "404", ",500,200", "503", "429,400")
REACHABLE = PostParams(base_url="https://orders.example.org")


def scripted_orders(spark, sf_dir) -> DataFrame:
    script = F.element_at(
        F.array(*[F.lit(x) for x in SCRIPTS]),
        (pick(F.col("note_id"), "script", len(SCRIPTS)) + 1).cast("int"),
    )
    return add_payload(extract_orders(notes(spark, sf_dir)).withColumn("qualifier", script))


REPORT = ("note_id", "outcome", "attempts", "last_status", "backoff_s")


def post_report(spark, sf_dir):
    report = post_orders(scripted_orders(spark, sf_dir), scripted_transport(), REACHABLE, wait=lambda s: None)
    return report.select(*REPORT)


def post_sink(spark, sf_dir):
    """The same orders through the sink, and the report that it leaves."""
    folder = run_dir(spark, "posted")
    report = post_to_report(scripted_orders(spark, sf_dir), folder, scripted_transport(), REACHABLE, lambda s: None)
    return report.select(*REPORT)


def repost_pending(spark, sf_dir):
    """A re-run after a report that has settled the orders of every other draw."""
    ready = add_payload(extract_orders(notes(spark, sf_dir)))
    outcome = F.element_at(
        F.array(F.lit("delivered"), F.lit("exhausted"), F.lit("permanent_failure")),
        (pick(F.col("note_id"), "settled", 3) + 1).cast("int"),
    )
    report = materialize(
        ready.select("idempotency_key", outcome.alias("outcome")), "delivery-report"
    )
    return undelivered(ready, report).select("note_id", "payload_chars")


# --- model responses -------------------------------------------------------------------


def fence_strip(spark, sf_dir):
    made = clean_notes(patients(spark, sf_dir)).select("note_id", single_response().alias("r"))
    return made.select("note_id", strip_fence(F.col("r")).alias("body"))


def response_order(spark, sf_dir):
    made = clean_notes(patients(spark, sf_dir)).select("note_id", single_response().alias("r"))
    return parse_response(made, "r").select(
        "note_id", F.col("model_order").isNotNull().alias("readable"), *flat_order("model_order")
    )


def single_pass_result(spark, sf_dir):
    """Single-pass model orders with rules as the fallback, from a response log."""
    source = notes(spark, sf_dir)
    job = JobParams(model=ModelParams(available=True))
    done = process_notes(source.drop("expected"), job, stage_responses(source))
    return done.select("note_id", "route", *flat_order("order"))


def single_pass_parity(spark, sf_dir):
    """As ``single_pass_result``, with the rules over the answer's text where it can't be read."""
    source = notes(spark, sf_dir)
    job = JobParams(model=ModelParams(available=True, on_bad_response="response"))
    done = process_notes(source.drop("expected"), job, stage_responses(source))
    return done.select("note_id", "route", *flat_order("order"))


def stage_steps(spark, sf_dir):
    """Every step of every note: what was concluded from each stage's answer."""
    source = notes(spark, sf_dir)
    stages = tuple(s.stage for s in STAGES)
    df = attach_responses(note_ids(spark, sf_dir), stage_responses(source, stages), stages)
    stepped = add_steps(df, {s: response_column(s) for s in stages}, EXTRACTOR)
    steps = stepped.select("note_id", F.explode(F.array(*[f"step_{s}" for s in stages])).alias("s"))
    return steps.select(
        "note_id", "s.agent_name", "s.action", "s.reasoning", "s.confidence", "s.state"
    )


def outputs_order(spark, sf_dir):
    """The cascade from extractor answer to order, with the level that decided."""
    made = clean_notes(patients(spark, sf_dir)).select(
        "note_id", extractor_response().alias("r")
    )
    stepped = add_steps(made, {EXTRACTOR: "r"}, EXTRACTOR)
    parsed = parse_answer(stepped, f"ans_{EXTRACTOR}")
    return parsed.select("note_id", "parse_state", *flat_order("staged_order"))


def findings_shape(spark, sf_dir):
    """The nested findings shape on its own, readable or not."""
    key = F.col("note_id")
    expected = clean_notes(patients(spark, sf_dir))
    text = F.concat(
        F.lit('{"device":"'), F.col("expected.device"), F.lit('","device_type":'),
        F.element_at(F.array(F.lit("null"), F.lit('"typed"'), F.lit("3")), (pick(key, "ft", 3) + 1).cast("int")),
        F.lit(',"ordering_provider":"'), F.col("expected.ordering_provider"),
        F.lit('","medical_specifications":'),
        F.element_at(
            F.array(
                F.lit('{"mask_type":"nasal","additional_features":"hose"}'),
                F.lit('{"additional_features":["a",1,"b"]}'),
                F.lit('"none"'),
                F.lit('{"mask_type":2}'),
            ),
            (pick(key, "fs", 4) + 1).cast("int"),
        ),
        F.lit("}"),
    )
    parsed = expected.select("note_id", F.try_parse_json(text).alias("v"))
    ordered = parsed.select(
        "note_id", findings_readable(F.col("v")).alias("readable"), findings_order(F.col("v")).alias("o")
    )
    return ordered.select("note_id", "readable", *flat_order("o"))


def outputs_merge(spark, sf_dir):
    """Extractor and validator outputs merged, as key and value rows."""
    source = notes(spark, sf_dir)
    stages = (EXTRACTOR, VALIDATOR)
    df = attach_responses(note_ids(spark, sf_dir), stage_responses(source, stages), stages)
    stepped = add_steps(df, {s: response_column(s) for s in stages}, EXTRACTOR)
    merged = merge_outputs(F.col(f"out_{EXTRACTOR}"), F.col(f"out_{VALIDATOR}"))
    rows = stepped.select("note_id", F.explode(merged).alias("key", "value"))
    return rows.select("note_id", "key", F.try_variant_get("value", "$", "string").alias("value"))


def stage_prompts(spark, sf_dir):
    """Requests of the single pass, all stages, the check and the correction, and the settings
    they go with. Later stages are told what earlier ones found. The order checked is the single
    pass's, or the one wanted."""
    source = notes(spark, sf_dir)
    model = ModelParams(available=True, temperature=0.7)
    stages = tuple(s.stage for s in STAGES)
    log = stage_responses(source, stages[:-1])
    answered = attach_responses(source.select("note_id", "path", "text", "expected"), log, stages[:-1])
    answered = add_steps(answered, {s: response_column(s) for s in stages[:-1]}, EXTRACTOR)
    told = parse_response(answered.withColumn("r", single_response()), "r").withColumn(
        "draft", F.coalesce("model_order", "expected")
    )
    told = add_basic_validation(told, "draft")
    parts = [
        single_parts(model),
        stage_parts(ANALYZER, model),
        *[stage_parts(stage, model, available=stages[:i]) for i, stage in enumerate(stages) if i],
        validation_parts("draft", model),
        correction_parts("draft", "validation", model),
    ]
    shown = ("note_id", "stage", "model", "max_tokens", "temperature", F.md5("prompt").alias("prompt_md5"))
    return all_requests(told, parts).select(*shown)


def stage_lookup(spark, sf_dir):
    """Responses per stage with the stage's name and role, null for what is no stage of
    the table. The stage table is broadcast: it has four rows whatever the data."""
    log = stage_responses(notes(spark, sf_dir))
    joined = log.join(F.broadcast(stage_table(spark)), "stage", "left")
    return joined.groupBy("stage", "ordinal", "name", "role").agg(F.count("response").alias("responses"))


def staged_job(**changes) -> JobParams:
    return JobParams(staged=StagedParams(enabled=True, **changes))


def staged_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "note_id",
        *flat_order("order"),
        "confidence",
        "extractor_version",
        "tokens_used",
        F.array_join("agents_used", ",").alias("agents_used"),
        F.col("n_steps").alias("steps"),
        F.col("validation.is_valid").alias("is_valid"),
        F.col("validation.score").alias("score"),
        "was_corrected",
        "parse_state",
        F.col("additional")["ExtractionMode"].alias("mode"),
    )


def staged_result(spark, sf_dir):
    source = notes(spark, sf_dir)
    return staged_columns(
        replay(source.drop("expected"), stage_responses(source), staged_job())
    )


def staged_result_unknown(spark, sf_dir):
    """As ``staged_result`` with the alternative reading of every failure."""
    source = notes(spark, sf_dir)
    job = staged_job(
        on_model_failure="unknown", on_bad_validation="accept", on_bad_correction="blank"
    )
    return staged_columns(replay(source.drop("expected"), stage_responses(source), job))


def thorough_result(spark, sf_dir):
    """A run that checks corrected orders again, over a log with three verdicts a note."""
    source = notes(spark, sf_dir)
    log = stage_responses(source, verdicts=VERDICT_ROUNDS)
    done = replay(source.drop("expected"), log, staged_job(mode="Thorough"))
    return staged_columns(done.withColumn("parse_state", F.concat_ws("/", "parse_state", "rounds")))


def run_timings(spark, sf_dir):
    """How long the stages of each note's run and the whole run took, from a timed log."""
    source = notes(spark, sf_dir)
    done = replay(source.drop("expected"), timed_responses(stage_responses(source)), staged_job())
    steps = [F.col("steps")[i]["duration_ms"].alias(f"{s.stage}_ms") for i, s in enumerate(STAGES)]
    return done.select("note_id", "duration_ms", *steps)


def mode_consistency(spark, sf_dir):
    """Devices found in each mode, and whether a note has the same one in all."""
    source = notes(spark, sf_dir)
    found = replay_modes(source.drop("expected"), stage_responses(source), MODES, staged_job())
    return consistency(found.select("note_id", F.col("order.device").alias("device")), "note_id", "device")


# --- validation ------------------------------------------------------------------------


def validation_columns(name: str) -> list:
    issues = F.col(f"{name}.issues")
    shown = F.transform(
        issues, lambda i: F.concat_ws("/", i["field"], i["issue"], i["severity"], i["suggested_fix"])
    )
    return [
        F.col(f"{name}.is_valid").alias("is_valid"),
        F.col(f"{name}.score").alias("score"),
        F.array_join(shown, "; ").alias("issues"),
        F.when(issues.isNotNull(), error_count(issues)).alias("errors"),
        worst_severity(issues).alias("worst"),
    ]


def validate_basic(spark, sf_dir):
    """The basic check of single-pass answers as they came."""
    made = clean_notes(patients(spark, sf_dir)).select("note_id", single_response().alias("r"))
    checked = add_basic_validation(parse_response(made, "r"), "model_order")
    return checked.select("note_id", *validation_columns("validation"))


def validate_model(spark, sf_dir):
    made = note_ids(spark, sf_dir).select("note_id", validation_response().alias("r"))
    checked = add_model_validation(made, "r", "v")
    return checked.select(
        "note_id", F.col("v").isNotNull().alias("readable"), *validation_columns("v")
    )


def corrections(spark, sf_dir) -> DataFrame:
    return stage_responses(clean_notes(patients(spark, sf_dir))).filter(F.col("stage") == CORRECTION)


def correct_pick(spark, sf_dir):
    return latest_corrections(corrections(spark, sf_dir))


def correct_pick_shifted(spark, sf_dir):
    """The same from logs that start at 0, at 1, or far beyond the limit."""
    return latest_corrections(shifted_attempts(corrections(spark, sf_dir)))


def confidence_split(spark, sf_dir):
    source = notes(spark, sf_dir)
    done = replay(source.drop("expected"), stage_responses(source), staged_job())
    gate = confidence_gate(F.col("confidence"))
    return done.groupBy(gate.alias("gate"), "confidence").agg(F.count("*").alias("notes"))


def gated(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    source = notes(spark, sf_dir)
    done = replay(source.drop("expected"), stage_responses(source), staged_job())
    done = done.select("note_id", *flat_order("order"), "confidence")
    return split_by_confidence(done, run_dir(spark, "gated"))


def accepted_orders(spark, sf_dir):
    """The table of orders that are sure enough."""
    return gated(spark, sf_dir)[0]


def review_orders(spark, sf_dir):
    """The table of orders for someone to look at."""
    return gated(spark, sf_dir)[1]


# --- batch and quality -----------------------------------------------------------------


def route_fallback(spark, sf_dir):
    """Route drawn per note; each route falls back to the next simpler one."""
    key = F.col("note_id")
    source = notes(spark, sf_dir).withColumn("r", single_response())
    df = with_single_order(with_rule_order(source), "r", "single_order")
    df = df.withColumn(
        "route", choose_route(pick(key, "staged_on", 3) == 0, pick(key, "model_on", 2) == 0)
    )
    # only every fourth note has a staged order on record
    staged = F.when(pick(key, "staged_has", 4) == 0, F.col("expected"))
    df = df.withColumn("staged_order", staged).withColumn(
        "order", route_order(F.col("route"), "staged_order", "single_order", "rule_order")
    )
    return df.select("note_id", "route", *flat_order("order"))


def batch_report(spark, sf_dir):
    return batch_lines(process_notes(notes(spark, sf_dir))).select("note_id", "line")


def batch_totals(spark, sf_dir):
    """Counts taken while the batch is written."""
    configure(spark, plan=False)
    files = envelope_files(table(spark, sf_dir, "documents"))
    done = write_batch(open_envelopes(files), run_dir(spark, "batch"))
    return spark.createDataFrame([(done.total, done.processed, done.failed)], "total long, processed long, failed long")


def batch_positions(spark, sf_dir):
    """The batch in the order of its paths."""
    configure(spark, plan=False)
    files = envelope_files(table(spark, sf_dir, "documents"))
    placed = presented(process_notes(open_envelopes(files)))
    return placed.select("position", "path", "status", F.col("order.device").alias("device"))


def batch_devices(spark, sf_dir):
    configure(spark, plan=False)
    files = envelope_files(table(spark, sf_dir, "documents"))
    return device_report(process_notes(open_envelopes(files)))


def quality_fields(spark, sf_dir):
    found = extract_orders(notes(spark, sf_dir))
    return found.select("note_id", field_count().alias("fields"), *presence_flags())


def quality_fill(spark, sf_dir):
    return fill_rates(extract_orders(notes(spark, sf_dir)))


def compare_paths(spark, sf_dir):
    """Rule order against model order per note, the model answers coming from the log."""
    source = notes(spark, sf_dir)
    df = attach_responses(source, stage_responses(source, (SINGLE_PASS,)), (SINGLE_PASS,))
    both = parse_response(with_rule_order(df), response_column(SINGLE_PASS))
    return both.select(
        "note_id",
        F.col("model_order").isNotNull().alias("readable"),
        *compare_columns("rule_order", "model_order"),
    )


def compare_tables(spark, sf_dir):
    """Two order tables by patient, with several orders a patient on either side, or on one only."""
    key = F.col("note_id")
    found = with_rule_order(notes(spark, sf_dir)).filter(pick(key, "in_rules", 5) > 0)
    rules = found.select(F.col("expected.patient_name").alias("patient"), "rule_order.*")
    told = parse_response(clean_notes(patients(spark, sf_dir)).withColumn("r", single_response()), "r")
    # written first, so that the filter reads a flag and repeats no parsing
    told = materialize(told.select("note_id", F.col("expected.patient_name").alias("patient"), "model_order"), "answers")
    told = told.filter((pick(key, "in_models", 5) > 1) & F.col("model_order").isNotNull())
    models = told.select("patient", "model_order.*")
    return compare_orders(rules, models, "patient")


def compare_summary(spark, sf_dir):
    rows = compare_paths(spark, sf_dir)
    return rows.agg(
        F.count("*").alias("notes"),
        *[F.count_if(F.col(c)).alias(c) for c in rows.columns if c != "note_id"],
    )


def repeat_consistency(spark, sf_dir):
    """Notes of one patient: readings, distinct devices, and whether all agree."""
    rows = with_rule_order(notes(spark, sf_dir)).select(
        F.col("expected.patient_name").alias("patient"), F.col("rule_order.device").alias("device")
    )
    return consistency(rows, "patient", "device")


def consistency_marks(spark, sf_dir):
    found = with_rule_order(notes(spark, sf_dir))
    correct = consistency_markers(F.col("rule_order.device"), F.col("expected.device"))
    return found.groupBy(F.col("expected.device").alias("wanted")).agg(
        F.count("*").alias("notes"),
        F.count_if(correct).alias("device_correct"),
        F.count_if(field_set("patient_name", "rule_order")).alias("has_patient_info"),
        F.count_if(field_set("ordering_provider", "rule_order")).alias("has_provider"),
    )


def accuracy_report(spark, sf_dir):
    pairs = with_rule_order(clean_notes(patients(spark, sf_dir)))
    return accuracy(pairs, "rule_order", "expected")


def property_checks(spark, sf_dir):
    """What must hold for every note whatsoever."""
    found = extract_orders(notes(spark, sf_dir))
    return all_rows(
        found,
        device_named=F.length("device") > 0,
        provider_titled=F.col("ordering_provider").startswith("Dr."),
        patient_given=F.col("patient_name").isNotNull(),
        liters_only_for_oxygen=F.col("liters").isNull() | (F.col("device") == "Oxygen Tank"),
        everyone_known=F.col("patient_name") != "Unknown",
    )


def timing_report(spark, sf_dir):
    """Event values read as whole milliseconds, per event type."""
    timed = table(spark, sf_dir, "events").select(
        "event_type", F.round(F.col("value") * 100).cast("bigint").alias("ms")
    )
    stats = timing_stats(timed, "ms", "event_type")
    return stats.select(
        "event_type",
        "notes",
        "min_ms",
        "max_ms",
        "total_ms",
        F.round("avg_ms", 4).alias("avg_ms"),
        F.round("stddev_ms", 4).alias("stddev_ms"),
        F.round("notes_per_s", 4).alias("notes_per_s"),
    )


QUERIES = {
    "notes_render": notes_render,
    "random_order_draws": random_order_draws,
    "device_classify": device_classify,
    "device_classify_words": device_classify_words,
    "rule_hits": rule_hit_list,
    "caller_rules": caller_rules,
    "header_fields": header_fields,
    "header_fields_same_line": header_fields_same_line,
    "provider": provider,
    "cpap_details": cpap_details,
    "oxygen_details": oxygen_details,
    "orders_extract": orders_extract,
    "device_counts": device_counts,
    "documents_extract": documents_extract,
    "conversations_extract": conversations_extract,
    "pages_extract": pages_extract,
    "envelope_unwrap": envelope_unwrap,
    "failed_inputs": failed_input_files,
    "file_ingest": file_ingest,
    "empty_inputs": empty_inputs,
    "stream_extract": stream_extract,
    "stream_once": stream_once,
    "output_json": output_json_lines,
    "output_written": output_written,
    "payloads": payloads,
    "retry_plan": retry_plan,
    "retryable_statuses": retryable_statuses,
    "delivery_outcomes": delivery_outcomes,
    "posting_gate": posting_gate,
    "post_report": post_report,
    "post_sink": post_sink,
    "repost_pending": repost_pending,
    "fence_strip": fence_strip,
    "response_order": response_order,
    "single_pass_result": single_pass_result,
    "single_pass_parity": single_pass_parity,
    "stage_steps": stage_steps,
    "outputs_order": outputs_order,
    "findings_order": findings_shape,
    "outputs_merge": outputs_merge,
    "stage_prompts": stage_prompts,
    "stage_lookup": stage_lookup,
    "staged_result": staged_result,
    "staged_result_unknown": staged_result_unknown,
    "thorough_result": thorough_result,
    "run_timings": run_timings,
    "mode_consistency": mode_consistency,
    "validate_basic": validate_basic,
    "validate_model": validate_model,
    "correct_pick": correct_pick,
    "correct_pick_shifted": correct_pick_shifted,
    "confidence_gate": confidence_split,
    "accepted_orders": accepted_orders,
    "review_orders": review_orders,
    "route_fallback": route_fallback,
    "batch_report": batch_report,
    "batch_totals": batch_totals,
    "batch_positions": batch_positions,
    "batch_devices": batch_devices,
    "quality_fields": quality_fields,
    "quality_fill": quality_fill,
    "compare_paths": compare_paths,
    "compare_tables": compare_tables,
    "compare_summary": compare_summary,
    "consistency": repeat_consistency,
    "consistency_marks": consistency_marks,
    "accuracy": accuracy_report,
    "property_checks": property_checks,
    "timing_stats": timing_report,
}
