"""Notes, responses and attempt logs derived from the star-schema tables.

``orders`` joined to ``customer`` gives one note per order. What varies between notes is
drawn from a digest of the order key, so every engine and every run gets the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.text import fill
from notewright.operators.rules import DEVICE_LABELS
from notewright.operators.synth import choose, pick, random_orders, render_notes
from notewright.plans.prompts import CORRECTION, SINGLE_PASS, VALIDATION
from notewright.schema import ORDER_COLUMNS

DEVICES = DEVICE_LABELS + ("Portable Widget",)
LAYOUTS = 8
SINGLE_KINDS = 8
EXTRACTOR_KINDS = 12
FOUR_KINDS = 4
SIX_KINDS = 6
STATUSES = (200, 503, None, 404, 429, 201, 500, 408)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def patient_rows(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """One row per order with the patient's details. The customer side is left to the
    planner: it broadcasts below its size threshold and shuffles above it, splitting the
    partitions of customers with very many orders."""
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"], "left")
    return joined.select(
        F.col("o_orderkey").cast("string").alias("note_id"),
        F.coalesce("c_name", F.lit("Unknown")).alias("patient_name"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("dob"),
        F.col("o_orderpriority").alias("diagnosis"),
        F.concat(F.lit("Dr. "), F.coalesce("c_mktsegment", F.lit("Unknown"))).alias(
            "ordering_provider"
        ),
    )


def request_rows(patients: DataFrame) -> DataFrame:
    """Patient rows with a drawn device and details: what each note asks for."""
    key = F.col("note_id")
    device = F.col("device")
    add_ons = (
        F.when(device == "Hospital Bed", F.array(F.lit("side rails"), F.lit("pressure relief")))
        .when(pick(key, "add_ons", 3) == 0, F.array(F.lit("heated humidifier")))
        .when(
            pick(key, "add_ons", 3) == 1,
            F.array(F.lit("humidifier"), F.lit("backup battery")),
        )
    )
    return (
        random_orders(patients, "note_id", DEVICES)
        .withColumn("mask_type", choose(key, "mask", ("full face", "nasal", None)))
        .withColumn("add_ons", F.when(device.isin("CPAP", "Hospital Bed"), add_ons))
        .withColumn("qualifier", choose(key, "qualifier", ("AHI > 20", "severe", None)))
    )


def clean_notes(patients: DataFrame) -> DataFrame:
    """``(note_id, text, expected)``: every note in the template's own layout."""
    return render_notes(request_rows(patients))


def messy_notes(patients: DataFrame) -> DataFrame:
    """``(note_id, path, raw, text, status, error, expected)``: the same notes with line
    ends, labels, order of mention and side remarks as they vary in practice."""
    notes = clean_notes(patients).withColumn("_layout", pick(F.col("note_id"), "layout", LAYOUTS))
    text, layout = F.col("text"), F.col("_layout")
    expected = F.col("expected")
    dob_line = F.concat(F.lit("DOB: "), expected["dob"])
    varied = (
        F.when(layout == 3, F.replace(text, F.lit("\n"), F.lit("\r\n")))
        .when(layout == 4, F.replace(text, dob_line, F.lit("DOB:")))
        .when(
            layout == 5,
            fill(
                " Patient needs a %s with full face mask and humidifier. AHI > 20. Ordered by %s.",
                F.lower(expected["device"]),
                expected["ordering_provider"],
            ),
        )
        .when(
            layout == 6,
            F.concat(
                text,
                F.lit(
                    "\nHistory of hypertension and CO2 retention."
                    "\nUsage: 2.5 L per minute during sleep and exertion."
                ),
            ),
        )
        .when(
            layout == 7,
            F.concat(
                F.lit("Uses a wheelchair and walker at home.\n"),
                F.replace(text, F.lit("Ordering Physician: "), F.lit("Ordered by ")),
            ),
        )
        .otherwise(text)
    )
    return notes.select(
        "note_id",
        F.concat(F.lit("notes/"), F.col("note_id"), F.lit(".txt")).alias("path"),
        varied.alias("raw"),
        varied.alias("text"),
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("error"),
        "expected",
    )


def order_text(order: str = "expected") -> Column:
    """An order as the JSON a model would write."""
    parts = []
    for name in ORDER_COLUMNS:
        value = F.col(f"{order}.{name}")
        if name == "add_ons":
            shown = F.concat(F.lit('["'), F.array_join(value, '","'), F.lit('"]'))
        else:
            shown = F.concat(F.lit('"'), value, F.lit('"'))
        parts.append(F.concat(F.lit(f'"{name}":'), shown))
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def drawn(kind: Column | None, salt: str, n: int) -> Column:
    """A kind that is drawn already, or drawn here."""
    return pick(F.col("note_id"), salt, n) if kind is None else kind


def single_response(order: str = "expected", kind: Column | None = None, text: Column | None = None) -> Column:
    """A single-pass answer of one of eight kinds; null where the model gave none."""
    kind, text = drawn(kind, "single", SINGLE_KINDS), order_text(order) if text is None else text
    device = F.col(f"{order}.device")
    return (
        F.when(kind == 0, text)
        .when(kind == 1, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("  ```\n"), text, F.lit("\n```\n")))
        .when(kind == 3, F.lit("The note could not be read."))
        .when(
            kind == 4,
            F.lit('{"device":7,"dob":null,"patient_name":["x"],"add_ons":["tray",1,null,"wheels"]}'),
        )
        .when(
            kind == 5,
            F.concat(
                F.lit('{"device":" \\"'),
                device,
                F.lit('\\", ","diagnosis":"   ","liters":"","add_ons":[],"usage":"night,,"}'),
            ),
        )
        .when(kind == 6, F.concat(F.lit("["), text, F.lit("]")))
    )


def extractor_response(order: str = "expected", kind: Column | None = None, text: Column | None = None) -> Column:
    """An extractor answer of one of twelve kinds, one per way of giving the order."""
    kind, text = drawn(kind, "extractor", EXTRACTOR_KINDS), order_text(order) if text is None else text
    device, provider = F.col(f"{order}.device"), F.col(f"{order}.ordering_provider")
    quoted = F.replace(text, F.lit('"'), F.lit('\\"'))
    lead = '{"reasoning":"read","confidence":0.9,"tokens_used":210,'
    direct = F.concat(F.lit(lead + '"device_order":'), text, F.lit("}"))
    return (
        F.when(kind == 0, direct)
        .when(kind == 1, F.concat(F.lit("```json\n"), direct, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit(lead + '"device_order":"'), quoted, F.lit('"}')))
        .when(
            kind == 3,
            F.concat(
                F.lit(lead + '"device_order":"see below","findings":'),
                text,
                F.lit(',"device_type":"'),
                device,
                F.lit('","provider":"'),
                provider,
                F.lit('"}'),
            ),
        )
        .when(kind == 4, F.concat(F.lit(lead + '"findings":"'), quoted, F.lit('"}')))
        .when(
            kind == 5,
            F.concat(
                F.lit(lead + '"device_order":null,"findings":{"device_order":{"device_type":"'),
                device,
                F.lit('","ordering_provider":null,"diagnosis_or_medical_justification":" d ",'
                      '"medical_specifications":{"mask_type":"nasal","additional_features":'
                      '["strap",2,"hose"]}}}}'),
            ),
        )
        .when(
            kind == 6,
            F.concat(
                F.lit(lead + '"findings":{"device_order":{"device_type":4}},"device":"'),
                device,
                F.lit('","patient":"P","liters":2.5,"usage":true}'),
            ),
        )
        .when(
            kind == 7,
            F.concat(
                F.lit('{"device":null,"device_type":"'),
                device,
                F.lit('","ordering_provider":"'),
                provider,
                F.lit('","mask_type":"m"}'),
            ),
        )
        .when(kind == 8, F.concat(F.lit("Device: "), device))
        .when(kind == 9, F.concat(F.lit('{"confidence":"high","device_order":'), text, F.lit("}")))
        .when(
            kind == 10,
            F.concat(
                F.lit('{"confidence":"0.65","tokens_used":"31","findings":{"device_order":'
                      '{"device":"'),
                device,
                F.lit('","medical_specifications":{"additional_features":"hose"}}}}'),
            ),
        )
    )


def analyzer_response(kind: Column | None = None) -> Column:
    kind = drawn(kind, "analyzer", FOUR_KINDS)
    told = '{"reasoning":"two sections","confidence":0.85,"tokens_used":120.5,"key_sections":["a","b"]}'
    return (
        F.when(kind == 0, F.lit(told))
        .when(kind == 1, F.lit(f"```\n{told}\n```"))
        .when(kind == 2, F.lit("no structure"))
    )


def validator_response(kind: Column | None = None) -> Column:
    kind = drawn(kind, "validator", FOUR_KINDS)
    return (
        F.when(kind == 0, F.lit('{"reasoning":"complete","confidence":0.7,"tokens_used":35}'))
        .when(kind == 1, F.lit('{"confidence":1,"medical_flags":["f"],"tokens_used":true}'))
        .when(kind == 2, F.lit("[]"))
    )


def assessor_response(kind: Column | None = None) -> Column:
    kind = drawn(kind, "assessor", SIX_KINDS)
    return (
        F.when(kind == 0, F.lit('{"overall_confidence":0.95,"tokens_used":50}'))
        .when(kind == 1, F.lit('{"overall_confidence":"0.6","confidence":0.6}'))
        .when(kind == 2, F.lit('{"reasoning":"no score"}'))
        .when(kind == 3, F.lit('{"overall_confidence":"high"}'))
        .when(kind == 4, F.lit('{"overall_confidence":0.9,"tokens_used":"many"}'))
    )


def validation_response(salt: str = "validation", kind: Column | None = None) -> Column:
    kind = drawn(kind, salt, SIX_KINDS)
    return (
        F.when(kind == 0, F.lit('{"is_valid":true,"validation_score":0.95,"issues":[]}'))
        .when(
            kind == 1,
            F.lit(
                '```json\n{"is_valid":false,"validation_score":0.4,"issues":[{"field":" dob ",'
                '"issue":"differs","severity":"critical","suggested_fix":"ask"},{"severity":"odd"}]}\n```'
            ),
        )
        .when(kind == 2, F.lit('{"is_valid":"yes","validation_score":0.9}'))
        .when(kind == 3, F.lit("looks fine"))
        .when(kind == 4, F.lit('{"validation_score":0.65,"issues":[{"issue":"usage","severity":"2"}]}'))
    )


def correction_responses(order: str = "expected", kind: Column | None = None, text: Column | None = None) -> Column:
    """Attempts 1 to 3 as an array of structs; the third is past the default limit."""
    kind, text = drawn(kind, "correction", FOUR_KINDS), order_text(order) if text is None else text
    fixed = F.concat(F.lit('{"device":"Corrected '), F.col(f"{order}.device"), F.lit('"}'))
    second = (
        F.when(kind == 0, F.lit("cannot correct"))
        .when(kind == 1, F.concat(F.lit("```"), text, F.lit("```")))
        .when(kind == 2, F.lit("[1]"))
    )
    return F.array(
        F.struct(F.lit(1).alias("attempt"), F.when(kind != 3, fixed).alias("response")),
        F.struct(F.lit(2).alias("attempt"), second.alias("response")),
        F.struct(F.lit(3).alias("attempt"), F.lit('{"device":"late"}').alias("response")),
    )


def stage_responses(
    notes: DataFrame, stages: tuple[str, ...] | None = None, verdicts: tuple[str, ...] = ()
) -> DataFrame:
    """``(note_id, stage, attempt, response)``: a log of answers, with stale first attempts
    at the extractor stage. Attempts at a correction are on record without an answer as well.
    With ``stages`` only their rows, all of them: a filter is not pushed below the rows being made.
    With ``verdicts`` the one verdict of a note gives way to one for each of these salts, also on record
    without an answer; they come from the same pass over the notes."""
    stale = '{"device_order":{"device":"Stale"}}'
    salts = {
        "document_analyzer": ("analyzer", FOUR_KINDS), "primary_extractor": ("extractor", EXTRACTOR_KINDS),
        "medical_validator": ("validator", FOUR_KINDS), "confidence_assessor": ("assessor", SIX_KINDS),
        SINGLE_PASS: ("single", SINGLE_KINDS), VALIDATION: ("validation", SIX_KINDS), CORRECTION: ("correction", FOUR_KINDS),
    }
    wanted = [s for s in salts if (stages is None or s in stages) and not (verdicts and s == VALIDATION)]
    # drawn once a note, as an answer is chosen by comparing its kind again and again
    told = verdicts if stages is None or VALIDATION in stages else ()
    draws = [salts[s] for s in wanted] + [(salt, SIX_KINDS) for salt in told]
    kinds = [pick(F.col("note_id"), *draw).alias(f"_{draw[0]}") for draw in draws]
    notes = notes.select("note_id", "expected", order_text().alias("_json"), *kinds)
    json, kind = F.col("_json"), {salt: F.col(f"_{salt}") for salt, _ in (*salts.values(), *draws)}
    answers = {
        "document_analyzer": analyzer_response(kind["analyzer"]),
        "primary_extractor": extractor_response(kind=kind["extractor"], text=json),
        "medical_validator": validator_response(kind["validator"]),
        "confidence_assessor": assessor_response(kind["assessor"]),
        SINGLE_PASS: single_response(kind=kind["single"], text=json),
        VALIDATION: validation_response(kind=kind["validation"]),
    }
    rows = [
        F.struct(
            F.lit(stage).alias("stage"),
            F.lit(2 if stage == "primary_extractor" else 1).alias("attempt"),
            response.alias("response"),
        )
        for stage, response in answers.items()
        if stage in wanted
    ]
    if "primary_extractor" in wanted:
        rows.append(
            F.struct(
                F.lit("primary_extractor").alias("stage"),
                F.lit(1).alias("attempt"),
                # a first attempt is on record only where there is a second
                F.when(kind["extractor"] < EXTRACTOR_KINDS - 1, F.lit(stale)).alias("response"),
            )
        )
    rows += verdict_structs(told, kind)
    made = F.array(*rows)
    if CORRECTION in wanted:
        fixes = F.transform(
            correction_responses(kind=kind["correction"], text=json),
            lambda fix: F.struct(
                F.lit(CORRECTION).alias("stage"), fix["attempt"].alias("attempt"), fix["response"].alias("response")
            ),
        )
        made = F.concat(made, fixes) if rows else fixes
    log = notes.select("note_id", F.inline(made))
    silent = (CORRECTION, VALIDATION) if verdicts else (CORRECTION,)
    return log.filter(F.col("response").isNotNull() | F.col("stage").isin(*silent))


VERDICT_ROUNDS = ("validation", "validation2", "validation3")


def verdict_structs(salts: tuple[str, ...], kind: dict[str, Column] | None = None) -> list[Column]:
    """A verdict for each of ``salts``, as attempts one after the other; some had no answer. ``kind``
    has the kinds that are drawn already."""
    answers = [validation_response(salt, (kind or {}).get(salt)) for salt in salts]
    return [
        F.struct(F.lit(VALIDATION).alias("stage"), F.lit(n).alias("attempt"), answer.alias("response"))
        for n, answer in enumerate(answers, 1)
    ]


def verdict_rounds(notes: DataFrame) -> DataFrame:
    """Three verdicts of each note, the first as in ``stage_responses``; some had no answer."""
    return notes.select("note_id", F.inline(F.array(*verdict_structs(VERDICT_ROUNDS))))


ATTEMPT_SHIFTS = (-1, 0, 4, 100)


def shifted_attempts(log: DataFrame) -> DataFrame:
    """The log with attempts numbered from 0, 1, 5 or 101."""
    shift = choose(F.col("note_id"), "shift", ATTEMPT_SHIFTS)
    return log.withColumn("attempt", F.col("attempt") + shift)


def timed_responses(log: DataFrame) -> DataFrame:
    """The log with the milliseconds that each attempt took."""
    draw = F.concat_ws("-", "note_id", "stage", F.col("attempt").cast("string"))
    return log.withColumn("duration_ms", pick(draw, "ms", 900) + 100)


def delivered_again(events: DataFrame, newest) -> DataFrame:
    """``(note_id, ts, delivery)`` of a second delivery: every third event half an hour after its
    time, some a minute after the newest of the first, some notes that are new, and one that is
    too late."""
    key = F.col("event_id")
    name = key.cast("string")
    kinds = [
        (F.when(key % 3 == 0, name), F.col("ts") + F.expr("INTERVAL 30 MINUTES")),
        (F.when(key % 7 == 1, name), F.lit(newest) + F.expr("INTERVAL 1 MINUTE")),
        (F.when(key % 11 == 0, F.concat(F.lit("new-"), name)), F.lit(newest) + F.expr("INTERVAL 2 MINUTES")),
        (F.when(key == 1, F.lit("late")), F.col("ts")),
    ]
    kinds = F.array(*[F.struct(note.alias("note_id"), time.alias("ts")) for note, time in kinds])
    rows = events.select(F.inline(kinds)).filter("note_id IS NOT NULL")
    return rows.withColumn("delivery", F.lit(2))


def write_files(rows: DataFrame) -> DataFrame:
    """Write ``(path, content)`` rows as files, empty ones as well, and return their paths."""

    def run(batches):
        from notewright.sources.listing import open_folder

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                store, file, _ = open_folder(path)
                store.create_dir(file.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(file) as out:
                    out.write(content.encode())
            yield batch[["path"]]

    return rows.select("path", "content").mapInPandas(run, "path string")


def attempt_log(orders: DataFrame) -> DataFrame:
    """``(order_id, attempt, status)``: up to seven posting attempts per order, some after
    one that was final and some beyond the usual limit, as a log of re-runs has them."""
    key = F.col("o_orderkey").cast("string")
    attempts = F.sequence(F.lit(0), pick(key, "attempts", 7).cast("int"))
    log = orders.select(key.alias("order_id"), F.explode(attempts).alias("attempt"))
    draw = F.concat_ws("-", "order_id", F.col("attempt").cast("string"))
    return log.select("order_id", "attempt", choose(draw, "status", STATUSES).alias("status"))
