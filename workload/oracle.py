"""The same results in plain SQL, for checking the Spark queries on whole tables."""

from __future__ import annotations

from notewright.operators.rules import DEVICE_RULES
from notewright.operators.stages import STAGES
from notewright.operators.synth import RANDOM_DEVICES, USAGE_WORDS
from notewright.operators.validate import NO_DEVICE, NO_PATIENT
from notewright.params import DOCUMENT_TYPE, MODEL_MAX_TOKENS, MODEL_NAME, STAGE_TEMPERATURE_CAP
from notewright.plans.prompts import (
    COMMON_FIELDS,
    CORRECTION_PROMPT,
    SINGLE_PROMPT,
    STAGE_PROMPT,
    STAGE_TASKS,
    VALIDATION_PROMPT,
)
from notewright.schema import ORDER_COLUMNS

from .queries import ENVELOPE_KINDS, SCRIPTS
from .tables import (
    DEVICES,
    EXTRACTOR_KINDS,
    FOUR_KINDS,
    LAYOUTS,
    SINGLE_KINDS,
    SIX_KINDS,
    STATUSES,
)


def text(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def pick(salt: str, n: int, key: str = "note_id") -> str:
    return f"(('0x' || substr(md5('{salt}|' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT % {n})"


def choose(salt: str, values, key: str = "note_id") -> str:
    listed = ", ".join(
        "NULL" if v is None else (str(v) if isinstance(v, int) else text(v)) for v in values
    )
    return f"([{listed}])[{pick(salt, len(values), key)} + 1]"


# --- the derived tables ----------------------------------------------------------------


def request_sql(devices) -> str:
    usage = " || ' ' || ".join(choose(f"usage{i}", USAGE_WORDS) for i in range(3))
    return f"""
base AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS note_id, coalesce(c_name, 'Unknown') AS patient_name,
    strftime(o_orderdate, '%m/%d/%Y') AS dob, o_orderpriority AS diagnosis,
    'Dr. ' || coalesce(c_mktsegment, 'Unknown') AS ordering_provider
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
drawn AS (
  SELECT *, {choose("device", devices)} AS device,
    CASE WHEN {pick("has_liters", 2)} = 1
      THEN CAST({pick("liters", 10)} + 1 AS VARCHAR) || ' L' END AS liters,
    CASE WHEN {pick("has_usage", 2)} = 1 THEN {usage} END AS usage
  FROM base)"""


NOTES = f"""WITH {request_sql(DEVICES)},
asked AS (
  SELECT *, {choose("mask", ("full face", "nasal", None))} AS mask_type,
    CASE WHEN device = 'Hospital Bed' THEN ['side rails', 'pressure relief']
      WHEN device = 'CPAP' AND {pick("add_ons", 3)} = 0 THEN ['heated humidifier']
      WHEN device = 'CPAP' AND {pick("add_ons", 3)} = 1 THEN ['humidifier', 'backup battery']
    END AS add_ons,
    {choose("qualifier", ("AHI > 20", "severe", None))} AS qualifier
  FROM drawn),
clean AS (
  SELECT *, 'Patient Name: ' || patient_name || chr(10) || 'DOB: ' || dob || chr(10) ||
    'Diagnosis: ' || diagnosis || chr(10) || 'Ordering Physician: ' || ordering_provider ||
    chr(10) ||
    CASE WHEN device = 'Oxygen Tank' AND liters IS NOT NULL AND usage IS NOT NULL
        THEN 'Patient requires oxygen tank with ' || liters || ' flow rate for ' || usage || '.'
      WHEN device = 'CPAP' AND mask_type IS NOT NULL
        THEN 'Patient requires CPAP machine with ' || mask_type || ' mask' ||
          coalesce(' with ' || array_to_string(add_ons, ' and '), '') ||
          coalesce('. ' || qualifier, '') || '.'
      WHEN device = 'CPAP' THEN 'Patient requires CPAP machine for sleep apnea.'
      WHEN device = 'Hospital Bed'
        THEN 'Patient requires hospital bed with ' || array_to_string(add_ons, ' and ') ||
          coalesce(' due to ' || qualifier, '') || '.'
      WHEN device = 'TENS Unit' THEN 'Patient requires TENS unit for pain management.'
      ELSE 'Patient requires ' || lower(device) || '.' END AS text
  FROM asked),
messy AS (
  SELECT * EXCLUDE (text), CASE {pick("layout", LAYOUTS)}
    WHEN 3 THEN replace(text, chr(10), chr(13) || chr(10))
    WHEN 4 THEN replace(text, 'DOB: ' || dob, 'DOB:')
    WHEN 5 THEN ' Patient needs a ' || lower(device) ||
      ' with full face mask and humidifier. AHI > 20. Ordered by ' || ordering_provider || '.'
    WHEN 6 THEN text || chr(10) || 'History of hypertension and CO2 retention.' || chr(10) ||
      'Usage: 2.5 L per minute during sleep and exertion.'
    WHEN 7 THEN 'Uses a wheelchair and walker at home.' || chr(10) ||
      replace(text, 'Ordering Physician: ', 'Ordered by ')
    ELSE text END AS text
  FROM clean)"""

# whitespace for patterns and for trimming
SPACE = r"[\t-\r \x{85}\p{Z}]"
INLINE = r"[\t\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
BLANKS = "||".join(
    f"chr({n})"
    for n in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
              0x202F, 0x205F, 0x3000)
)


def trim(expression: str) -> str:
    return f"trim({expression}, {BLANKS})"


def has_word(word: str, whole: bool) -> str:
    if whole:
        return rf"regexp_matches(low, '\b{word}\b')"
    return f"contains(low, '{word}')"


def rule_condition(rule, whole: bool = False) -> str:
    any_of = " OR ".join(has_word(w, whole) for w in rule.any_of)
    return " AND ".join([f"({any_of})", *[has_word(w, whole) for w in rule.all_of]])


def classify(whole: bool = False) -> str:
    cases = " ".join(f"WHEN {rule_condition(r, whole)} THEN '{r.label}'" for r in DEVICE_RULES)
    return f"CASE {cases} ELSE 'Unknown' END"


def capture(pattern: str, space: str = SPACE) -> str:
    return f"regexp_extract(text, '(?im){pattern.replace('~', space)}', 1)"


def field(pattern: str, space: str) -> str:
    found = capture(pattern, space)
    return f"CASE WHEN {found} = '' THEN 'Unknown' ELSE {trim(found)} END"


def extraction(source: str, key: str, body: str, whole: bool = False, space: str = SPACE) -> str:
    """CTEs ``ext`` with the key and the ten order columns of ``body`` in ``source``."""
    first = capture(r"Ordering Physician:~*(.+?)(?:\r?\n|$)", space)
    second = capture(r"(?:Ordered by|Dr\.)~*(.+?)\.?$", space)
    liters = capture(r"(\p{Nd}+(?:\.\p{Nd}+)?)~*L(?:~*per~*minute)?", space)
    return f"""
low AS (SELECT *, lower({body}) AS low FROM (SELECT *, {body} AS text FROM ({source}))),
named AS (SELECT *, {classify(whole)} AS found,
  rtrim({trim(f"coalesce(nullif({first}, ''), nullif({second}, ''))")}, '.') AS doctor,
  {liters} AS volume FROM low),
ext AS MATERIALIZED (SELECT {key} AS note_id, found AS device,
  CASE WHEN found = 'Oxygen Tank' AND volume <> '' THEN volume || ' L' END AS liters,
  CASE WHEN found = 'Oxygen Tank' AND (contains(low, 'sleep') OR contains(low, 'exertion'))
    THEN array_to_string([w for w in ['sleep', 'exertion'] if contains(low, w)], ' and ')
    END AS usage,
  {field("Diagnosis:~*(.+)", space)} AS diagnosis,
  CASE WHEN doctor IS NULL THEN 'Dr. Unknown' WHEN starts_with(doctor, 'Dr.') THEN doctor
    ELSE 'Dr. ' || doctor END AS ordering_provider,
  {field("Patient~*Name:~*(.+)", space)} AS patient_name,
  {field("DOB:~*(.+)", space)} AS dob,
  CASE WHEN found = 'CPAP' AND contains(low, 'full face') THEN 'full face' END AS mask_type,
  CASE WHEN found = 'CPAP' AND contains(low, 'humidifier') THEN ['humidifier'] END AS add_ons,
  CASE WHEN found = 'CPAP' AND contains(text, 'AHI > 20') THEN 'AHI > 20' END AS qualifier
  FROM named)"""


MESSY = "SELECT * EXCLUDE (device, liters, usage, diagnosis, ordering_provider, patient_name, dob, mask_type, add_ons, qualifier), text AS body FROM messy"
EXTRACTED = f"{NOTES}, {extraction(MESSY.replace(', text AS body', ''), 'note_id', 'text')}".replace(
    "SELECT *, text AS text FROM", "SELECT * FROM"
)
FLAT = ", ".join(
    "array_to_string(add_ons, '; ') AS add_ons" if c == "add_ons" else c for c in ORDER_COLUMNS
)


def of_table(source: str, key: str, body: str) -> str:
    inner = f"SELECT {key} AS id, {body} AS body FROM {source}"
    return f"WITH {extraction(inner, 'id', 'body')} SELECT note_id, {FLAT} FROM ext"


def variant(whole: bool = False, space: str = SPACE) -> str:
    return f"{NOTES}, " + extraction(
        MESSY.replace(", text AS body", ""), "note_id", "text", whole, space
    ).replace("SELECT *, text AS text FROM", "SELECT * FROM")


SQL = {
    "notes_render": f"{NOTES} SELECT note_id, text, {FLAT} FROM clean",
    "random_order_draws": f"WITH {request_sql(RANDOM_DEVICES)} "
    "SELECT note_id, device, liters, usage FROM drawn",
    "device_classify": f"{EXTRACTED} SELECT note_id, device FROM ext",
    "device_classify_words": f"{variant(whole=True)} SELECT note_id, device FROM ext",
    "rule_hits": f"{NOTES}, low AS (SELECT note_id, lower(text) AS low FROM messy) "
    "SELECT note_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN {rule_condition(r)} THEN '{r.label}' END" for r in DEVICE_RULES)
    + "], lambda x: x IS NOT NULL), '; ') AS hits FROM low",
    "header_fields": f"{EXTRACTED} SELECT note_id, patient_name, dob, diagnosis FROM ext",
    "header_fields_same_line": f"{variant(space=INLINE)} "
    "SELECT note_id, patient_name, dob, diagnosis FROM ext",
    "provider": f"{EXTRACTED} SELECT note_id, ordering_provider FROM ext",
    "cpap_details": f"{EXTRACTED} SELECT note_id, device, mask_type, "
    "array_to_string(add_ons, '; ') AS add_ons, qualifier FROM ext",
    "oxygen_details": f"{EXTRACTED} SELECT note_id, device, liters, usage FROM ext",
    "orders_extract": f"{EXTRACTED} SELECT note_id, {FLAT} FROM ext",
    "device_counts": f"{EXTRACTED} SELECT device, count(*) AS notes FROM ext GROUP BY device",
    "documents_extract": of_table("documents", "CAST(doc_id AS VARCHAR)", "text"),
    "conversations_extract": of_table(
        "conversations", "CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR)", "text"
    ),
    "pages_extract": of_table("pages", "CAST(page_id AS VARCHAR)", "html"),
    "stream_extract": f"{EXTRACTED} SELECT note_id, note_id AS file_name, 'ok' AS status, {FLAT} FROM ext",
    "batch_report": f"{EXTRACTED} SELECT note_id, note_id || ' → ' || device || ' for ' || "
    "patient_name AS line FROM ext",
}

# --- envelopes -------------------------------------------------------------------------

ENVELOPES = f"""WITH files AS (
  SELECT CAST(doc_id AS VARCHAR) AS note_id, {pick("envelope", ENVELOPE_KINDS, "doc_id")} AS kind, text AS body
  FROM documents),
opened AS (
  SELECT note_id, 'in/doc_' || note_id || CASE kind WHEN 9 THEN '.txt' WHEN 1 THEN '.JSON' ELSE '.json' END AS path,
    CASE kind WHEN 4 THEN '{{"data":"' || note_id || '"}}'
      WHEN 5 THEN '{{"note":null,"text":"' || note_id || '"}}'
      WHEN 6 THEN NULL WHEN 7 THEN NULL WHEN 8 THEN 'N' || note_id ELSE body END AS text,
    CASE WHEN kind IN (6, 7) THEN 'error' ELSE 'ok' END AS status,
    CASE kind WHEN 6 THEN 'envelope value is not text' WHEN 7 THEN 'envelope is not an object' END AS error
  FROM files)"""
SQL["envelope_unwrap"] = f"{ENVELOPES} SELECT note_id, path, text, status, error FROM opened"
SQL["failed_inputs"] = f"{ENVELOPES} SELECT path FROM opened WHERE status = 'error'"
SQL["batch_totals"] = (
    f"{ENVELOPES} SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS processed, "
    "count(*) FILTER (status <> 'ok') AS failed FROM opened"
)
SQL["batch_devices"] = (
    f"{ENVELOPES}, {extraction('SELECT note_id AS id, text AS body FROM opened WHERE status = ' + text('ok'), 'id', 'body')} "
    "SELECT device, count(*) AS notes FROM ext GROUP BY device"
)
SQL["batch_positions"] = (
    f"{ENVELOPES}, {extraction('SELECT path AS id, text AS body FROM opened WHERE status = ' + text('ok'), 'id', 'body')} "
    "SELECT row_number() OVER (ORDER BY path) AS position, path, status, device FROM opened LEFT JOIN ext ON ext.note_id = path"
)
SQL["empty_inputs"] = """SELECT s_suppkey, 'ok' AS status, CASE WHEN s_suppkey % 5 = 0 THEN 'Unknown' ELSE 'Walker' END AS device,
  CASE WHEN s_suppkey % 5 = 0 THEN 'Unknown' ELSE s_name END AS patient_name FROM supplier"""
# a note of the first delivery is known for two hours after its time; what is over two hours
# behind the newest of the first is forgotten, and too late in the second
SQL["stream_once"] = """WITH newest AS (SELECT max(ts) AS newest, date_trunc('milliseconds', max(ts)) - INTERVAL 2 HOURS AS mark FROM events)
SELECT CAST(event_id AS VARCHAR) AS note_id, epoch_us(ts) AS ts_us, 1 AS delivery FROM events
UNION ALL SELECT CAST(event_id AS VARCHAR), epoch_us(newest + INTERVAL 1 MINUTE), 2 FROM events, newest
  WHERE event_id % 7 = 1 AND ts + INTERVAL 2 HOURS <= mark
UNION ALL SELECT 'new-' || event_id, epoch_us(newest + INTERVAL 2 MINUTES), 2 FROM events, newest WHERE event_id % 11 = 0"""
SQL["file_ingest"] = """SELECT s_suppkey, 'ok' AS status, 'Oxygen Tank' AS device,
  CAST(s_suppkey % 9 + 1 AS VARCHAR) || ' L' AS liters, 'sleep' AS usage, s_name AS patient_name
FROM supplier"""

# --- published and posted orders -------------------------------------------------------


def json_member(name: str, keep_empty: bool = False) -> str:
    if name == "add_ons":
        shown = "'[\"' || array_to_string(add_ons, '\",\"') || '\"]'"
    else:
        shown = f"'\"' || {name if keep_empty else f'nullif({name}, ' + text('') + ')'} || '\"'"
    return f"'\"{name}\":' || {shown}"


def json_object(keep_empty: bool = False) -> str:
    members = ", ".join(json_member(c, keep_empty) for c in ORDER_COLUMNS)
    return f"'{{' || concat_ws(',', {members}) || '}}'"


SQL["output_json"] = f"{EXTRACTED} SELECT note_id, {json_object()} AS json FROM ext"
SQL["output_written"] = f"""{EXTRACTED} SELECT '{{"note_id":"' || note_id || '",' || substr({json_object()}, 2) AS line FROM ext"""
SQL["payloads"] = f"""{NOTES},
shaped AS (SELECT * REPLACE (
    CASE WHEN {pick("single", SINGLE_KINDS)} = 5 THEN ''
      WHEN {pick("single", SINGLE_KINDS)} IN (0, 1, 2) THEN liters END AS liters,
    '' AS qualifier) FROM clean),
posted AS (SELECT note_id, {json_object(keep_empty=True)} AS payload FROM shaped)
SELECT note_id, payload, CAST(length(payload) AS BIGINT) AS payload_chars FROM posted"""
SQL["retry_plan"] = f"""{NOTES} SELECT note_id, CAST({pick("retries", 6)} AS INTEGER) AS retries,
  CAST({pick("retries", 6)} AS INTEGER) AS waits,
  CAST(power(2, {pick("retries", 6)}) - 1 AS DOUBLE) AS total_s FROM base"""

ATTEMPTS = f"""WITH log AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(a AS INTEGER) AS attempt
  FROM (SELECT o_orderkey, unnest(range({pick("attempts", 7, "o_orderkey")} + 1)) AS a FROM orders)),
tries AS (SELECT *, {choose("status", STATUSES, "order_id || '-' || attempt")} AS status FROM log),
marked AS (SELECT *, status IS NULL OR status IN (408, 429, 500, 502, 503, 504) AS again FROM tries)"""
SQL["retryable_statuses"] = (
    f"{ATTEMPTS} SELECT status, count(*) AS attempts, count(*) FILTER (again) AS retryable "
    "FROM marked GROUP BY status"
)
SQL["delivery_outcomes"] = f"""{ATTEMPTS},
grouped AS (SELECT order_id, min(attempt) FILTER (NOT again) AS final, max(attempt) AS last
  FROM marked GROUP BY order_id),
decided AS (SELECT g.*, t.status FROM grouped g
  JOIN marked t ON t.order_id = g.order_id AND t.attempt = coalesce(final, last))
SELECT order_id,
  CASE WHEN final IS NULL AND last < 3 THEN 'pending' WHEN final IS NULL THEN 'exhausted'
    WHEN status BETWEEN 200 AND 299 THEN 'delivered' ELSE 'permanent_failure' END AS outcome,
  CAST(coalesce(final, last) + 1 AS INTEGER) AS attempts, CAST(status AS INTEGER) AS last_status,
  CAST(power(2, coalesce(final, last)) - 1 AS DOUBLE) AS backoff_s FROM decided"""
SQL["posting_gate"] = f"""{NOTES} SELECT note_id,
  CASE WHEN {pick("host", 3)} > 0 OR {pick("posting", 4)} = 0 THEN 'skipped' ELSE 'post' END AS gate
FROM base"""
SQL["post_report"] = f"""{NOTES},
scripted AS (SELECT note_id, {choose("script", SCRIPTS)} AS script FROM base)
SELECT note_id,
  CASE WHEN script = '503' THEN 'exhausted' WHEN script IN ('404', '429,400') THEN 'permanent_failure'
    ELSE 'delivered' END AS outcome,
  CAST(CASE script WHEN '503' THEN 4 ELSE length(script) - length(replace(script, ',', '')) + 1 END
    AS INTEGER) AS attempts,
  CAST(regexp_extract(script, '([0-9]+)$', 1) AS INTEGER) AS last_status,
  CAST(CASE script WHEN '503' THEN 7 ELSE power(2, length(script) - length(replace(script, ',', ''))) - 1 END
    AS DOUBLE) AS backoff_s FROM scripted"""
SQL["post_sink"] = SQL["post_report"]
SQL["repost_pending"] = f"""{EXTRACTED}
SELECT note_id, CAST(length({json_object(keep_empty=True)}) AS INTEGER) AS payload_chars FROM ext
WHERE {pick("settled", 3)} = 1"""

# --- model responses -------------------------------------------------------------------

SINGLE = f"""{NOTES},
told AS (SELECT *, {json_object(keep_empty=True)} AS j, {pick("single", SINGLE_KINDS)} AS kind FROM clean)"""
SINGLE_FIELDS = {
    "device": "CASE WHEN kind IN (0, 1, 2, 5) THEN device WHEN kind = 4 THEN 'Unknown' END",
    "ordering_provider": "CASE WHEN kind IN (0, 1, 2) THEN ordering_provider "
    "WHEN kind IN (4, 5) THEN 'Dr. Unknown' END",
    "usage": "CASE WHEN kind IN (0, 1, 2) THEN usage WHEN kind = 5 THEN 'night' END",
    "add_ons": "CASE WHEN kind IN (0, 1, 2) THEN add_ons WHEN kind = 4 THEN ['tray', 'wheels'] END",
}
SINGLE_ORDER = ", ".join(
    f"{SINGLE_FIELDS.get(c, f'CASE WHEN kind IN (0, 1, 2) THEN {c} END')} AS {c}"
    for c in ORDER_COLUMNS
)
READABLE = "kind IN (0, 1, 2, 4, 5)"
SQL["fence_strip"] = f"""{SINGLE} SELECT note_id, CASE
  WHEN kind IN (0, 1, 2) THEN j WHEN kind = 3 THEN 'The note could not be read.'
  WHEN kind = 4 THEN '{{"device":7,"dob":null,"patient_name":["x"],"add_ons":["tray",1,null,"wheels"]}}'
  WHEN kind = 5 THEN '{{"device":" \\"' || device || '\\", ","diagnosis":"   ","liters":"","add_ons":[],"usage":"night,,"}}'
  WHEN kind = 6 THEN '[' || j || ']' END AS body FROM told"""
SINGLE_ANSWER = f"{SINGLE}, answer AS (SELECT note_id, {READABLE} AS readable, {SINGLE_ORDER} FROM told)"
SQL["response_order"] = f"{SINGLE_ANSWER} SELECT note_id, readable, {FLAT} FROM answer"

BOTH = (
    SINGLE_ANSWER.replace("WITH ", "WITH ", 1)
    + ", "
    + EXTRACTED[len(NOTES) + 2 :]
    + ", both_orders AS (SELECT e.note_id, a.readable, "
    + ", ".join(f"e.{c} AS r_{c}, a.{c} AS m_{c}" for c in ORDER_COLUMNS)
    + " FROM ext e JOIN answer a ON a.note_id = e.note_id)"
)
SINGLE_OR_RULE = ", ".join(
    f"CASE WHEN readable THEN m_{c} ELSE r_{c} END AS {c}" for c in ORDER_COLUMNS
)
SQL["single_pass_result"] = (
    f"{BOTH}, done AS (SELECT note_id, {SINGLE_OR_RULE} FROM both_orders) "
    f"SELECT note_id, 'single' AS route, {FLAT} FROM done"
)
# the rules over an answer that can't be read: kinds 3 and 6; kind 7 is no answer
SQL["single_pass_parity"] = f"""{SINGLE_ANSWER},
mixed AS (SELECT t.note_id, CASE t.kind WHEN 3 THEN 'The note could not be read.' WHEN 6 THEN '[' || t.j || ']' ELSE m.text END AS text
  FROM told t JOIN messy m ON m.note_id = t.note_id),
{extraction("SELECT note_id, text FROM mixed", "note_id", "text").replace("SELECT *, text AS text FROM", "SELECT * FROM")},
done AS (SELECT e.note_id, {", ".join(f"CASE WHEN a.readable THEN a.{c} ELSE e.{c} END AS {c}" for c in ORDER_COLUMNS)}
  FROM ext e JOIN answer a ON a.note_id = e.note_id)
SELECT note_id, 'single' AS route, {FLAT} FROM done"""


def is_set_sql(name: str) -> str:
    if name.endswith("add_ons"):
        return f"coalesce(len({name}) > 0, FALSE)"
    return f"coalesce({name} <> '', FALSE)"


MATCHES = {
    "device_match": "r_device IS NOT DISTINCT FROM m_device",
    "patient_match": "r_patient_name IS NOT DISTINCT FROM m_patient_name",
    "provider_match": "r_ordering_provider IS NOT DISTINCT FROM m_ordering_provider",
    "longer_diagnosis": "coalesce(length(m_diagnosis), 0) > coalesce(length(r_diagnosis), 0)",
    **{f"model_{c}": is_set_sql(f"m_{c}") for c in ("mask_type", "add_ons", "liters", "usage", "qualifier")},
}
SQL["compare_paths"] = f"{BOTH} SELECT note_id, readable, " + ", ".join(
    f"{sql} AS {name}" for name, sql in MATCHES.items()
) + " FROM both_orders"
CONTENT = " || chr(2) || ".join(
    f"coalesce({'array_to_string(add_ons, chr(1))' if c == 'add_ons' else c}, chr(3))" for c in ORDER_COLUMNS
)
SQL["compare_tables"] = f"""{BOTH},
l AS (SELECT b.patient_name AS patient, row_number() OVER (PARTITION BY b.patient_name ORDER BY {CONTENT.replace('coalesce(', 'coalesce(e.').replace('e.array_to_string(', 'array_to_string(e.')}) AS n,
  {", ".join(f"e.{c} AS r_{c}" for c in ORDER_COLUMNS)} FROM ext e JOIN base b ON b.note_id = e.note_id WHERE {pick("in_rules", 5, "e.note_id")} > 0),
r AS (SELECT b.patient_name AS patient, row_number() OVER (PARTITION BY b.patient_name ORDER BY {CONTENT.replace('coalesce(', 'coalesce(a.').replace('a.array_to_string(', 'array_to_string(a.')}) AS n,
  {", ".join(f"a.{c} AS m_{c}" for c in ORDER_COLUMNS)} FROM answer a JOIN base b ON b.note_id = a.note_id WHERE a.readable AND {pick("in_models", 5, "a.note_id")} > 1)
SELECT coalesce(l.patient, r.patient) AS patient, coalesce(l.n, r.n) AS n,
  CASE WHEN l.n IS NULL THEN 'model' WHEN r.n IS NULL THEN 'rules' ELSE 'both' END AS side,
  {", ".join(f"CASE WHEN l.n IS NOT NULL AND r.n IS NOT NULL THEN {sql} END AS {name}" for name, sql in MATCHES.items())}
FROM l FULL JOIN r ON l.patient = r.patient AND l.n = r.n"""
SQL["compare_summary"] = (
    f"{BOTH} SELECT count(*) AS notes, count(*) FILTER (readable) AS readable, "
    + ", ".join(f"count(*) FILTER ({sql}) AS {name}" for name, sql in MATCHES.items())
    + " FROM both_orders"
)
SQL["route_fallback"] = f"""{BOTH},
routed AS (SELECT b.*, CASE WHEN {pick("staged_on", 3, "b.note_id")} = 0 THEN 'staged'
    WHEN {pick("model_on", 2, "b.note_id")} = 0 THEN 'single' ELSE 'rules' END AS route,
  {pick("staged_has", 4, "b.note_id")} = 0 AS has_staged,
  {", ".join(f"c.{c} AS s_{c}" for c in ORDER_COLUMNS)}
  FROM both_orders b JOIN clean c ON c.note_id = b.note_id),
done AS (SELECT note_id, route, {", ".join(
    f"CASE WHEN route = 'staged' AND has_staged THEN s_{c} "
    f"WHEN route IN ('staged', 'single') AND readable THEN m_{c} ELSE r_{c} END AS {c}"
    for c in ORDER_COLUMNS)} FROM routed)
SELECT note_id, route, {FLAT} FROM done"""
SQL["validate_basic"] = f"""{SINGLE_ANSWER},
checked AS (SELECT note_id,
  readable AND (coalesce(device, '') IN ('', 'Unknown')) AS no_device,
  readable AND coalesce(patient_name, '') = '' AS no_patient FROM answer)
SELECT note_id, NOT no_device AS is_valid,
  CAST(1.0 AS DOUBLE) - (no_device::INT + no_patient::INT) * CAST(0.2 AS DOUBLE) AS score,
  concat_ws('; ', CASE WHEN no_device THEN 'Device/Device type not identified/Error' END,
    CASE WHEN no_patient THEN 'PatientName/Patient name missing/Warning' END) AS issues,
  no_device::INT AS errors, CASE WHEN no_device THEN 'Error' WHEN no_patient THEN 'Warning' END AS worst FROM checked"""
SQL["validate_model"] = f"""{NOTES}, told AS (SELECT note_id, {pick("validation", SIX_KINDS)} AS kind FROM base)
SELECT note_id, kind IN (0, 1, 4) AS readable,
  CASE kind WHEN 0 THEN TRUE WHEN 1 THEN FALSE WHEN 4 THEN FALSE END AS is_valid,
  CAST(CASE kind WHEN 0 THEN 0.95 WHEN 1 THEN 0.4 WHEN 4 THEN 0.65 END AS DOUBLE) AS score,
  CASE kind WHEN 0 THEN '' WHEN 1 THEN 'dob/differs/Critical/ask; //Warning'
    WHEN 4 THEN '/usage/Error' END AS issues,
  CASE kind WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 4 THEN 1 END AS errors,
  CASE kind WHEN 1 THEN 'Critical' WHEN 4 THEN 'Error' END AS worst FROM told"""
SQL["correct_pick"] = f"""{NOTES},
told AS (SELECT note_id, {json_object(keep_empty=True)} AS j, device, {pick("correction", FOUR_KINDS)} AS kind FROM clean)
SELECT note_id, CASE kind WHEN 1 THEN '```' || j || '```' WHEN 3 THEN NULL
  ELSE '{{"device":"Corrected ' || device || '"}}' END AS correction,
  CAST(CASE kind WHEN 3 THEN 3 ELSE 2 END AS BIGINT) AS n_passed_over FROM told"""
SQL["correct_pick_shifted"] = SQL["correct_pick"]

# --- quality ---------------------------------------------------------------------------

SQL["quality_fields"] = f"{EXTRACTED} SELECT note_id, CAST(" + " + ".join(
    f"{is_set_sql(c)}::INT" for c in ORDER_COLUMNS
) + " AS INTEGER) AS fields, " + ", ".join(
    f"{is_set_sql(c)} AS {name}"
    for name, c in {
        "has_device": "device",
        "has_patient_info": "patient_name",
        "has_provider": "ordering_provider",
        "has_mask_type": "mask_type",
        "has_liters": "liters",
        "has_usage": "usage",
        "has_add_ons": "add_ons",
        "has_qualifier": "qualifier",
    }.items()
) + " FROM ext"
FIELDS = "(" + " + ".join(f"{is_set_sql(c)}::INT" for c in ORDER_COLUMNS) + ")"
SQL["quality_fill"] = (
    f"{EXTRACTED}, counted AS MATERIALIZED (SELECT *, {FIELDS} AS n FROM ext) "
    "SELECT device, count(*) AS orders, CAST(sum(n) AS BIGINT) AS fields_set, "
    "min(n) AS fewest_fields, max(n) AS most_fields, "
    + ", ".join(f"count(*) FILTER ({is_set_sql(c)}) AS with_{c}" for c in ORDER_COLUMNS)
    + " FROM counted GROUP BY device"
)
SQL["consistency"] = f"""{EXTRACTED}
SELECT b.patient_name AS patient, count(*) AS readings, count(DISTINCT e.device) AS distinct_values,
  count(DISTINCT e.device) = 1 AS consistent
FROM ext e JOIN base b ON b.note_id = e.note_id GROUP BY b.patient_name"""
SQL["consistency_marks"] = f"""{EXTRACTED}
SELECT c.device AS wanted, count(*) AS notes,
  count(*) FILTER (contains(lower(e.device), lower(c.device))) AS device_correct,
  count(*) FILTER (e.patient_name <> '') AS has_patient_info,
  count(*) FILTER (e.ordering_provider <> '') AS has_provider
FROM ext e JOIN clean c ON c.note_id = e.note_id GROUP BY c.device"""
CLEAN_EXTRACTED = f"{NOTES}, " + extraction("SELECT note_id, text FROM clean", "note_id", "text").replace(
    "SELECT *, text AS text FROM", "SELECT * FROM"
)
SQL["accuracy"] = (
    f"{CLEAN_EXTRACTED} SELECT c.device AS device, count(*) AS notes, "
    + ", ".join(
        f"count(*) FILTER (e.{c} IS NOT DISTINCT FROM c.{c}) AS {c}_matches" for c in ORDER_COLUMNS
    )
    + ", count(*) FILTER ("
    + " AND ".join(f"e.{c} IS NOT DISTINCT FROM c.{c}" for c in ORDER_COLUMNS)
    + ") AS exact_matches FROM ext e JOIN clean c ON c.note_id = e.note_id GROUP BY c.device"
)
SQL["property_checks"] = f"""{EXTRACTED} SELECT count(*) AS rows, bool_and(length(device) > 0) AS device_named,
  bool_and(starts_with(ordering_provider, 'Dr.')) AS provider_titled,
  bool_and(patient_name IS NOT NULL) AS patient_given,
  bool_and(liters IS NULL OR device = 'Oxygen Tank') AS liters_only_for_oxygen,
  bool_and(patient_name <> 'Unknown') AS everyone_known FROM ext"""
SQL["timing_stats"] = """WITH timed AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS ms FROM events)
SELECT event_type, count(ms) AS notes, min(ms) AS min_ms, max(ms) AS max_ms,
  CAST(sum(ms) AS BIGINT) AS total_ms, round(avg(ms), 4) AS avg_ms,
  round(stddev_pop(ms), 4) AS stddev_ms,
  round(count(ms) * 1000.0::DOUBLE / sum(ms), 4) AS notes_per_s FROM timed GROUP BY event_type"""

# --- staged runs -----------------------------------------------------------------------

KINDS = f"""kinds AS (SELECT note_id, {pick("analyzer", FOUR_KINDS)} AS ana,
  {pick("extractor", EXTRACTOR_KINDS)} AS ext_kind, {pick("validator", FOUR_KINDS)} AS med,
  {pick("assessor", SIX_KINDS)} AS ass, {pick("validation", SIX_KINDS)} AS val,
  {pick("correction", FOUR_KINDS)} AS cor FROM base)"""
DOUBLE = "CAST({} AS DOUBLE)"
SQL["stage_lookup"] = f"""{NOTES}, {KINDS},
logged AS (SELECT 'document_analyzer' AS stage, 0 AS ordinal, 'Document Analysis Agent' AS name,
    'Analyze document structure and identify key sections' AS role,
    count(*) FILTER (ana < 3) AS responses FROM kinds
  UNION ALL SELECT 'primary_extractor', 1, 'Primary Extraction Agent',
    'Extract device order information with medical context', 2 * count(*) FILTER (ext_kind < 11) FROM kinds
  UNION ALL SELECT 'medical_validator', 2, 'Medical Validation Agent',
    'Validate medical accuracy and completeness', count(*) FILTER (med < 3) FROM kinds
  UNION ALL SELECT 'confidence_assessor', 3, 'Confidence Assessment Agent',
    'Assess extraction confidence and identify uncertainties', count(*) FILTER (ass < 5) FROM kinds
  UNION ALL SELECT 'validation', NULL, NULL, NULL, count(*) FILTER (val < 5) FROM kinds
  UNION ALL SELECT 'correction', NULL, NULL, NULL, 2 * count(*) FILTER (cor < 3) + count(*) FROM kinds
  UNION ALL SELECT 'single_pass', NULL, NULL, NULL, count(*) FILTER ({pick('single', SINGLE_KINDS)} < 7) FROM base)
SELECT * FROM logged"""
SQL["stage_steps"] = f"""{NOTES}, {KINDS},
steps AS (
  SELECT note_id, 'document_analyzer' AS agent_name, 'Analyze document structure and identify key sections' AS action,
    CASE WHEN ana < 2 THEN 'two sections' END AS told, CASE WHEN ana < 2 THEN 0.85 END AS sure,
    CASE WHEN ana < 2 THEN 'ok' WHEN ana = 2 THEN 'unreadable' ELSE 'fallback' END AS state FROM kinds
  UNION ALL SELECT note_id, 'primary_extractor', 'Extract device order information with medical context',
    CASE WHEN ext_kind < 7 THEN 'read' END, CASE WHEN ext_kind < 7 THEN 0.9 WHEN ext_kind = 10 THEN 0.65 END,
    CASE WHEN ext_kind < 8 OR ext_kind = 10 THEN 'ok' WHEN ext_kind = 8 THEN 'unreadable' ELSE 'fallback' END FROM kinds
  UNION ALL SELECT note_id, 'medical_validator', 'Validate medical accuracy and completeness',
    CASE WHEN med = 0 THEN 'complete' END, CASE med WHEN 0 THEN 0.7 WHEN 1 THEN 1.0 END,
    CASE WHEN med < 2 THEN 'ok' ELSE 'fallback' END FROM kinds
  UNION ALL SELECT note_id, 'confidence_assessor', 'Assess extraction confidence and identify uncertainties',
    CASE WHEN ass = 2 THEN 'no score' END, CASE WHEN ass = 1 THEN 0.6 END,
    CASE WHEN ass < 5 THEN 'ok' ELSE 'fallback' END FROM kinds)
SELECT note_id, agent_name, action, state,
  CASE state WHEN 'ok' THEN coalesce(told, 'Agent reasoning not provided')
    WHEN 'unreadable' THEN 'Response parsing failed'
    ELSE 'OpenAI client not available, using fallback logic' END AS reasoning,
  CAST(CASE state WHEN 'ok' THEN coalesce(sure, 0.8) WHEN 'unreadable' THEN 0.3 ELSE 0.5 END AS DOUBLE) AS confidence
FROM steps"""

# the extractor's order by kind of answer: kinds 0, 1, 2, 4 give the whole order
ANSWER_FIELDS = {
    "device": "CASE WHEN ext_kind IN (3, 5, 6, 10) THEN c.device WHEN ext_kind = 7 THEN '' ELSE 'Unknown' END",
    "ordering_provider": "CASE WHEN ext_kind IN (3, 7) THEN c.ordering_provider ELSE 'Dr. Unknown' END",
    "patient_name": "CASE WHEN ext_kind = 6 THEN 'P' END",
    "liters": "CASE WHEN ext_kind = 6 THEN '2.5' END",
    "usage": "CASE WHEN ext_kind = 6 THEN 'True' END",
    "diagnosis": "CASE WHEN ext_kind = 5 THEN ' d ' END",
    "mask_type": "CASE WHEN ext_kind = 5 THEN 'nasal' WHEN ext_kind = 7 THEN 'm' END",
    "add_ons": "CASE WHEN ext_kind = 5 THEN ['strap', 'hose'] WHEN ext_kind = 10 THEN ['hose'] END",
}
ANSWERED = f"""answered AS (SELECT c.note_id,
  CASE WHEN ext_kind < 3 THEN 'device_order' WHEN ext_kind = 4 THEN 'findings_root'
    WHEN ext_kind IN (5, 10) THEN 'findings_order' ELSE 'loose' END AS parse_state,
  {", ".join(f"CASE WHEN ext_kind IN (0, 1, 2, 4) THEN c.{n} ELSE {ANSWER_FIELDS.get(n, 'NULL')} END AS {n}" for n in ORDER_COLUMNS)}
  FROM clean c JOIN kinds k ON k.note_id = c.note_id)"""
SQL["outputs_order"] = f"{NOTES}, {KINDS}, {ANSWERED} SELECT note_id, parse_state, {FLAT} FROM answered"

FAILED = "ass IN (3, 4) OR ext_kind IN (9, 11)"
SURE = "CASE ass WHEN 0 THEN 0.95 WHEN 1 THEN 0.6 ELSE 0.8 END"
SQL["confidence_gate"] = f"""{NOTES}, {KINDS},
runs AS (SELECT CAST(CASE WHEN {FAILED} THEN 0.5 ELSE {SURE} END AS DOUBLE) AS confidence FROM kinds)
SELECT CASE WHEN confidence >= 0.7 THEN 'accepted' ELSE 'review' END AS gate, confidence,
  count(*) AS notes FROM runs GROUP BY ALL"""

BLANK = {**{c: "NULL" for c in ORDER_COLUMNS}, "device": "''", "ordering_provider": "''"}
PATCHED = {**BLANK, "device": "'Corrected ' || w_device", "ordering_provider": "'Dr. Unknown'"}


def staged_sql(failed: str, bad_correction: dict, accept: bool = False) -> str:
    """A staged run: when it fails, what an unreadable correction leaves, and whether an
    unreadable verdict (kinds 2 and 3) is taken as valid."""
    fixed = {c: f"CASE WHEN cor = 1 THEN w_{c} ELSE {v} END" for c, v in bad_correction.items()}
    taken = {part: f"WHEN {accept} AND val IN (2, 3) THEN {v}" for part, v in {
        "issues": "0", "ok": "TRUE", "points": DOUBLE.format("1.0")}.items()}
    return f"""{BOTH}, {KINDS}, {ANSWERED},
joined AS (SELECT k.*, a.parse_state, {failed} AS failed,
    {", ".join(f"a.{c} AS a_{c}, w.{c} AS w_{c}, CASE WHEN b.readable THEN b.m_{c} ELSE b.r_{c} END AS f_{c}" for c in ORDER_COLUMNS)}
  FROM kinds k JOIN answered a ON a.note_id = k.note_id JOIN clean w ON w.note_id = k.note_id
  JOIN both_orders b ON b.note_id = k.note_id),
basic AS (SELECT *, (coalesce(a_device, '') IN ('', 'Unknown'))::INT AS no_device,
  (coalesce(a_patient_name, '') = '')::INT AS no_patient FROM joined),
judged AS (SELECT *,
  CASE WHEN val = 0 THEN 0 WHEN val = 1 THEN 2 WHEN val = 4 THEN 1 {taken['issues']} ELSE no_device + no_patient END AS found_issues,
  CASE WHEN val = 0 THEN TRUE WHEN val IN (1, 4) THEN FALSE {taken['ok']} ELSE no_device = 0 END AS ok,
  CASE WHEN val = 0 THEN CAST(0.95 AS DOUBLE) WHEN val = 1 THEN CAST(0.4 AS DOUBLE) WHEN val = 4 THEN CAST(0.65 AS DOUBLE) {taken['points']}
    ELSE CAST(1.0 AS DOUBLE) - (no_device + no_patient) * CAST(0.2 AS DOUBLE) END AS points FROM basic),
settled AS (SELECT *, NOT failed AND points < 0.7 AND found_issues > 0 AND cor <> 3 AS was_corrected FROM judged),
done AS (SELECT note_id, parse_state, was_corrected,
  {", ".join(f"CASE WHEN failed THEN f_{c} WHEN was_corrected THEN {fixed[c]} ELSE a_{c} END AS {c}" for c in ORDER_COLUMNS)},
  CAST(CASE WHEN failed THEN 0.5 ELSE {SURE} END AS DOUBLE) AS confidence,
  CASE WHEN failed THEN 'FallbackParser' ELSE 'AgenticExtractor_v1.0' END AS extractor_version,
  CASE WHEN failed THEN 0 ELSE (CASE WHEN ana < 2 THEN 120 ELSE 0 END)
    + (CASE WHEN ext_kind < 7 THEN 210 WHEN ext_kind = 10 THEN 31 ELSE 0 END)
    + (CASE med WHEN 0 THEN 35 WHEN 1 THEN 1 ELSE 0 END) + (CASE ass WHEN 0 THEN 50 ELSE 0 END) END AS tokens_used,
  CASE WHEN failed THEN 'fallback_parser'
    ELSE 'document_analyzer,primary_extractor,medical_validator,confidence_assessor' END AS agents_used,
  4 AS steps, CASE WHEN NOT failed THEN ok END AS is_valid, CASE WHEN NOT failed THEN points END AS score,
  CASE WHEN NOT failed THEN 'Standard' END AS mode FROM settled)
SELECT note_id, {FLAT}, confidence, extractor_version, tokens_used, agents_used, steps, is_valid,
  score, was_corrected, parse_state, mode FROM done"""


SQL["staged_result"] = staged_sql(FAILED, PATCHED)
SQL["staged_result_unknown"] = staged_sql("ass IN (3, 4)", BLANK, accept=True)
GATED = SQL["staged_result"].replace(SQL["staged_result"][SQL["staged_result"].rindex("SELECT note_id, ") :], "")
for name, condition in {"accepted_orders": "confidence >= 0.7", "review_orders": "confidence < 0.7"}.items():
    SQL[name] = f"{GATED}SELECT note_id, {FLAT}, confidence FROM done WHERE {condition}"


def verdict_sql(kind: str, issues: str) -> dict[str, str]:
    """Issues, result and score of a verdict of a kind; ``issues`` is what the basic check counts."""
    return {
        "issues": f"CASE {kind} WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE {issues} END",
        "points": f"CASE {kind} WHEN 0 THEN CAST(0.95 AS DOUBLE) WHEN 1 THEN CAST(0.4 AS DOUBLE) WHEN 4 THEN CAST(0.65 AS DOUBLE) "
        f"ELSE CAST(1.0 AS DOUBLE) - ({issues}) * CAST(0.2 AS DOUBLE) END",
    }


ONE, TWO, THREE = verdict_sql("val", "no_device + no_patient"), verdict_sql("val2", "1"), verdict_sql("val3", "0")
# correction 1 names a device alone (kinds 0 to 2), correction 2 the order wanted (kind 1)
SQL["thorough_result"] = f"""{BOTH}, {KINDS}, {ANSWERED},
joined AS (SELECT k.*, a.parse_state, {FAILED} AS failed, {pick("validation2", SIX_KINDS, "k.note_id")} AS val2,
    {pick("validation3", SIX_KINDS, "k.note_id")} AS val3,
    {", ".join(f"a.{c} AS a_{c}, w.{c} AS w_{c}, CASE WHEN b.readable THEN b.m_{c} ELSE b.r_{c} END AS f_{c}" for c in ORDER_COLUMNS)}
  FROM kinds k JOIN answered a ON a.note_id = k.note_id JOIN clean w ON w.note_id = k.note_id
  JOIN both_orders b ON b.note_id = k.note_id),
basic AS (SELECT *, (coalesce(a_device, '') IN ('', 'Unknown'))::INT AS no_device,
  (coalesce(a_patient_name, '') = '')::INT AS no_patient FROM joined),
one AS (SELECT *, {ONE["issues"]} AS issues, {ONE["points"]} AS points,
  CASE WHEN val = 0 THEN TRUE WHEN val IN (1, 4) THEN FALSE ELSE no_device = 0 END AS ok FROM basic),
fix_one AS (SELECT *, NOT failed AND points < 0.7 AND issues > 0 AND cor <> 3 AS took FROM one),
two AS (SELECT * REPLACE (CASE WHEN took THEN {TWO["issues"]} ELSE issues END AS issues, CASE WHEN took THEN {TWO["points"]} ELSE points END AS points,
  CASE WHEN took THEN val2 NOT IN (1, 4) ELSE ok END AS ok) FROM fix_one),
fix_two AS (SELECT *, took AND points < 0.7 AND issues > 0 AND cor = 1 AS again FROM two),
three AS (SELECT * REPLACE (CASE WHEN again THEN {THREE["points"]} ELSE points END AS points,
  CASE WHEN again THEN val3 NOT IN (1, 4) ELSE ok END AS ok) FROM fix_two),
done AS (SELECT note_id, parse_state || '/' || CASE WHEN failed THEN 0 ELSE 1 + took::INT + again::INT END AS parse_state, took AS was_corrected,
  {", ".join(f"CASE WHEN failed THEN f_{c} WHEN again THEN w_{c} WHEN took THEN {PATCHED[c]} ELSE a_{c} END AS {c}" for c in ORDER_COLUMNS)},
  CAST(CASE WHEN failed THEN 0.5 ELSE {SURE} END AS DOUBLE) AS confidence,
  CASE WHEN failed THEN 'FallbackParser' ELSE 'AgenticExtractor_v1.0' END AS extractor_version,
  CASE WHEN failed THEN 0 ELSE (CASE WHEN ana < 2 THEN 120 ELSE 0 END)
    + (CASE WHEN ext_kind < 7 THEN 210 WHEN ext_kind = 10 THEN 31 ELSE 0 END)
    + (CASE med WHEN 0 THEN 35 WHEN 1 THEN 1 ELSE 0 END) + (CASE ass WHEN 0 THEN 50 ELSE 0 END) END AS tokens_used,
  CASE WHEN failed THEN 'fallback_parser'
    ELSE 'document_analyzer,primary_extractor,medical_validator,confidence_assessor' END AS agents_used,
  4 AS steps, CASE WHEN NOT failed THEN ok END AS is_valid, CASE WHEN NOT failed THEN points END AS score,
  CASE WHEN NOT failed THEN 'Thorough' END AS mode FROM three)
SELECT note_id, {FLAT}, confidence, extractor_version, tokens_used, agents_used, steps, is_valid,
  score, was_corrected, parse_state, mode FROM done"""


def spent(stage: str, attempts: int, answered: str = "TRUE") -> str:
    """Milliseconds of a stage's attempts, null where none is on record."""
    each = " + ".join(f"{pick('ms', 900, f"(note_id || '-{stage}-{n}')")} + 100" for n in range(1, attempts + 1))
    return f"CASE WHEN {answered} THEN {each} END"


STAGE_MS = {
    "document_analyzer": spent("document_analyzer", 1, "ana < 3"),
    "primary_extractor": spent("primary_extractor", 2, "ext_kind < 11"),
    "medical_validator": spent("medical_validator", 1, "med < 3"),
    "confidence_assessor": spent("confidence_assessor", 1, "ass < 5"),
}
OTHER_MS = (
    spent("single_pass", 1, f"{pick('single', SINGLE_KINDS)} < 7"), spent("validation", 1, "val < 5"), spent("correction", 3),
)
SQL["run_timings"] = f"""{NOTES}, {KINDS}
SELECT note_id, {" + ".join(f"coalesce({ms}, 0)" for ms in (*STAGE_MS.values(), *OTHER_MS))} AS duration_ms,
  {", ".join(f"{ms} AS {stage}_ms" for stage, ms in STAGE_MS.items())} FROM kinds"""
SQL["mode_consistency"] = f"""{BOTH}, {KINDS}, {ANSWERED},
found AS (SELECT k.note_id, a.device AS staged, ext_kind IN (9, 11) AS no_answer, {FAILED} AS failed,
    CASE WHEN b.readable THEN b.m_device ELSE b.r_device END AS back
  FROM kinds k JOIN answered a ON a.note_id = k.note_id JOIN both_orders b ON b.note_id = k.note_id),
modes AS (SELECT note_id, CASE WHEN no_answer THEN back ELSE staged END AS device FROM found
  UNION ALL SELECT note_id, CASE WHEN failed THEN back ELSE staged END FROM found
  UNION ALL SELECT note_id, CASE WHEN failed THEN back ELSE staged END FROM found)
SELECT note_id, count(*) AS readings, count(DISTINCT device) AS distinct_values,
  count(DISTINCT device) = 1 AS consistent FROM modes GROUP BY note_id"""
SQL["findings_order"] = f"""{NOTES}, told AS (SELECT *, {pick("ft", 3)} AS ft, {pick("fs", 4)} AS fs FROM clean),
done AS (SELECT note_id, ft < 2 AND fs < 2 AS readable, ordering_provider,
  CASE WHEN ft = 1 THEN 'typed' ELSE 'Unknown' END AS device,
  CASE WHEN fs = 0 THEN 'nasal' END AS mask_type,
  CASE fs WHEN 0 THEN ['hose'] WHEN 1 THEN ['a', 'b'] END AS add_ons,
  {", ".join(f"NULL::VARCHAR AS {c}" for c in ORDER_COLUMNS if c not in ("device", "ordering_provider", "mask_type", "add_ons"))}
  FROM told)
SELECT note_id, readable, {FLAT} FROM done"""
SQL["caller_rules"] = f"""{EXTRACTED} SELECT e.note_id, 'rules' AS route,
  CASE WHEN contains(lower(m.text), 'portable widget') THEN 'Portable Widget' ELSE e.device END AS device
FROM ext e JOIN messy m ON m.note_id = e.note_id"""


def members(keys: dict) -> str:
    """A list of key and value structs."""
    return "[" + ", ".join(f"{{'key': '{k}', 'value': {v}}}" for k, v in keys.items()) + "]"


def said(reasoning: str, confidence: str, tokens: str, **more) -> str:
    return members({"reasoning": text(reasoning), "confidence": text(confidence), "tokens_used": text(tokens), **more})


NO_MODEL = said(
    "Fallback execution - no AI analysis performed", "0.5", "0",
    findings=text("Limited analysis available without AI"),
)
READ = ("read", "0.9", "210")
# a variant prints its keys in order of name
IN_ORDER = f"'{{' || concat_ws(',', {', '.join(json_member(c, True) for c in sorted(ORDER_COLUMNS))}) || '}}'"
SPECS = '"medical_specifications":'
SQL["outputs_merge"] = f"""{NOTES}, {KINDS},
told AS (SELECT c.*, k.ext_kind, k.med, {json_object(keep_empty=True)} AS j, {IN_ORDER} AS s
  FROM clean c JOIN kinds k ON k.note_id = c.note_id),
one AS (SELECT note_id, unnest(CASE ext_kind
  WHEN 0 THEN {said(*READ, device_order="s")} WHEN 1 THEN {said(*READ, device_order="s")}
  WHEN 2 THEN {said(*READ, device_order="j")}
  WHEN 3 THEN {said(*READ, device_order="'see below'", findings="s", device_type="device", provider="ordering_provider")}
  WHEN 4 THEN {said(*READ, findings="j")}
  WHEN 5 THEN {said(*READ, device_order="NULL", findings=f"""'{{"device_order":{{"device_type":"' || device ||
    '","diagnosis_or_medical_justification":" d ",{SPECS}{{"additional_features":["strap",2,"hose"],"mask_type":"nasal"}},"ordering_provider":null}}}}'""")}
  WHEN 6 THEN {said(*READ, findings="""'{"device_order":{"device_type":4}}'""", device="device", patient="'P'", liters="'2.5'", usage="'true'")}
  WHEN 7 THEN {members({"device": "NULL", "device_type": "device", "ordering_provider": "ordering_provider", "mask_type": "'m'"})}
  WHEN 8 THEN {said("Response parsing failed", "0.3", "0", findings="'Device: ' || device")}
  WHEN 10 THEN {members({"confidence": "'0.65'", "tokens_used": "'31'", "findings": f"""'{{"device_order":{{"device":"' || device || '",{SPECS}{{"additional_features":"hose"}}}}}}'"""})}
  ELSE {NO_MODEL} END) AS m FROM told),
two AS (SELECT note_id, unnest(CASE med WHEN 0 THEN {said("complete", "0.7", "35")}
  WHEN 1 THEN {members({"confidence": "'1'", "medical_flags": """'["f"]'""", "tokens_used": "'true'"})}
  ELSE {NO_MODEL} END) AS m FROM told),
a AS (SELECT note_id, m.key AS key, m.value AS value FROM one),
b AS (SELECT note_id, m.key AS key, m.value AS value FROM two)
SELECT coalesce(b.note_id, a.note_id) AS note_id, coalesce(b.key, a.key) AS key,
  CASE WHEN b.key IS NULL THEN a.value ELSE b.value END AS value
FROM a FULL JOIN b ON a.note_id = b.note_id AND a.key = b.key"""


def filled(template: str, *values: str) -> str:
    """A prompt template with SQL expressions in its places."""
    parts = [text(part) for part in template.split("%s")]
    return " || ".join([parts[0], *[f"({v}) || {part}" for v, part in zip(values, parts[1:])]])


def json_text(sql: str) -> str:
    return f"""('"' || replace({sql}, '"', '\\"') || '"')"""


def json_members(keys: dict) -> str:
    return members({k: v if v.startswith("(") else text(v) for k, v in keys.items()})


READ_JSON = {"reasoning": '"read"', "confidence": "0.9", "tokens_used": "210"}
UNREAD_JSON = {"reasoning": '"Response parsing failed"', "confidence": "0.3", "tokens_used": "0"}
NO_MODEL_JSON = {
    "reasoning": '"Fallback execution - no AI analysis performed"', "confidence": "0.5", "tokens_used": "0",
    "findings": '"Limited analysis available without AI"',
}
NESTED = f"""('{{"device_order":{{"device_type":"' || device || '","diagnosis_or_medical_justification":" d ",{SPECS}{{"additional_features":["strap",2,"hose"],"mask_type":"nasal"}},"ordering_provider":null}}}}')"""
EXTRACTOR_JSON = {
    0: READ_JSON | {"device_order": "(s)"},
    1: READ_JSON | {"device_order": "(s)"},
    2: READ_JSON | {"device_order": json_text("j")},
    3: READ_JSON | {"device_order": '"see below"', "findings": "(s)", "device_type": json_text("device"), "provider": json_text("ordering_provider")},
    4: READ_JSON | {"findings": json_text("j")},
    5: READ_JSON | {"device_order": "null", "findings": NESTED},
    6: READ_JSON | {"findings": '{"device_order":{"device_type":4}}', "device": json_text("device"), "patient": '"P"', "liters": "2.5", "usage": "true"},
    7: {"device": "null", "device_type": json_text("device"), "ordering_provider": json_text("ordering_provider"), "mask_type": '"m"'},
    8: UNREAD_JSON | {"findings": json_text("'Device: ' || device")},
    10: {"confidence": '"0.65"', "tokens_used": '"31"', "findings": f"""('{{"device_order":{{"device":"' || device || '",{SPECS}{{"additional_features":"hose"}}}}}}')"""},
}
VALIDATOR_JSON = {
    0: {"reasoning": '"complete"', "confidence": "0.7", "tokens_used": "35"},
    1: {"confidence": "1", "medical_flags": '["f"]', "tokens_used": "true"},
}
ANALYZER_JSON = {
    n: {"reasoning": '"two sections"', "confidence": "0.85", "tokens_used": "120.5", "key_sections": '["a","b"]'} for n in (0, 1)
} | {2: UNREAD_JSON | {"findings": '"no structure"'}}


def outputs_sql(kind: str, answers: dict) -> str:
    cases = " ".join(f"WHEN {n} THEN {json_members(keys)}" for n, keys in answers.items())
    return f"SELECT note_id, unnest(CASE {kind} {cases} ELSE {json_members(NO_MODEL_JSON)} END) AS m FROM outs"


def earlier(parts: str) -> str:
    """Members by key as one object a note; of members with one key the last source's."""
    return f"""SELECT note_id, 'Earlier findings:' || chr(10) || '{{' || string_agg('"' || key || '":' || value, ',' ORDER BY key) || '}}' || chr(10) AS told
  FROM (SELECT note_id, m.key AS key, arg_max(m.value, source) AS value FROM ({parts}) GROUP BY ALL) GROUP BY note_id"""


PREVIOUS = {
    "primary_extractor": earlier("SELECT *, 1 AS source FROM by_analyzer"),
    "medical_validator": earlier("SELECT *, 1 AS source FROM by_extractor"),
    "confidence_assessor": earlier("SELECT *, 1 AS source FROM by_extractor UNION ALL SELECT *, 2 FROM by_validator"),
}
STAGE_FIELDS = {stage.stage: stage.fields for stage in STAGES}


def stage_sql(stage: str, told: str) -> str:
    return filled(
        STAGE_PROMPT, text(STAGE_TASKS[stage]), text(DOCUMENT_TYPE), "'Standard'", "'notes/' || note_id || '.txt'", told, "text",
        text(", ".join(COMMON_FIELDS + STAGE_FIELDS[stage])),
    )


ASKED = {
    "single_pass": (filled(SINGLE_PROMPT, "text"), 0.7),
    "document_analyzer": (stage_sql("document_analyzer", "''"), STAGE_TEMPERATURE_CAP),
    "validation": (filled(VALIDATION_PROMPT, "j", "text"), STAGE_TEMPERATURE_CAP),
    "correction": (filled(CORRECTION_PROMPT, "j", "issues", "text"), STAGE_TEMPERATURE_CAP),
}
ISSUE_JSON = {
    name: "'" + '{"field":"%s","issue":"%s","severity":"%s"}' % found + "'"
    for name, found in {"device": NO_DEVICE, "patient": NO_PATIENT}.items()
}
SQL["stage_prompts"] = f"""{SINGLE_ANSWER},
draft AS (SELECT a.note_id, m.text, {", ".join(f"CASE WHEN a.readable THEN a.{c} ELSE w.{c} END AS {c}" for c in ORDER_COLUMNS)}
  FROM answer a JOIN clean w ON w.note_id = a.note_id JOIN messy m ON m.note_id = a.note_id),
drafted AS (SELECT note_id, text, {json_object(keep_empty=True)} AS j,
  '[' || concat_ws(',', CASE WHEN coalesce(device, '') IN ('', 'Unknown') THEN {ISSUE_JSON["device"]} END,
    CASE WHEN coalesce(patient_name, '') = '' THEN {ISSUE_JSON["patient"]} END) || ']' AS issues FROM draft),
{KINDS},
outs AS (SELECT c.*, k.ana, k.ext_kind, k.med, {json_object(keep_empty=True)} AS j, {IN_ORDER} AS s FROM clean c JOIN kinds k ON k.note_id = c.note_id),
by_analyzer AS ({outputs_sql("ana", ANALYZER_JSON)}),
by_extractor AS ({outputs_sql("ext_kind", EXTRACTOR_JSON)}),
by_validator AS ({outputs_sql("med", VALIDATOR_JSON)}),
prompted AS ({" UNION ALL ".join(
    [f"SELECT note_id, '{stage}' AS stage, CAST({t} AS DOUBLE) AS temperature, {prompt} AS prompt FROM drafted"
     for stage, (prompt, t) in ASKED.items()]
    + [f"SELECT note_id, '{stage}', CAST({STAGE_TEMPERATURE_CAP} AS DOUBLE), {stage_sql(stage, 'told')} "
       f"FROM (SELECT d.note_id, d.text, p.told FROM drafted d JOIN ({previous}) p ON p.note_id = d.note_id)"
       for stage, previous in PREVIOUS.items()])})
SELECT note_id, stage, '{MODEL_NAME}' AS model, CAST({MODEL_MAX_TOKENS} AS INTEGER) AS max_tokens, temperature,
  md5(prompt) AS prompt_md5 FROM prompted"""
