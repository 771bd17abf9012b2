"""Tool-call linking for chat formats, and op3_tool_calls.

Calls and results are paired by conversation and identifier, the n-th call of an identifier
with its n-th result, so that repeated ids never multiply and none is lost. Calls that wait for another call's
result are put in topological order by pointer doubling, which takes the logarithm of the
longest chain in rounds. Arguments are checked against JSON schemas, and every linked call
is written as canonical JSON (sorted keys, no blanks)."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notewright.llm.common import table
from notewright.session import discard, materialize

KINDS = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema``: type, enum, required, properties,
    additionalProperties, items, minimum, maximum, minLength and maxLength."""
    kind = schema.get("type")
    if kind and (not isinstance(value, KINDS[kind]) or isinstance(value, bool) and kind in ("integer", "number")):
        return [f"{at}: not {kind}"]
    out = []
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if isinstance(value, dict):
        own = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in own:
                out += problems(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    elif isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += problems(x, schema["items"], f"{at}[{i}]")
    elif isinstance(value, str):
        out += [f"{at}: too short"] * (len(value) < schema.get("minLength", 0))
        out += [f"{at}: too long"] * (len(value) > schema.get("maxLength", len(value)))
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        out += [f"{at}: too small"] * (value < schema.get("minimum", value))
        out += [f"{at}: too large"] * (value > schema.get("maximum", value))
    return out


LONE = re.compile("[\ud800-\udfff]")


def escaped(text: str) -> str:
    """Text in which halves of a character that stand alone are written as JSON escapes, as they
    have no UTF-8 form."""
    return LONE.sub(lambda half: f"\\u{ord(half[0]):04x}", text)


def canonical(value) -> str:
    return escaped(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def finite(text: str) -> float:
    number = float(text)
    if not math.isfinite(number):
        raise ValueError(f"{text} is no number that JSON can hold")
    return number


def no_constant(name: str):
    raise ValueError(f"{name} is not JSON")


def read_json(text: str):
    """The value of a JSON text; ValueError for what is none: NaN and infinities, numbers beyond
    doubles, and arrays and objects nested too deeply to be walked through."""
    try:
        value = json.loads(text, parse_constant=no_constant, parse_float=finite)
        json.dumps(value)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


def ranks(calls: DataFrame) -> DataFrame:
    """(call_id, depth): how many calls stand before each in its chain of ``after``; null
    for calls of a circle and those that wait for one. One row a call_id is taken for
    granted. An ``after`` that no call has is no dependency."""
    known = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("real"))
    links = calls.select("call_id", "after").join(known, "after", "left")
    now = materialize(
        links.select(
            "call_id",
            F.when(F.col("real"), F.col("after")).alias("up"),
            F.when(F.col("real"), F.lit(1)).otherwise(F.lit(0)).cast("long").alias("depth"),
        ),
        "ranks",
    )
    left, total = now.filter(F.col("up").isNotNull()).count(), now.count()
    reach = 1
    while left and reach < total:
        above = now.select(F.col("call_id").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        done = now.filter(F.col("up").isNull())
        going = now.filter(F.col("up").isNotNull()).join(above, "up")
        after = materialize(done.union(going.select("call_id", F.col("next"), (F.col("depth") + F.col("more")))), "ranks")
        discard(now)
        now, reach = after, reach * 2
        left = now.filter(F.col("up").isNotNull()).count()
    return now.select("call_id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"))


def call_key(conv_id: Column, call_id: Column) -> Column:
    """Text for a call's id within its conversation, which may be null; null without an id."""
    conv = conv_id.cast("string")
    return F.concat(F.coalesce(F.concat(F.length(conv), F.lit(":"), conv), F.lit("")), F.lit("/"), call_id)


def paired(calls: DataFrame, results: DataFrame) -> DataFrame:
    """(key, nth, conv_id, call_id, c, r, n_calls, n_results): the n-th call of each key with
    its n-th result, either null where there are fewer. Rows without a call_id stay alone."""
    call = F.struct("turn", "conv_id", "name", "arguments", "after")
    result = F.struct("turn", "conv_id", "content")
    key = call_key(F.col("conv_id"), F.col("call_id"))
    sides = calls.select(key.alias("key"), "conv_id", "call_id", F.lit(True).alias("is_call"), call.alias("c")).unionByName(
        results.select(key.alias("key"), "conv_id", "call_id", F.lit(False).alias("is_call"), result.alias("r")), allowMissingColumns=True
    )
    known = sides.filter(F.col("key").isNotNull()).repartition("key")
    of_key = Window.partitionBy("key")
    numbered = known.select(
        "*",
        F.row_number().over(Window.partitionBy("key", "is_call").orderBy("c", "r")).cast("long").alias("nth"),
        F.count_if("is_call").over(of_key).alias("n_calls"),
        F.count_if(~F.col("is_call")).over(of_key).alias("n_results"),
    )
    some = lambda name: F.first(name, ignorenulls=True).alias(name)
    pairs = numbered.groupBy("key", "nth").agg(*map(some, ("conv_id", "call_id", "c", "r", "n_calls", "n_results")))
    alone = sides.filter(F.col("key").isNull()).select(
        "key", F.lit(1).cast("long").alias("nth"), "conv_id", "call_id", "c", "r",
        F.col("is_call").cast("long").alias("n_calls"), (~F.col("is_call")).cast("long").alias("n_results"),
    )
    return pairs.unionByName(alone)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Of ``link_all`` the first row of each id of a conversation, without nth; the numbers
    say how many calls and results there were. Rows without a call_id are all there."""
    return link_all(calls, results, schemas).filter("nth = 1").drop("nth")


def link_all(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Every call and every result once: conv_id, call_id, name, n_calls, n_results, status,
    level, valid, errors, message, nth.

    ``calls`` (conv_id, turn, call_id, name, arguments, after), ``results`` (conv_id, turn,
    call_id, content); other columns don't matter. An id counts within its conversation;
    rows with a null conv_id are one conversation. The n-th call of an id (by turn, then
    text) takes the n-th result; surplus ones stand alone. Rows without a call_id are not
    linked, each is a row of its own. status: linked, no_result, no_call. level: 2 x the
    depth of the chain, so that a result (level + 1) comes before what waits for it;
    ``after`` means the first call of that id in the conversation. Null in a circle and
    without a call or an id. Arguments that are no JSON, or for a name without schema, are
    not valid; neither are NaN, infinities, numbers beyond doubles and too deep nesting JSON.
    ``message`` is canonical JSON; unreadable arguments are kept in it as a string, and half
    characters as escapes."""
    pairs = materialize(paired(calls, results), "calls")
    named = pairs.filter(F.col("key").isNotNull() & F.col("c").isNotNull())
    waits = call_key(F.col("c.conv_id"), F.col("c.after"))
    first_calls = named.filter("nth = 1").select(F.col("key").alias("call_id"), waits.alias("after"))
    depth = ranks(first_calls).select(F.col("call_id").alias("d_key"), "depth", F.lit(True).alias("real"))
    # a repeated call has its own depth, one below that of the call it waits for
    look = F.when(F.col("c").isNotNull(), F.when(F.col("nth") == 1, F.col("key")).otherwise(F.when(F.col("key").isNotNull(), waits)))
    own = F.when(F.col("nth") == 1, F.col("depth")).when(F.col("real"), F.col("depth") + 1).otherwise(F.lit(0))
    at = F.when(F.col("key").isNotNull() & F.col("c").isNotNull(), own)
    rows = pairs.withColumn("look", look).join(depth, F.col("look") == F.col("d_key"), "left").select(
        "conv_id",
        "call_id",
        F.col("c.name").alias("name"),
        F.col("c.arguments").alias("arguments"),
        F.col("r.content").alias("content"),
        "n_calls",
        "n_results",
        F.when(F.col("c").isNull(), "no_call").when(F.col("r").isNull(), "no_result").otherwise("linked").alias("status"),
        (2 * at).alias("level"),
        "nth",
    )
    names = ["conv_id", "call_id", "name", "n_calls", "n_results", "status", "level", "valid", "errors", "message", "nth"]
    kept = rows.select("conv_id", "call_id", "name", "n_calls", "n_results", "status", "level")
    schema = kept.schema.add("valid", "boolean").add("errors", "string").add("message", "string").add("nth", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(n).to_pylist() for n in ("call_id", "name", "arguments", "content", "status")}
            valid, errors, messages = [], [], []
            for call_id, name, text, content, status in zip(*col.values(), strict=True):
                if status == "no_call":
                    valid.append(None)
                    errors.append("")
                    messages.append(canonical({"id": call_id, "result": content}))
                    continue
                call = {"id": call_id, "name": name} | ({"result": content} if status == "linked" else {})
                try:
                    value = read_json(text or "")
                    found = problems(value, schemas[name]) if name in schemas else ["$: no schema"]
                    message = canonical(call | {"arguments": value})
                except (ValueError, RecursionError):
                    found = ["$: no JSON"]
                    message = canonical(call | {"arguments": text})
                valid.append(not found)
                errors.append(escaped("; ".join(found)))
                messages.append(message)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(n) for n in names[:7]),
                    pa.array(valid, pa.bool_()),
                    pa.array(errors, pa.string()),
                    pa.array(messages, pa.string()),
                    batch.column("nth"),
                ],
                names=names,
            )

    return rows.mapInArrow(run, schema)


# The tools that the query's calls name. "report" has no schema on purpose.
SCHEMAS = {
    "search": {
        "type": "object",
        "properties": {"query": {"type": "string", "minLength": 1, "maxLength": 2000}, "limit": {"type": "integer", "minimum": 1}},
        "required": ["query"],
        "additionalProperties": False,
    },
    "measure": {
        "type": "object",
        "properties": {"text": {"type": "string"}, "chars": {"type": "integer", "minimum": 200}},
        "required": ["text", "chars"],
    },
    "translate": {
        "type": "object",
        "properties": {"text": {"type": "string"}, "to": {"enum": ["de", "en", "es", "fr"]}},
        "required": ["text", "to"],
    },
}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of conversations stand for: every assistant turn
    calls a tool chosen by its length, with arguments made of its text, and waits for the
    assistant turn before it in the conversation; the next user turn is its result. Both
    are found by equal conversation and turn. Turns without a conversation or a number
    have no id."""
    call_id = lambda turn: F.concat(F.lit("call:"), F.col("conv_id"), F.lit(":"), turn)
    text = F.coalesce("text", F.lit(""))
    size = F.length(text)
    name = F.element_at(F.array(F.lit("search"), F.lit("measure"), F.lit("translate"), F.lit("report")), (size % 4 + 1).cast("int"))
    arguments = (
        F.when(size % 4 == 0, F.to_json(F.struct(text.alias("query"), (size % 10).alias("limit"))))
        .when(size % 4 == 1, F.to_json(F.struct(size.alias("chars"), text.alias("text"))))
        .when(size % 4 == 2, F.to_json(F.struct(F.substring(F.lit("deenesfrit"), (size % 5 * 2 + 1).cast("int"), F.lit(2)).alias("to"), text.alias("text"))))
        .otherwise(text)
    )
    calls = turns.filter(F.col("role") == "assistant").select(
        "conv_id", "turn", call_id(F.col("turn")).alias("call_id"), name.alias("name"), arguments.alias("arguments"),
        call_id(F.col("turn") - 2).alias("after"),
    )
    results = turns.filter((F.col("role") == "user") & (F.col("turn").isNull() | (F.col("turn") > 0))).select(
        "conv_id", "turn", call_id(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = from_conversations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return link_all(calls, results, SCHEMAS)


QUERIES = {"op3_tool_calls": op3_tool_calls}
SQL: dict[str, str] = {}
