"""Reading schema-less JSON: a value's kind is tested before it is used, so that a number
where text belongs is treated as missing and never as its printed form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import trim_all


END = "_notewright_end_of_text"
# Fixed value: the characters that a JSON value, or what some parsers take for a number, begins with.
FIRST = '{["-+.0123456789'
# Fixed value: how its words begin: true, false, null, and NaN, INF and Infinity for a number.
WORDS = ("tr", "fa", "nu", "Na", "IN", "In")


def bracketed(text: Column) -> Column:
    """``text`` as the first item of a JSON array whose second marks the end. The parser
    passes over what follows an array, so a text that closes the array itself, or goes on
    after its value, is told by the mark being missing or in another place."""
    return F.concat(F.lit("["), text, F.lit(',{"' + END + '":1}]'))


def begins(text: Column, *first: str) -> Column:
    """True if the text begins with one of ``first``, of one length, after what JSON passes over."""
    return F.substring(F.ltrim(text, F.lit(" \t\r\n")), 1, len(first[0])).isin(*first)


def with_objects(df: DataFrame, texts: dict[str, tuple[Column, Sequence[str]]]) -> DataFrame:
    """Parse JSON objects: for ``name: (text, keys)`` add a struct ``name`` with one variant
    per key, null where ``text`` is not exactly one JSON object. A repeated key has its
    last value. One pass over each text picks out just the keys that are read; a text that does
    not begin like an object is not handed to the parser, as its exceptions cost more than parsing."""
    given = df.select("*", *[text.alias(f"_{name}_given") for name, (text, _) in texts.items()])
    arrays = {
        name: F.from_json(
            F.when(begins(F.col(f"_{name}_given"), "{"), bracketed(F.col(f"_{name}_given"))),
            "array<struct<" + ",".join(f"{k}:variant" for k in (*keys, END)) + ">>",
        )
        for name, (_, keys) in texts.items()
    }
    read = given.select("*", *[array.alias(f"_{name}_array") for name, array in arrays.items()])
    single = [
        F.when(
            (F.size(f"_{name}_array") == 2) & F.get(f"_{name}_array", F.lit(1))[END].isNotNull(),
            F.get(f"_{name}_array", F.lit(0)).dropFields(END),
        ).alias(name)
        for name in texts
    ]
    return read.select(*df.columns, *single)


def is_json(text: Column) -> Column:
    """True if ``text`` is exactly one JSON value of any kind."""
    array = F.try_parse_json(F.when(begins(text, *FIRST) | begins(text, *WORDS), bracketed(text)))
    return at(array, f"$[1].{END}").isNotNull() & at(array, "$[2]").isNull()


def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def kind(v: Column) -> Column:
    """STRING, BOOLEAN, BIGINT, VOID for a JSON null, OBJECT<..>, ARRAY<..>; null if absent."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    return F.coalesce(kind(v).startswith("OBJECT"), F.lit(False))


def is_text(v: Column) -> Column:
    return F.coalesce(kind(v) == "STRING", F.lit(False))


def is_number(v: Column) -> Column:
    numbers = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")
    found = F.lit(False)
    for number in numbers:
        found = found | kind(v).startswith(number)
    return F.coalesce(found, F.lit(False))


def is_boolean(v: Column) -> Column:
    return F.coalesce(kind(v) == "BOOLEAN", F.lit(False))


def shown(v: Column) -> Column:
    """Any value as Spark prints it; null for a JSON null."""
    return F.try_variant_get(v, "$", "string")


def raw_text(v: Column) -> Column:
    """The text of a JSON string, else null."""
    return F.when(kind(v) == "STRING", shown(v))


def trimmed_text(v: Column) -> Column:
    """Light clean: trimmed, blank kept."""
    return trim_all(raw_text(v))


def cleaned_text(v: Column) -> Column:
    """Strict clean: also loses trailing commas and stray quotes; blank becomes null."""
    bare = F.btrim(F.rtrim(trimmed_text(v), F.lit(",")), F.lit('"'))
    return F.nullif(trim_all(bare), F.lit(""))


def text_items(v: Column) -> Column:
    """The JSON strings of an array; null if there are none."""
    texts = F.transform(
        F.filter(F.try_variant_get(v, "$", "array<variant>"), is_text), shown
    )
    return F.when(F.size(texts) > 0, texts)


def printed(v: Column) -> Column:
    """Any value as text: strings as they are, JSON null as ``''``, booleans capitalised,
    objects and arrays as JSON; SQL null only if absent."""
    text = F.when(kind(v) == "BOOLEAN", F.initcap(shown(v))).otherwise(shown(v))
    return F.when(v.isNotNull(), F.coalesce(text, F.lit("")))
