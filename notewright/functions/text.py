"""String helpers with the whitespace and line rules that note text follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character that counts as whitespace.
WHITESPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set for patterns, and the part of it that does not end a line. Java's own \s
# knows ASCII only, and its Unicode switch would also fold letters across scripts.
SPACE = r"[\s\x{85}\p{Z}]"
SPACE_IN_LINE = r"[\t\x0B\f\r \x{85}\p{Z}&&[^\x{2028}\x{2029}]]"
BOM = "\ufeff"


def trim_all(c: Column) -> Column:
    """Strip every kind of whitespace at both ends; the built-in trim takes only spaces."""
    return F.btrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return F.coalesce(trim_all(c) == "", F.lit(True))


def is_set(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c != "", F.lit(False))


def any_word(lowered: Column, words: tuple[str, ...], word_boundary: bool = False) -> Column:
    """True where any of the lower-case ``words`` occurs in ``lowered``."""
    hits = [
        lowered.rlike(rf"\b{word}\b") if word_boundary else lowered.contains(word)
        for word in words
    ]
    found = hits[0]
    for hit in hits[1:]:
        found = found | hit
    return found


def capture(text: Column, pattern: str) -> Column:
    """First capture of ``pattern``, ``''`` if it does not match. Flags: letters match in
    either case, and only a line feed ends a line."""
    return F.regexp_extract(text, f"(?idm){pattern}", 1)


def file_stem(path: Column) -> Column:
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def strip_fence(c: Column) -> Column:
    """Drop one Markdown fence around a model response, and whitespace around both."""
    body = F.regexp_replace(trim_all(c), r"\A```(?:json)?", "")
    return trim_all(F.regexp_replace(body, r"```\z", ""))


def fill(template: str, *values: Column) -> Column:
    """``template`` with each %s replaced by a column, null as nothing. A plain concat:
    the built-in formatter goes through Java's, which is many times slower."""
    parts = template.split("%s")
    columns = [F.lit(parts[0])]
    for value, part in zip(values, parts[1:], strict=True):
        columns += [F.coalesce(value, F.lit("")), F.lit(part)]
    return F.concat(*columns)
