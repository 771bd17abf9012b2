"""Shared helpers: reading text columns, words and their hashes in numpy, bounded samples.

Everything here works on one Arrow batch at a time; Spark deals out the batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from notewright.session import configure

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
CHUNK_BYTES = 1 << 19
BATCH_ROWS, BATCH_BYTES = 2000, "8m"

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_IS_WORD = np.array([bool(WORD.match(bytes([b]))) for b in range(256)])
_KIND = np.array([1 if w else 2 if 0x20 < b < 0x7F else 0 for b, w in enumerate(_IS_WORD)])  # words, signs, blanks
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of these operators: Arrow batches small enough for long texts."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def texts(column: pa.Array) -> list[bytes]:
    """The column as bytes; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_text(
    df: DataFrame,
    make: Callable[[], Callable[[list[bytes]], list]],
    fields: list[T.StructField],
    text: str = "text",
    keep: Iterable[str] | None = None,
) -> DataFrame:
    """``df`` with the columns ``fields`` after the columns ``keep`` (all by default).
    ``make()`` runs once a task and gives a function from a list of texts to one list a
    field. A kept column with the name of a result gives way to the result."""
    names = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    source = free_name(df, "source_text")
    rows = df.select(*(df[c] for c in kept), df[text].cast("binary").alias(source))
    schema = T.StructType([*(df.schema[c] for c in kept), *fields])
    arrow = [_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            made = work(texts(batch.column(len(kept))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(kept)], *(pa.array(v, t) for v, t in zip(made, arrow, strict=True))],
                names=[*kept, *(f.name for f in fields)],
            )

    return rows.mapInArrow(run, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def chunks(items: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``items`` that hold about ``limit`` bytes each, so that numpy arrays of
    eight bytes a byte of text stay small."""
    start = size = 0
    for i, item in enumerate(items):
        if size and size + len(item) > limit:
            yield start, i
            start, size = i, 0
        size += len(item) + 1
    if start < len(items):
        yield start, len(items)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits; one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def _powers(n: int, base: np.uint64, cache: dict) -> np.ndarray:
    have = cache.get(int(base))
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, CHUNK_BYTES), base)]))
        cache[int(base)] = have
    return have[:n]


_POWERS: dict[int, np.ndarray] = {}


WIDE = 8


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Polynomial hashes (mod 2**64) of every prefix, the empty one first: one of the bytes, and
    one of all runs of eight bytes, each mixed first. The second tells apart texts that are made to
    cancel out in the first."""
    n = len(data)
    wide = np.zeros(max(0, n - WIDE + 1), np.uint64)
    data = np.ascontiguousarray(data)
    for k in range(min(WIDE, len(wide))):
        whole = (n - k) // WIDE
        wide[k::WIDE] = data[k : k + whole * WIDE].view("<u8")
    out = np.zeros((2, n + 1), np.uint64)
    powers = _powers(n, _ODD, _POWERS)
    with np.errstate(over="ignore"):
        np.cumsum(_BYTE_VALUES[data] * powers, dtype=np.uint64, out=out[0, 1:])
        np.cumsum(mix(wide ^ _ODD) * powers[: len(wide)], dtype=np.uint64, out=out[1, 1 : len(wide) + 1])
    out[1, len(wide) + 1 :] = out[1, len(wide)]
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans, equal for equal bytes wherever they stand."""
    inverse = _powers(prefix.shape[1], _INVERSE, _POWERS)[starts]
    last = np.maximum(starts, ends - (WIDE - 1))  # runs that lie in the span begin before it
    with np.errstate(over="ignore"):
        wide = mix((prefix[1, last] - prefix[1, starts]) * inverse + _ODD)
        return mix((prefix[0, ends] - prefix[0, starts]) * inverse ^ wide)


class Words:
    """Words of several texts: ``doc`` (index of the text), ``at`` (number of the word in
    its text) and ``hash`` for each word, ``count`` for each text. With ``signs``, runs of
    other printable characters are words as well, and A-Z stay as they are."""

    def __init__(self, items: list[bytes], signs: bool = False):
        data = np.frombuffer(b"\n".join(items), np.uint8)
        if signs:
            kind = np.concatenate([[0], _KIND[data], [0]])
            edges = np.flatnonzero(kind[1:] != kind[:-1])
            inside = kind[edges[:-1] + 1] != 0
            starts, ends = edges[:-1][inside], edges[1:][inside]
        else:
            data = _LOWER[data]
            edges = np.flatnonzero(np.diff(np.concatenate([[False], _IS_WORD[data], [False]])))
            starts, ends = edges[::2], edges[1::2]
        begins = np.cumsum([0, *(len(x) + 1 for x in items)])
        self.doc = np.searchsorted(begins, starts, "right") - 1
        self.count = np.bincount(self.doc, minlength=len(items))[: len(items)]
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.at = np.arange(len(starts)) - self.first[self.doc] if len(starts) else starts
        self._prefix = prefix_hashes(data)
        self.hash = span_hashes(self._prefix, starts, ends)
        self.starts, self.ends, self.begins = starts, ends, begins

    def hashes(self, starts: np.ndarray, gaps: tuple[int, ...]) -> np.ndarray:
        """Hashes of the words at distances ``gaps`` from the words ``starts``, in order."""
        value = np.full(len(starts), len(gaps), np.uint64)
        with np.errstate(over="ignore"):
            for gap in gaps:
                value = mix(value * _ODD + _U(gap) + self.hash[starts + gap])
        return value

    def grams(self, *gaps: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) for each word that has words at all distances ``gaps``."""
        reach = max(gaps)
        n = max(0, len(self.hash) - reach)
        starts = np.flatnonzero(self.doc[:n] == self.doc[reach : reach + n])
        return self.doc[starts], self.hashes(starts, gaps)

    def stems(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the first ``size`` bytes of each longer word."""
        at = np.flatnonzero(self.ends - self.starts > size)
        return self.doc[at], mix(span_hashes(self._prefix, self.starts[at], self.starts[at] + size) + _U(size))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of all runs of ``size`` words; a text of fewer words, but not
        none, is one run of what it has."""
        doc, value = self.grams(*range(size))
        docs, values = [doc], [value]
        for n in range(1, size):
            short = np.flatnonzero(self.count == n)
            docs.append(short)
            values.append(self.hashes(self.first[short], tuple(range(n))))
        return np.concatenate(docs), np.concatenate(values)


def bounded_sample(df: DataFrame, bound: int, key: str) -> DataFrame:
    """At most ``bound`` rows of ``df``, chosen by a hash of ``key``: all of them where
    they are few enough. The count comes first, so that only about as many rows as wanted
    reach the final limit."""
    n = df.count()
    if n <= bound:
        return df
    order = F.xxhash64(F.lit(17), F.col(key))
    share = (int(min(1.0, 1.2 * bound / n) * 2**53) << 10) - 1
    return df.filter(F.shiftrightunsigned(order, 1) <= F.lit(share)).orderBy(order, F.col(key)).limit(bound)
