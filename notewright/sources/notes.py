"""Notes from files or tables, with JSON envelopes opened."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import BOM, file_stem
from ..functions.variants import is_json, kind, raw_text, with_objects
from ..params import FileParams
from .listing import empty_files


def file_filter(params: FileParams = FileParams()) -> str:
    names = ",".join(extension.lstrip(".") for extension in params.extensions)
    return "*.{" + names + "}"


def decoded_path() -> Column:
    """The file a row came from, as written by whoever named it."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


def whole_text(value: Column) -> Column:
    """File content as text: bad bytes become U+FFFD, a byte-order mark goes."""
    text = F.make_valid_utf8(value)
    return F.when(text.startswith(BOM), F.substring(text, F.lit(2), F.length(text))).otherwise(
        text
    )


def note_key(path: Column, text: Column) -> Column:
    """The same id for the same file and content on every run."""
    return F.sha2(F.concat_ws("|", path, text), 256)


def shape_files(raw: DataFrame) -> DataFrame:
    """``(note_id, path, raw)`` from a whole-text read, batch or stream."""
    files = raw.select(decoded_path().alias("path"), whole_text(F.col("value")).alias("raw"))
    return files.select(note_key(F.col("path"), F.col("raw")).alias("note_id"), "path", "raw")


def open_envelopes(files: DataFrame, params: FileParams = FileParams()) -> DataFrame:
    """Add ``text``, ``status`` and ``error`` to ``(path, raw)`` rows.

    Only files with the envelope extension are opened. The first key present counts: text
    is taken, JSON null gives the raw content, any other kind is an error, as is JSON that
    is not an object. What is not JSON at all is a note as it stands."""
    enveloped = F.lower("path").endswith(params.envelope_extension)
    texts = {"_envelope": (F.when(enveloped, F.col("raw")), params.envelope_keys)}
    envelope = F.col("_envelope")
    found = F.coalesce(*[envelope[key] for key in params.envelope_keys])
    # what starts like an object and is none is not JSON; the rest may be JSON all the same
    other = envelope.isNull() & enveloped & ~F.col("raw").rlike(r"\A\s*\{")
    error = F.when(F.when(other, is_json(F.col("raw"))), "envelope is not an object").when(
        ~kind(found).isin("STRING", "VOID"), "envelope value is not text"
    )
    text = F.coalesce(raw_text(found), F.col("raw"))
    return with_objects(files, texts).select(
        *files.columns,
        F.when(error.isNull(), text).alias("text"),
        F.when(error.isNull(), "ok").otherwise("error").alias("status"),
        error.alias("error"),
    )


def with_empties(files: DataFrame, empties: DataFrame) -> DataFrame:
    """``files`` and a row without text for every path of ``empties``, batch or stream."""
    raw = F.lit("")
    return files.unionByName(empties.select(note_key(F.col("path"), raw).alias("note_id"), "path", raw.alias("raw")))


def read_notes(
    spark: SparkSession,
    path: str,
    params: FileParams = FileParams(),
    listing: DataFrame | None = None,
    empties: bool = True,
) -> DataFrame:
    """Notes of one folder (sub-folders are not entered), one row per file.

    A folder that does not exist gives no rows. An empty file is an empty note: Spark's file
    sources skip it, so a listing source adds it, which reads folders in tasks and needs a
    store that Arrow can open (``empties=False`` does without). Both pass over names that begin with
    ``_`` or ``.``; pass ``listing``, a table with a ``path`` column, to have such files appear, as
    empty notes."""
    if not params.batch_mode:
        raise ValueError("batch reading is switched off")
    try:
        raw = spark.read.schema("value string").text(path, wholetext=True, pathGlobFilter=file_filter(params))
        files = shape_files(raw)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "note_id string, path string, raw string")
    if empties:
        files = with_empties(files, empty_files(spark, path, params.extensions))
    if listing is not None:
        raw = F.coalesce(F.col("raw"), F.lit(""))
        files = listing.select("path").join(files.select("path", "raw"), "path", "left")
        files = files.select(note_key(F.col("path"), raw).alias("note_id"), "path", raw.alias("raw"))
    return open_envelopes(files, params)


def notes_from_table(df: DataFrame, key: str, text: str, path: Column | None = None) -> DataFrame:
    """Notes from any table with a text column: parquet, a catalog table, a stream."""
    return df.select(
        F.col(key).cast("string").alias("note_id"),
        (path if path is not None else F.col(key).cast("string")).alias("path"),
        F.coalesce(F.col(text), F.lit("")).alias("raw"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.lit("ok").alias("status"),
        F.lit(None).cast("string").alias("error"),
    )


def with_stem(df: DataFrame) -> DataFrame:
    """Add the name a file's result goes by; not unique, so ``path`` stays the key."""
    return df.withColumn("file_name", file_stem(F.col("path")))
