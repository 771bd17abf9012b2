"""Notes as they arrive: the batch projections on a stream, with exactly-once output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.deliver import Transport, post_orders
from ..operators.shape import add_payload
from ..params import FileParams, JobParams
from ..plans.batch import process_notes
from ..schema import order_columns
from ..sources.listing import empty_files
from ..sources.notes import file_filter, open_envelopes, shape_files, with_empties


def stream_files(
    spark: SparkSession,
    path: str,
    params: FileParams = FileParams(),
    files_per_trigger: int = 100_000,
    empties: bool = True,
) -> DataFrame:
    """Notes from files as they appear in a folder, empty files (``empties``) as empty notes. The
    limit per trigger bounds the size of one micro-batch, not what is read in the end."""
    raw = (
        spark.readStream.schema("value string")
        .option("pathGlobFilter", file_filter(params))
        .option("maxFilesPerTrigger", files_per_trigger)
        .text(path, wholetext=True)
    )
    files = shape_files(raw)
    if empties:
        files = with_empties(files, empty_files(spark, path, params.extensions, stream=True))
    return open_envelopes(files, params)


def once_per_note(notes: DataFrame, time: str, delay: str) -> DataFrame:
    """Drop notes delivered again within ``delay`` of event time ``time``, and those that arrive
    later than ``delay`` behind the newest one of the batches before. State is kept for that
    long only: a note that comes again after it is a delivery of its own."""
    return notes.withWatermark(time, delay).dropDuplicatesWithinWatermark(["note_id"])


def order_stream(notes: DataFrame, job: JobParams = JobParams()) -> DataFrame:
    """Flat order columns per note. Extraction holds no state, so no watermark is needed."""
    processed = process_notes(notes, job)
    return processed.select(
        "note_id", "path", "file_name", "route", *order_columns("order"), "status", "error"
    )


def write_stream(
    df: DataFrame, path: str, checkpoint: str, form: str = "parquet", trigger: dict | None = None
) -> StreamingQuery:
    """Append to files. The file sink commits a batch as a whole, so a restart or a lost
    executor neither drops nor repeats rows."""
    return (
        df.writeStream.format(form)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def post_stream(
    orders: DataFrame,
    transport: Transport,
    report_path: str,
    checkpoint: str,
    job: JobParams = JobParams(),
    wait: Callable[[float], None] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Post each order and write the delivery report, one folder per batch. A batch that
    runs again replaces its own report; receivers spot repeats by the key."""

    def deliver(batch: DataFrame, batch_id: int) -> None:
        ready = add_payload(batch.filter(F.col("status") == "ok"))
        report = post_orders(ready, transport, job.post, wait)
        report.write.mode("overwrite").parquet(f"{report_path}/batch={batch_id}")

    return (
        orders.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
