"""Posting orders as a Spark sink: ``df.write.format("orders_api")``.

Each task posts its rows and writes their report to a file of its own in a staging folder.
Only when all tasks are done does the driver move the files of the tasks that counted into
the report folder; where the job fails, it deletes what they left. The driver alone makes the
staging folder, so that a task that starts after the end posts nothing and leaves nothing."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.deliver import REPORT_COLUMNS, REPORT_TYPE, Transport, post_rows
from ..params import PostParams
from ..sources.listing import open_folder

FORMAT = "orders_api"
STAGING = "_staging"
CLEAR_TRIES = 5


@dataclass
class Posted(WriterCommitMessage):
    """A task's report file in the staging folder, and how many orders it tells of."""

    file: str
    orders: int


class OrdersWriter(DataSourceWriter):
    def __init__(self, report: str, transport: Transport, params: PostParams, wait: Callable | None, overwrite: bool):
        self.report, self.transport, self.params, self.wait, self.overwrite = report, transport, params, wait, overwrite
        self.run = uuid.uuid4().hex

    def staging(self, folder: str) -> str:
        return posixpath.join(folder, STAGING, self.run)

    def begin(self) -> None:
        """Runs on the driver, before the tasks."""
        store, folder, _ = open_folder(self.report)
        store.create_dir(self.staging(folder), recursive=True)

    def write(self, iterator: Iterator) -> Posted:
        """Runs in a task. An attempt that fails leaves a file that nothing names."""
        from pyarrow.fs import FileType

        store, folder, _ = open_folder(self.report)
        if store.get_file_info(self.staging(folder)).type != FileType.Directory:
            raise FileNotFoundError(f"{self.staging(folder)}: the run has ended")
        name, n = f"part-{uuid.uuid4().hex}.json", 0
        slim = ((row["note_id"], row["idempotency_key"], row["payload"]) for row in iterator)
        with store.open_output_stream(posixpath.join(self.staging(folder), name)) as out:
            for told in post_rows(slim, self.transport, self.params, self.wait):
                out.write((json.dumps(dict(zip(REPORT_COLUMNS, told)), ensure_ascii=False) + "\n").encode())
                n += 1
        return Posted(name, n)

    def commit(self, messages: list) -> None:
        """Runs on the driver, once: moves a file a task, and reads none."""
        store, folder, _ = open_folder(self.report)
        if self.overwrite:
            from pyarrow.fs import FileSelector

            for info in store.get_file_info(FileSelector(folder, allow_not_found=True)):
                if info.base_name.startswith("part-"):
                    store.delete_file(info.path)
        for message in messages:
            if message is not None and message.orders:
                store.move(posixpath.join(self.staging(folder), message.file), posixpath.join(folder, message.file))
        self.clear(store, folder)

    def abort(self, messages: list) -> None:
        store, folder, _ = open_folder(self.report)
        self.clear(store, folder)

    def clear(self, store, folder: str) -> None:
        """Tasks may still run when a job fails; one that opens its file meanwhile keeps the folder from going."""
        from pyarrow.fs import FileType

        for left in reversed(range(CLEAR_TRIES)):
            if store.get_file_info(self.staging(folder)).type != FileType.Directory:
                return
            try:
                store.delete_dir(self.staging(folder))
            except OSError:
                if not left:
                    raise


def orders_sink(transport: Transport, params: PostParams = PostParams(), wait: Callable | None = None, name: str = FORMAT) -> type[DataSource]:
    """A data source of the format ``name`` that posts through ``transport``. Its option ``report``
    is a folder that tasks reach by a path or a URI that Arrow can open. Rows need note_id,
    idempotency_key and payload; mode ``append`` adds to the report, ``overwrite`` replaces it."""

    class OrdersApi(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
            missing = {"note_id", "idempotency_key", "payload"} - set(schema.names)
            if missing:
                raise ValueError(f"orders to post lack {', '.join(sorted(missing))}")
            writer = OrdersWriter(self.options["report"], transport, params, wait, overwrite)
            writer.begin()
            return writer

    return OrdersApi


def post_to_report(
    orders: DataFrame, report: str, transport: Transport, params: PostParams = PostParams(), wait: Callable | None = None, mode: str = "append"
) -> DataFrame:
    """Post all rows of ``orders`` and return the report, as written once all of them were posted.
    A run that fails reports nothing; its orders are posted again with the same keys."""
    spark = orders.sparkSession
    spark.dataSource.register(orders_sink(transport, params, wait))
    slim = orders.select("note_id", "idempotency_key", "payload")
    slim.write.format(FORMAT).option("report", report).mode(mode).save()
    return read_report(spark, report)


def read_report(spark: SparkSession, report: str) -> DataFrame:
    """The committed report; files of runs that did not end are not read."""
    return spark.read.schema(REPORT_TYPE).json(report, pathGlobFilter="part-*.json")

