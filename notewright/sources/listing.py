"""Names and sizes of files as a Spark source, batch and stream.

Spark's file sources pass over empty files. This one lists folders in tasks, one folder a
task, and gives a row for each file, so that no name goes through the driver."""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "note_files"
SCHEMA = "path string, length long, modified long"
NEVER = -1


def open_folder(path: str):
    """(file system, folder, prefix that makes a name of it a URI again)."""
    from pyarrow.fs import FileSystem

    store, folder = FileSystem.from_uri(path)
    root = path.split("://", 1)[0] + "://" if "://" in path else "file://"
    authority = path.split("://", 1)[1].split("/", 1)[0] if root != "file://" and "://" in path else ""
    return store, folder.rstrip("/"), root + authority


def folders(path: str) -> list[str]:
    """The folders that a path or a pattern names. Patterns may hold ``*``, ``?`` and ``[]``."""
    from pyarrow.fs import FileSelector, FileType

    store, folder, root = open_folder(path) if not any(c in path for c in "*?[") else (None, None, None)
    if store is not None:
        return [root + folder] if store.get_file_info(folder).type == FileType.Directory else []
    parts = path.split("/")
    fixed = next(i for i, part in enumerate(parts) if any(c in part for c in "*?["))
    store, base, root = open_folder("/".join(parts[:fixed]) or "/")
    found = [base]
    for part in parts[fixed:]:
        below = [i for f in found for i in store.get_file_info(FileSelector(f, allow_not_found=True))]
        found = [i.path for i in below if i.type == FileType.Directory and fnmatch.fnmatchcase(i.base_name, part)]
    return [root + f for f in sorted(found)]


def files(folder: str, extensions: tuple[str, ...], empty: bool) -> Iterator[tuple[str, int, int]]:
    """(path, length, time of change in ns) of a folder's note files, sub-folders left out."""
    from pyarrow.fs import FileSelector, FileType

    store, where, root = open_folder(folder)
    for info in store.get_file_info(FileSelector(where, allow_not_found=True)):
        named = info.base_name.endswith(extensions) and not info.base_name.startswith(("_", "."))
        if info.type == FileType.File and named and not (empty and info.size):
            yield root + posixpath.join(where, info.base_name), info.size, info.mtime_ns or 0


class Folder(InputPartition):
    def __init__(self, path: str, since: int = NEVER, until: int | None = None):
        self.path, self.since, self.until = path, since, until


class Listing:
    def __init__(self, options: dict):
        self.path = options["path"]
        self.extensions = tuple(options.get("extensions", ".txt,.json").split(","))
        self.empty = options.get("empty", "false") == "true"

    def list(self, part: Folder | None) -> Iterator[tuple[str, int, int]]:
        if part is None:  # what Spark gives a task where there are no partitions
            return
        for row in files(part.path, self.extensions, self.empty):
            if row[2] > part.since and (part.until is None or row[2] <= part.until):
                yield row


class ListingReader(Listing, DataSourceReader):
    def partitions(self) -> list[Folder]:
        return [Folder(f) for f in folders(self.path)]

    def read(self, partition: Folder | None) -> Iterator[tuple[str, int, int]]:
        yield from self.list(partition)


class ListingStreamReader(Listing, DataSourceStreamReader):
    """Offsets are times of change: a batch has the files changed after the one before it. A
    file that is given an older time than the newest one listed is not seen."""

    def initialOffset(self) -> dict:
        return {"until": NEVER}

    def latestOffset(self) -> dict:
        newest = (row[2] for f in folders(self.path) for row in files(f, self.extensions, self.empty))
        return {"until": max(newest, default=NEVER)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(f, start["until"], end["until"]) for f in folders(self.path)]

    def read(self, partition: Folder | None) -> Iterator[tuple[str, int, int]]:
        yield from self.list(partition)

    def commit(self, end: dict) -> None:
        pass


class NoteFiles(DataSource):
    """Options: ``path``, a folder or pattern of folders; ``extensions``, comma-joined; ``empty``,
    ``true`` for empty files only."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingStreamReader(self.options)


def empty_files(spark: SparkSession, path: str, extensions: tuple[str, ...], stream: bool = False) -> DataFrame:
    """``path`` of every empty note file, batch or stream."""
    spark.dataSource.register(NoteFiles)
    reader = (spark.readStream if stream else spark.read).format(FORMAT)
    return reader.options(path=path, extensions=",".join(extensions), empty="true").load().select("path")
