"""One file per row: documents and images under names of their own, parted by folder.

A Python data source writes rows ``(folder, filename, bytes)`` to ``path/folder/filename``.
A task writes its files to a staging folder of its attempt; once all are there it moves
them to their places, which is quick and does the same again if the attempt is repeated, as
names do not hang on tasks.  The driver then drops the staging folder and writes
``_SUCCESS``; if the job fails, it takes away what finished tasks have moved.
The path may be on any store that ``pyarrow.fs`` opens (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from leafpress.functions import urls as U
from leafpress.session import few_tasks, ship_package

NAME = "leafpress_files"


@dataclass
class Moved(WriterCommitMessage):
    """What a task has put in place: how many files, and the file that lists them."""

    files: int
    listed: str


class FileWriter(DataSourceArrowWriter):
    def __init__(self, path: str, run: str):
        self.path, self.run = path, run

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Moved:
        store, root = self._open()
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        staged = f"{root}/_staged-{self.run}/{attempt}"
        store.create_dir(staged, recursive=True)
        names: list[str] = []
        for batch in iterator:
            folders, files, values = (batch.column(c) for c in ("folder", "filename", "bytes"))
            for i in range(batch.num_rows):
                with store.open_output_stream(f"{staged}/{len(names)}") as out:
                    out.write(values[i].as_py() or b"")
                folder = folders[i].as_py()
                names.append(f"{folder}/{files[i].as_py()}" if folder else files[i].as_py())
        listed = f"{root}/_staged-{self.run}/{attempt}.json"
        with store.open_output_stream(listed) as out:
            out.write(json.dumps(names).encode())
        made = set()
        for k, name in enumerate(names):
            folder = f"{root}/{name}".rsplit("/", 1)[0]
            if folder not in made:
                store.create_dir(folder, recursive=True)
                made.add(folder)
            target = f"{root}/{name}"
            if store.get_file_info(target).type != pafs.FileType.NotFound:
                store.delete_file(target)
            store.move(f"{staged}/{k}", target)
        store.delete_dir(staged)
        return Moved(len(names), listed)

    def commit(self, messages: list[Moved | None]) -> None:
        store, root = self._open()
        self._drop(store, root)
        with store.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list[Moved | None]) -> None:
        """Take away what any attempt has moved, told or not: the lists are read before the staging folder goes."""
        store, root = self._open()
        staged = f"{root}/_staged-{self.run}"
        names: set[str] = set()
        for info in store.get_file_info(pafs.FileSelector(staged, allow_not_found=True)):
            if info.path.endswith(".json"):
                with store.open_input_stream(info.path) as f:
                    names.update(json.loads(f.readall() or b"[]"))
        # attempts that still run cannot move anything from here on
        self._drop(store, root)
        for name in names:
            if store.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound:
                store.delete_file(f"{root}/{name}")

    def _drop(self, store: pafs.FileSystem, root: str) -> None:
        staged = f"{root}/_staged-{self.run}"
        if store.get_file_info(staged).type != pafs.FileType.NotFound:
            store.delete_dir(staged)


class FileSink(DataSource):
    """Write-only source; options: ``path``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "folder string, filename string, bytes binary"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        path = self.options["path"]
        if overwrite:
            store, root = pafs.FileSystem.from_uri(path)
            store.create_dir(root, recursive=True)
            store.delete_dir_contents(root)
        return FileWriter(path, uuid.uuid4().hex)


def write_files(files: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write rows ``(folder, filename, bytes)``, unique by folder and name, each to a file; an empty or null folder is ``path`` itself."""
    spark = files.sparkSession
    ship_package(spark)
    spark.dataSource.register(FileSink)
    rows = files.select(F.col("folder").cast("string"), F.col("filename").cast("string"), F.col("bytes").cast("binary"))
    rows.write.format(NAME).mode(mode).option("path", path).save()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(folder, filename, bytes)`` of the files that :func:`write_files` wrote; Spark passes empty files over."""
    files = few_tasks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))
    root = re.sub(r"^[a-z0-9]+:/*|^/+|/+$", "", path)
    inside = F.substring_index("path", f"{root}/", -1)
    folder = F.regexp_extract(inside, r"^(.*)/[^/]*$", 1)
    return files.select(folder.alias("folder"), F.regexp_extract(inside, r"([^/]*)$", 1).alias("filename"), F.col("content").alias("bytes"))


def drop_files(files: DataFrame, path: str) -> None:
    """Delete the files ``(folder, filename)`` in tasks, then ``path`` with what is left there."""
    spark = files.sparkSession
    ship_package(spark)

    def delete(rows: Iterator[Row]) -> None:
        store, root = pafs.FileSystem.from_uri(path)
        for row in rows:
            name = f"{root}/{row.folder}/{row.filename}" if row.folder else f"{root}/{row.filename}"
            if store.get_file_info(name).type == pafs.FileType.File:
                store.delete_file(name)

    files.select("folder", "filename").foreachPartition(delete)
    left = spark._jvm.org.apache.hadoop.fs.Path(path)
    left.getFileSystem(spark._jsc.hadoopConfiguration()).delete(left, True)


def host_folder(url: Column) -> Column:
    """Folder of a page: its host, with what file systems may not take replaced."""
    return F.coalesce(F.nullif(F.regexp_replace(F.lower(U.netloc(url)), r"[^\p{L}\p{N}.-]", "_"), F.lit("")), F.lit("_none"))
