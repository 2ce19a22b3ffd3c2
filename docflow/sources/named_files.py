"""Files under their own names, written piece by piece as a Spark data source."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from docflow.operators.results import result_pieces
from docflow.session import materialize, task_count

FORMAT = "docflow_named_files"
STAGING = "_staging-"
# Characters of files that are read before they are handed over.
READ_CHARS = 4 << 20


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it. A path without scheme is local."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), posixpath.abspath(path)


@dataclass
class _Staged(WriterCommitMessage):
    """Where a task has put its files."""

    folder: str


class _Writer(DataSourceArrowWriter):
    """Writes below a staging folder for each attempt; what is committed moves to its place.

    Rows come sorted by file. Each is appended to its file, so neither a file nor a
    document is ever held as a whole. An attempt that fails leaves its files in the staging
    folder, which commit and abort delete. With a name for ``staging`` the folders of committed
    attempts stay there, for tasks to move their files.
    """

    def __init__(self, path: str, staging: str | None = None):
        self.path, self.staging = path.rstrip("/"), staging or f"{STAGING}{uuid.uuid4().hex}"
        self.stays = staging is not None

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Staged:
        store, root = file_system(self.path)
        folder = f"{root}/{self.staging}/{uuid.uuid4().hex}"
        store.create_dir(folder, recursive=True)
        name, out = None, None
        try:
            for batch in batches:
                for file, piece in zip(batch.column("file").to_pylist(), batch.column("piece").to_pylist()):
                    if file != name:
                        if out is not None:
                            out.close()
                        target = f"{folder}/{_inside(file)}"
                        store.create_dir(posixpath.dirname(target), recursive=True)
                        name, out = file, store.open_output_stream(target)
                    out.write((piece or "").encode())
        finally:
            if out is not None:
                out.close()
        return _Staged(folder)

    def commit(self, messages: list[_Staged | None]) -> None:
        store, root = file_system(self.path)
        done = {message.folder for message in messages if message is not None}
        if self.stays:
            if done:
                for found in store.get_file_info(fs.FileSelector(f"{root}/{self.staging}")):
                    if found.path not in done:
                        store.delete_dir(found.path)
            return
        for folder in done:
            _move(store, root, folder)
        _clear(store, f"{root}/{self.staging}")

    def abort(self, messages: list[_Staged | None]) -> None:
        store, root = file_system(self.path)
        _clear(store, f"{root}/{self.staging}")


def _move(store: fs.FileSystem, root: str, folder: str) -> None:
    """Move all files below a staged folder to their places; those moved already are gone from it."""
    made = set()
    for found in store.get_file_info(fs.FileSelector(folder, recursive=True)):
        if found.type == fs.FileType.File:
            target = f"{root}/{posixpath.relpath(found.path, folder)}"
            if (place := posixpath.dirname(target)) not in made:
                store.create_dir(place, recursive=True)
                made.add(place)
            try:
                store.move(found.path, target)
            except FileNotFoundError:
                # Another attempt of this task has moved it.
                if store.get_file_info(target).type != fs.FileType.File:
                    raise


def _clear(store: fs.FileSystem, folder: str) -> None:
    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)


def _inside(file: str | None) -> str:
    """The name as a path below the folder; it must not lead out of it."""
    clean = posixpath.normpath(f"/{file or ''}").lstrip("/")
    if not clean or clean == "." or clean != (file or "").lstrip("/"):
        raise ValueError(f"not a file name: {file!r}")
    return clean


class NamedFiles(DataSource):
    """Data source of the rows (file, piece), sorted by file within partitions."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "file string, piece string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("staging"))


def write_named(pieces: DataFrame, folder: str, order: list[str], files: int | None = None) -> None:
    """Write rows of ``file``, ``piece`` and the ``order`` columns as files of these names below a folder.

    A file holds its pieces in order; a file of this name that was there is replaced. ``file``
    may have folders in it. A null piece is empty. ``folder`` must be in a file system that
    pyarrow reaches (local or shared folders, HDFS, object stores).
    """
    spark = pieces.sparkSession
    spark.dataSource.register(NamedFiles)
    staging = f"{STAGING}{uuid.uuid4().hex}"
    (
        pieces.repartitionByRange(files or task_count(spark), "file")
        .sortWithinPartitions("file", *order)
        .select("file", "piece")
        .write.format(FORMAT)
        .option("staging", staging)
        .mode("append")
        .save(folder)
    )
    store, root = file_system(folder.rstrip("/"))
    # One folder for each task that has written; the files in them are moved by tasks.
    attempts = [found.path for found in store.get_file_info(fs.FileSelector(f"{root}/{staging}", allow_not_found=True))]

    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, place = file_system(folder.rstrip("/"))
        for frame in frames:
            for attempt in frame["attempt"]:
                _move(own, place, attempt)
            yield frame

    try:
        if attempts:
            staged = spark.createDataFrame([(attempt,) for attempt in attempts], "attempt string")
            staged.repartition(len(attempts)).mapInPandas(move, "attempt string").count()
    finally:
        _clear(store, f"{root}/{staging}")


def _shown(path: str) -> str:
    """A path as ``input_file_name`` shows it."""
    return re.sub(r"""[\x00-\x20"<>\[\]\\^`{|}#?%\x7f]""", lambda m: quote(m[0]), path)


def read_named(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` and whole ``value`` of every file below a folder, in tasks of many files.

    Folders are listed by tasks, level by level, and files are dealt by a hash of their names.
    Spark's own readers plan a file on the driver, as one of some thirty of a task. As with them, names
    that begin with ``_`` or ``.`` and empty files are left out, and a path is shown as by ``input_file_name``.
    """
    folder = folder.rstrip("/")

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = file_system(folder)
        for frame in frames:
            for inner in frame["file"]:
                found = store.get_file_info(fs.FileSelector(f"{root}/{inner}".rstrip("/")))
                seen = [x for x in found if not _hidden(x.base_name) and (x.type == fs.FileType.Directory or x.size)]
                rows = [(f"{inner}/{x.base_name}".lstrip("/"), x.type == fs.FileType.Directory) for x in seen]
                if rows:
                    yield pd.DataFrame(rows, columns=["file", "folder"])

    def contents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = file_system(folder)
        rows, size = [], 0
        for frame in frames:
            for inner in frame["file"]:
                with store.open_input_stream(f"{root}/{inner}") as data:
                    value = data.read().decode("utf-8", "replace")
                rows.append((_shown(f"{folder}/{inner}"), value))
                size += len(value)
                if size >= READ_CHARS:
                    yield pd.DataFrame(rows, columns=["path", "value"])
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=["path", "value"])

    tasks = task_count(spark)
    level = spark.createDataFrame([("",)], "file string")
    files = level.filter("false")
    while not level.isEmpty():
        entries = materialize(level.repartition(tasks, "file").mapInPandas(listed, "file string, folder boolean"), "listed")
        files = files.unionByName(entries.filter("not folder").select("file"))
        level = entries.filter("folder").select("file")
    return files.repartition(tasks, F.xxhash64("file")).mapInPandas(contents, "path string, value string")


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def write_result_lines(results: DataFrame, folder: str, files: int | None = None) -> None:
    """Document results as JSON lines in document order, one line a document whatever its pages.

    The parts of a large document are joined as they are written: a line is its head, the
    page results of all parts, and its tail. There is a file for each range of documents;
    reading the files in name order gives all documents in order.
    """
    spark = results.sparkSession
    spark.dataSource.register(NamedFiles)
    ranged = (
        result_pieces(results)
        .repartitionByRange(files or task_count(spark), "document_index")
        .sortWithinPartitions("document_index", "part_index")
    )
    named = ranged.withColumn("file", F.format_string("part-%05d.jsonl", F.spark_partition_id()))
    named.select("file", "piece").write.format(FORMAT).mode("append").save(folder)
