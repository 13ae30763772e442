"""Exports of many documents as a data source: one folder for each document, files under allowed names, all or nothing.

    exports.register(spark)
    exports.packages(reviewed).write.format("inkveil-exports").mode("append").save(folder)

Rows are (id string, name string, text string). Each task writes its rows, one at a time, into a folder of its own below `_pending-…`;
when all tasks have succeeded, what other attempts left behind goes and one rename publishes the whole job as `run-…`. A task that fails,
or a name that isn't allowed, leaves nothing. In streams a batch is published as `batch-<number>`, once, however often it is tried.

The folder is any address that pyarrow's file systems open, and driver and executors share it.

Defined cases: ids are quoted in folder names (`doc-…`), a null id is `doc`; rows that repeat an id and a name become `doc-…@2` and so on
within a task, and tasks never meet, so no text overwrites another; a null text is an empty file; an empty table publishes an empty
run; long texts are written whole, as UTF-8; further columns are left out.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.review import review_checklist
from .lists import EXPORT_NAMES, PACKAGE_NAMES

FORMAT = "inkveil-exports"
COLUMNS = ("id", "name", "text")


@dataclass
class Written(WriterCommitMessage):
    """Where a task's files are, and how many."""

    folder: str
    files: int


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _exists(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != fs.FileType.NotFound


def _folder_of(id_: str | None, copy: int) -> str:
    return ("doc" if id_ is None else f"doc-{quote(id_, safe='')}") + (f"@{copy}" if copy > 1 else "")


def _write_rows(root: str, pending: str, columns: tuple[int, ...], rows: Iterator) -> Written:
    """The rows in a new folder of `pending`; an error leaves it for the job's abort to remove."""
    files, base = _open(root)
    own, made = f"{base}/{pending}/task-{uuid.uuid4().hex}", 0
    files.create_dir(own, recursive=True)
    for row in rows:
        id_, name, text = (row[i] for i in columns)
        if name not in EXPORT_NAMES:
            raise ValueError(f"not an export: {name}")
        copy = 1
        while _exists(files, f"{own}/{_folder_of(id_, copy)}/{name}"):
            copy += 1
        files.create_dir(f"{own}/{_folder_of(id_, copy)}", recursive=True)
        with files.open_output_stream(f"{own}/{_folder_of(id_, copy)}/{name}") as out:
            out.write((text or "").encode())
        made += 1
    return Written(own, made)


def _publish(root: str, pending: str, final: str, messages: list[Written | None]) -> None:
    files, base = _open(root)
    at, wanted = f"{base}/{pending}", {m.folder.split("/")[-1] for m in messages if m}
    if _exists(files, f"{base}/{final}"):
        return _discard(root, pending)
    files.create_dir(at, recursive=True)
    for found in files.get_file_info(fs.FileSelector(at)):
        if found.base_name not in wanted:
            files.delete_dir(found.path)
    files.move(at, f"{base}/{final}")


def _discard(root: str, pending: str) -> None:
    files, base = _open(root)
    if _exists(files, f"{base}/{pending}"):
        files.delete_dir(f"{base}/{pending}")


class _Batch(DataSourceWriter):
    def __init__(self, root: str, columns: tuple[int, ...]):
        self.root, self.columns, self.run = root, columns, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        return _write_rows(self.root, f"_pending-{self.run}", self.columns, iterator)

    def commit(self, messages: list[Written | None]) -> None:
        _publish(self.root, f"_pending-{self.run}", f"run-{self.run}", messages)

    def abort(self, messages: list[Written | None]) -> None:
        _discard(self.root, f"_pending-{self.run}")


class _Stream(DataSourceStreamWriter):
    """Spark makes this object anew for the tasks of each batch and for its commit, so messages tell where the batch's files are, and the
    names of pending folders begin with what the query's checkpoint gives. A query has one batch at a time, so after a commit or an
    abort all else under such names was left by lost attempts, and goes."""

    def __init__(self, root: str, columns: tuple[int, ...], checkpoint: str):
        self.root, self.columns = root, columns
        self.mark = f"_pending-{hashlib.sha256(checkpoint.encode()).hexdigest()[:16]}-"
        self.pending = self.mark + uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        return _write_rows(self.root, self.pending, self.columns, iterator)

    def commit(self, messages: list[Written | None], batchId: int) -> None:
        pending = next((m.folder.split("/")[-2] for m in messages if m), self.pending)
        _publish(self.root, pending, f"batch-{batchId}", messages)
        self._sweep()

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._sweep()

    def _sweep(self) -> None:
        files, base = _open(self.root)
        for found in files.get_file_info(fs.FileSelector(base, allow_not_found=True)):
            if found.base_name.startswith(self.mark):
                files.delete_dir(found.path)


class ExportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "id string, name string, text string"

    def _target(self, schema: StructType) -> tuple[str, tuple[int, ...]]:
        missing = [c for c in COLUMNS if c not in schema.names]
        if missing or not self.options.get("path"):
            raise ValueError(f"exports need a path and the columns {', '.join(COLUMNS)}; missing: {', '.join(missing) or 'path'}")
        return self.options["path"].rstrip("/"), tuple(schema.names.index(c) for c in COLUMNS)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("exports are only added to a folder: use mode append")
        return _Batch(*self._target(schema))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamWriter:
        if not self.options.get("checkpointLocation"):
            raise ValueError("a stream of exports needs the option checkpointLocation")
        return _Stream(*self._target(schema), self.options["checkpointLocation"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ExportSource)


def packages(reviewed: DataFrame, id_col: str = "doc_id", text_col: str = "clean_text", summary_col: str = "summary") -> DataFrame:
    """(id, name, text): for each row its cleaned text, its summary and the checklist, under the names of a package."""
    texts = (F.col(text_col), F.col(summary_col), F.lit(review_checklist()))
    files = F.array(*(F.struct(F.lit(n).alias("name"), t.alias("text")) for n, t in zip(PACKAGE_NAMES, texts, strict=True)))
    return reviewed.select(F.col(id_col).cast("string").alias("id"), F.explode(files).alias("file")).select("id", "file.*")


__all__ = ["ExportSource", "packages", "register"]
