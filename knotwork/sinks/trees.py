"""Files as a sink: one file for each row, written by the executors beside the old tree and put in its place as a whole."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def _store(at: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(at) if "://" in at or at.startswith("file:") else (fs.LocalFileSystem(), at)


@dataclass
class Written(WriterCommitMessage):
    files: int


class TreeWriter(DataSourceArrowWriter):
    """Tasks write below a staging folder. A file appears under its name only when it is complete, so a task that runs twice does no harm; commit renames folders, abort removes the staging."""

    def __init__(self, options: dict[str, str]):
        self.add = options.get("add") == "true"
        self.at, self.staging, self.keep = options["path"].rstrip("/"), options["staging"], [k for k in options.get("keep", "").split("|") if k]
        store, top = _store(self.staging)
        store.create_dir(top, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, top = _store(self.staging)
        made, n = set(), 0
        for b in iterator:
            for name, text in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                path = f"{top}/{checked(name)}"
                folder = posixpath.dirname(path)
                if folder not in made:
                    if store.get_file_info(top).type == fs.FileType.NotFound:
                        raise RuntimeError("the run was aborted")  # by another task's failure
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                part = f"{folder}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as f:
                    f.write((text or "").encode("utf-8", "surrogatepass"))
                store.move(part, path)
                n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        store, at = _store(self.at)
        new, old = _store(self.staging)[1], f"{at}.old-{uuid.uuid4().hex}"
        there = lambda p: store.get_file_info(p).type != fs.FileType.NotFound
        if self.add:
            return
        if there(at):
            store.move(at, old)
        store.create_dir(posixpath.dirname(at), recursive=True)
        store.move(new, at)
        if there(old):
            for k in self.keep:  # what stays is moved over and not copied
                if there(f"{old}/{k}"):
                    if there(f"{at}/{k}"):
                        store.delete_dir(f"{at}/{k}")
                    store.move(f"{old}/{k}", f"{at}/{k}")
            store.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        store, new = _store(self.staging)
        if self.add:
            return  # files that are complete stay
        if store.get_file_info(new).type != fs.FileType.NotFound:
            store.delete_dir(new)


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "path string, content string"

    def writer(self, schema: StructType, overwrite: bool) -> TreeWriter:
        return TreeWriter(dict(self.options))


def checked(name: str | None) -> str:
    """A relative path that stays below its root."""
    parts = (name or "").split("/")
    if not name or any(p in ("", ".", "..") for p in parts) or "\0" in name:
        raise ValueError(f"not a path below the root: {name!r}")
    return name


def write_tree(rows: DataFrame, at: str, keep: tuple[str, ...] = ()) -> None:
    """Rows (path, content) as files below the folder `at`, in place of all that was there but the folders to keep.

    at is a folder that driver and executors share, plain or with a scheme that Arrow's file systems know. Null contents are empty files.
    Paths that repeat, and paths that lead out of the folder, are an error, and then the old tree stays as it is; so it does if a task
    fails for good. No rows leave an empty folder.
    """
    at = at.rstrip("/")
    _write(rows, at, staging=f"{at}.new-{uuid.uuid4().hex}", keep="|".join(keep))


def add_files(rows: DataFrame, at: str) -> None:
    """As write_tree, but into what is there: files of the same paths are replaced one by one, others stay, also if a task fails."""
    at = at.rstrip("/")
    _write(rows, at, staging=at, add="true")


def _write(rows: DataFrame, at: str, **options: str) -> None:
    rows.sparkSession.dataSource.register(FileTree)
    rows = rows.select("path", F.col("content").cast("string").alias("content"))
    parts = F.split("path", "/")
    out = F.col("path").isNull() | F.exists(parts, lambda x: x.isin("", ".", "..")) | F.contains("path", F.lit("\0"))
    bad = rows.where(out).limit(3).collect()
    if bad:
        raise ValueError(f"not a path below the root: {[r.path for r in bad]}")
    twice = rows.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").limit(3).collect()
    if twice:
        raise ValueError(f"paths repeat: {sorted(repr(r.path) for r in twice)}")
    rows.write.format("file_tree").options(**options).mode("append").save(at)
