"""Files of a directory tree as rows, listed and read by the executors.

Spark's binaryFile source drops empty files and names that begin with ``_`` or
``.``; an index must keep the former two. The tree is therefore walked here:
the driver opens folders, without a look at their files, until there are enough
to share out; the executors walk below them and yield names. The names are
spread anew before each file is looked at, so that a flat folder of many files
is not the work of one task, and again by bytes before they are read. A root
with a scheme (``hdfs://``, ``s3://``, ``file://``) is opened through Arrow's
file systems; a plain path must be mounted on every executor.
"""

from __future__ import annotations

import datetime as dt
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.tokens import extension
from palimpsest.schemas import DOCS

ALLOWED = (".txt", ".md")
LISTING = "path string, mtime timestamp, length long"
BATCH = 4096
BATCH_BYTES = 32_000_000
PART_BYTES = 64_000_000  # content that one task reads


def _opened(path: str) -> tuple[pafs.FileSystem | None, str, str]:
    """(file system, path in it, what stands before that); no file system for a plain path."""
    if "://" not in path:
        return None, path, ""
    system, inner = pafs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"


def _entries(folder: str) -> tuple[list[str], list[str]]:
    """(folders, files) in `folder`, files not looked at. Links to folders are not followed; what can't be read is skipped."""
    folders, files = [], []
    try:
        system, inner, before = _opened(folder)
        if system is not None:
            for f in system.get_file_info(pafs.FileSelector(inner)):
                (folders if f.type == pafs.FileType.Directory else files).append(before + f.path)
            return folders, files
        with os.scandir(folder) as found:
            for e in found:
                try:
                    if e.is_dir(follow_symlinks=False):
                        folders.append(e.path)
                    elif not e.is_symlink() or e.is_file():
                        files.append(e.path)
                except OSError:
                    continue
    except OSError:
        pass
    return folders, files


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for folder, deep in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            todo = [folder]
            held: list[str] = []
            while todo:
                folders, files = _entries(todo.pop())
                if deep:
                    todo += folders
                held += files
                while len(held) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(held[:BATCH], pa.string())], names=["path"])
                    held = held[BATCH:]
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["path"])


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size and time of change; what is no file, or gone, is left out."""
    for batch in batches:
        rows = []
        for path in batch.column(0).to_pylist():
            try:
                system, inner, _ = _opened(path)
                if system is not None:
                    f = system.get_file_info(inner)
                    if f.type == pafs.FileType.File:
                        rows.append((path, (f.mtime_ns or 0) // 1000, f.size))
                elif os.path.isfile(path):
                    s = os.stat(path)
                    rows.append((path, s.st_mtime_ns // 1000, s.st_size))
            except OSError:
                continue
        path, mtime, length = map(list, zip(*rows, strict=True)) if rows else ([], [], [])
        time = pa.array(mtime, pa.int64()).cast(pa.timestamp("us", "UTC"))
        yield pa.RecordBatch.from_arrays([pa.array(path, pa.string()), time, pa.array(length, pa.int64())], names=["path", "mtime", "length"])


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime, length) of all files under `root`; an unreadable or missing root has none."""
    shares = 4 * spark.sparkContext.defaultParallelism
    level, above = [root if "://" in root else os.path.abspath(root)], []
    while level and len(level) < shares:
        below = [d for folder in level for d in _entries(folder)[0]]
        if not below:
            break
        above += level
        level = below
    work = [(d, False) for d in above] + [(d, True) for d in level]
    folders = spark.createDataFrame(work, "folder string, deep boolean").repartition(min(len(work), shares))
    return folders.mapInArrow(_walk, "path string").repartition(shares, "path").mapInArrow(_look, LISTING)


def allowed(path: Column) -> Column:
    """Text and markdown files, by an ending in small letters."""
    return extension(path).isin(*ALLOWED)


def hidden(path: Column) -> Column:
    """Any part of the full path begins with a dot."""
    return path.contains("/.")


def wanted(listing: DataFrame, since: dt.datetime | None = None) -> DataFrame:
    """Rows of a listing (path, mtime, ...) that an index run takes up.

    `since`: only files changed at that moment or later. A null path is left
    out; a null mtime counts as changed.
    """
    out = listing.where(allowed(F.col("path")) & ~hidden(F.col("path")))
    return out if since is None else out.where(F.coalesce(F.col("mtime") >= F.lit(since), F.lit(True)))


def _content(path: str) -> bytes | None:
    try:
        system, inner, _ = _opened(path)
        if system is not None:
            with system.open_input_stream(inner) as f:
                return f.read()
        with open(path, "rb") as f:
            return f.read()
    except OSError:
        return None


def _reader(most: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, contents, size = [], [], 0
            for i, path in enumerate(batch.column(0).to_pylist()):
                content = _content(path)
                rows.append(i)
                contents.append(content)
                size += len(content or b"")
                if size >= most:
                    yield _filled(batch, rows, contents)
                    rows, contents, size = [], [], 0
            if rows:
                yield _filled(batch, rows, contents)

    return read


def _filled(batch: pa.RecordBatch, rows: list[int], contents: list[bytes | None]) -> pa.RecordBatch:
    some = batch.take(pa.array(rows))
    return pa.RecordBatch.from_arrays([*some.columns, pa.array(contents, pa.binary())], names=DOCS.names)


def parts_for(listing: DataFrame, threads: int = 1) -> int:
    """Tasks that reading a listing takes: one for about PART_BYTES, `threads` at least, but none without a file."""
    total, files = listing.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1))).first()
    return max(1, min(files, max(threads, listing.sparkSession.sparkContext.defaultParallelism, -(-total // PART_BYTES))))


def read_files(listing: DataFrame, parts: int | None = None, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(path, mtime, length, content); a file that can't be read has null content.

    With `parts` the files are spread over so many tasks, by their names; a
    task holds content of about `batch_bytes`, or of one file, at once.
    """
    spread = listing.select("path", "mtime", "length")
    spread = spread.repartition(parts, "path") if parts else spread
    return spread.mapInArrow(_reader(batch_bytes), "path string, mtime timestamp, length long, content binary")
