"""Source trees as DataFrames: scans, listings and the allow-list."""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize

# Folders that a scan leaves out, in any case.
SKIPPED_FOLDERS = ("bin", "obj", ".git", ".vs", ".idea", ".build", "temp")

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
FILES = "path string, stem string, ext string, size long, content string"
FOUND = "path string, is_folder boolean, modificationTime timestamp, length long"

#: Folders a task lists before it gives the rest of its own back, to be dealt out anew.
FOLDERS_A_TASK = 2000
#: Bytes of contents that leave a task at a time.
BATCH_BYTES = 16 << 20


def _named(path):
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext")


def _shape(raw: DataFrame, root: str) -> DataFrame:
    """Rows of ``SCHEMA`` to ``FILES``, without those under a skipped folder below
    ``root``; bytes that are not UTF-8 become U+FFFD."""
    local = F.regexp_replace("path", "^file:/*", "/")
    below = F.substring(local, len(root.rstrip("/")) + 2, 1 << 20) if "://" not in root else F.replace("path", F.lit(root), F.lit(""))
    folders = F.split(F.lower(below), "/")
    inner = F.slice(folders, 1, F.greatest(F.size(folders) - 1, F.lit(0)))
    kept = raw.where(~F.arrays_overlap(inner, F.array(*map(F.lit, SKIPPED_FOLDERS))))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "")
    return kept.select(local.alias("path"), *_named(local), F.col("length").alias("size"), text.alias("content"))


def _entries(folder: str) -> Iterator[tuple[str, bool, datetime, int]]:
    """``(path, is_folder, modified, size)`` of what lies in one folder.  A folder that
    may not be read, or is gone by now, has none; links to folders are
    not followed, so a tree has no cycles."""
    try:
        if "://" not in folder:
            with os.scandir(folder) as entries:
                for e in entries:
                    inner = e.is_dir(follow_symlinks=False)
                    if inner or e.is_file():
                        told = e.stat()
                        yield e.path, inner, datetime.fromtimestamp(told.st_mtime, timezone.utc), told.st_size
            return
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(folder)
        for e in system.get_file_info(fs.FileSelector(place, allow_not_found=True)):
            if e.type in (fs.FileType.File, fs.FileType.Directory):
                inner = e.type == fs.FileType.Directory
                modified = e.mtime or datetime.fromtimestamp(0, timezone.utc)
                yield f"{folder.rstrip('/')}/{e.base_name}", inner, modified, 0 if inner else e.size
    except (PermissionError, FileNotFoundError, NotADirectoryError):
        return


def _walk(tops: list[str], suffixes: tuple[str, ...], most: int) -> Iterator[tuple[str, bool, datetime | None, int]]:
    """Files below ``tops``, skipped folders never entered; folders that are not listed
    yet after ``most`` are given back as folders."""
    ahead, listed = list(tops), 0
    while ahead and listed < most:
        listed += 1
        for path, inner, modified, size in _entries(ahead.pop()):
            name = posixpath.basename(path)
            if not inner:
                if name.endswith(suffixes):
                    yield path, False, modified, size
            elif name.lower() not in SKIPPED_FOLDERS:
                ahead.append(path)
    for path in ahead:
        yield path, True, None, 0


def list_files(
    spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("cs", "xml"), folders_a_task: int = FOLDERS_A_TASK, tasks: int | None = None
) -> DataFrame:
    """``(path, stem, ext, size, modified)`` of all files below ``root`` with one of the
    suffixes; none where there is no such folder.

    Folders are listed in tasks, round by round: each goes down from its own ones
    until it has listed ``folders_a_task``, and gives the others back, which the next
    round deals out to ``tasks`` by a hash.  A tree of n folders so takes about
    n / (tasks * folders_a_task) rounds, at least the two in which it fans
    out, and neither files nor folders pass through the driver."""
    root = f"/{root[5:].lstrip('/')}" if root.startswith("file:") else root
    root = root.rstrip("/") if "://" in root else os.path.abspath(root)
    tasks = tasks or spark.sparkContext.defaultParallelism
    endings = tuple(f".{s}" for s in suffixes)
    rounds, frontier, most = [], spark.createDataFrame([(root,)], "path string"), min(64, folders_a_task)

    while True:
        budget = most

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tops = [p for batch in batches for p in batch.column(0).to_pylist()]
            rows = []
            for row in _walk(tops, endings, budget):
                rows.append(row)
                if len(rows) == 10_000:
                    yield _found(rows)
                    rows = []
            if rows:
                yield _found(rows)

        found = materialize(frontier.mapInArrow(walk, FOUND), "walk")
        rounds.append(found)
        ahead = found.where("is_folder").select("path")
        if ahead.isEmpty():
            break
        frontier, most = ahead.repartition(tasks, "path"), folders_a_task
    files = rounds[0]
    for more in rounds[1:]:
        files = files.unionByName(more)
    return files.where("NOT is_folder").select("path", *_named(F.col("path")), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def _found(rows: list[tuple]) -> pa.RecordBatch:
    path, inner, modified, size = zip(*rows)
    kinds = [pa.string(), pa.bool_(), pa.timestamp("us", "UTC"), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((path, inner, modified, size), kinds)], names=["path", "is_folder", "modificationTime", "length"])


def _read(path: str) -> bytes | None:
    """Whole contents; None where the file is gone or may not be read."""
    try:
        if "://" not in path:
            with open(path, "rb") as data:
                return data.read()
        from pyarrow import fs

        system, place = fs.FileSystem.from_uri(path)
        with system.open_input_stream(place) as data:
            return data.read()
    except (PermissionError, FileNotFoundError):
        return None


def read_files(listed: DataFrame) -> DataFrame:
    """``FILES`` of ``listed (path, stem, ext, size)``, read in tasks that are dealt files
    by a hash of the path; files that can't be read any more are left out."""
    kinds = pa.schema([("path", pa.string()), ("stem", pa.string()), ("ext", pa.string()), ("size", pa.int64()), ("content", pa.binary())])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                data = _read(row["path"])
                if data is None:
                    continue
                rows.append(row | {"content": data, "size": len(data)})
                held += len(data)
                if held > BATCH_BYTES or len(rows) == 1000:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, kinds)

    tasks = max(listed.sparkSession.sparkContext.defaultParallelism, int(listed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = listed.select("path", "stem", "ext", "size").repartition(tasks, "path")
    raw = dealt.mapInArrow(load, "path string, stem string, ext string, size long, content binary")
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "^﻿", "")
    return raw.withColumn("content", text)


def scan_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("cs", "xml")) -> DataFrame:
    """All files below ``root`` with one of the suffixes and their contents.  A missing
    root gives no rows; :func:`list_files` reads no contents."""
    return read_files(list_files(spark, root, suffixes))


def one_file(spark: SparkSession, path: str) -> DataFrame:
    """One file, wherever it lies, in the columns of a scan."""
    return _shape(spark.read.format("binaryFile").load(path), os.path.dirname(path))


def stream_files(spark: SparkSession, root: str, suffixes: tuple[str, ...] = ("cs", "xml")) -> DataFrame:
    """The same as a stream: each file once, when it appears."""
    root = root if "://" in root else os.path.abspath(root)
    raw = (
        spark.readStream.format("binaryFile")
        .schema(SCHEMA)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}")
        .load(root)
    )
    return _shape(raw, root)


def _place(path: str) -> str:
    """The path without ``.`` and ``..``, in lower case; of a remote one, its server as well."""
    scheme, mark, rest = path.rpartition("://")
    return (scheme + mark + posixpath.normpath(rest)).lower()


def is_allowed(path: str, roots: list[str], checked: bool = True) -> bool:
    """Whether an absolute or remote path is a root or lies below one (in any case) and is no symbolic link."""
    if not checked:
        return True
    if not path or not ("://" in path or os.path.isabs(path)) or os.path.islink(path):
        return False
    own = _place(path)
    tops = [_place(r if "://" in r else os.path.abspath(r)) for r in roots if r]
    return any(own == top or own.startswith(top.rstrip("/") + "/") for top in tops)


def list_folder(spark: SparkSession, path: str, limit: int = 100) -> tuple[DataFrame, bool]:
    """``(name)`` of a folder's entries, folders with ``/``, at most ``limit``, in no order;
    and whether there are more.  Of a local or remote folder one name more
    than the limit is asked for, however many there are."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path if "://" in path else "file://" + os.path.abspath(path))
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(at):
        raise FileNotFoundError(path)
    if not system.getFileStatus(at).isDirectory():
        raise NotADirectoryError(path)
    entries, names = system.listStatusIterator(at), []
    while len(names) <= limit and entries.hasNext():
        entry = entries.next()
        names.append((entry.getPath().getName() + "/" * entry.isDirectory(),))
    return spark.createDataFrame(names[:limit], "name string"), len(names) > limit
