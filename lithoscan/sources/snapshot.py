"""Snapshots of the index relations: one Parquet table each, the size and SHA-256
of every file of theirs, and a manifest, written last and beside the older
ones, which stay as they are."""

from __future__ import annotations

import hashlib
import os
import time
import uuid

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 2
#: Rows a stored file holds at most, so that hashing one whole file stays a small task.
MAX_ROWS = 2_000_000
MANIFEST = "version int, fingerprint string, folder string, built_at timestamp, took_ms long, relations map<string,string>"


class Rejected(Exception):
    """A snapshot that can't be used; the message is the reason."""


def fingerprint(*roots: list[str]) -> str:
    """Digest of the version and the sorted distinct roots of each kind; contents do not count."""
    kinds = [sorted({os.path.normpath(r).lower() for r in kind if r and r.strip()}) for kind in roots]
    return hashlib.sha256(repr((VERSION, kinds)).encode()).hexdigest()


def digest(rows: DataFrame) -> str:
    """Number of rows and a hash of their contents, in any order."""
    each = F.xxhash64(F.to_json(F.struct(*rows.columns))) if rows.columns else F.lit(0)
    told = rows.select(each.alias("h")).agg(F.count(F.lit(1)), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(20,0)"))).first()
    return " ".join(map(str, told))


def file_digests(spark: SparkSession, folder: str, names: list[str]) -> DataFrame:
    """``(relation, file, size, sha256)`` of the stored files below ``folder``; whole
    contents are hashed in tasks, file by file."""
    below = [f"{folder}/{name}" for name in names]
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(below)
    inner = F.split(F.substring_index("path", f"/{folder.rsplit('/', 1)[-1]}/", -1), "/")
    file = F.array_join(F.slice(inner, 2, F.size(inner)), "/")
    return raw.select(inner[0].alias("relation"), file.alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def save(spark: SparkSession, relations: dict[str, DataFrame], path: str, mark: str) -> None:
    """Write the relations to a new folder below ``path``, the digests of their files
    beside them, then the manifest that names the folder."""
    folder, began = uuid.uuid4().hex, time.monotonic()
    for name, rows in relations.items():
        rows.write.option("maxRecordsPerFile", MAX_ROWS).parquet(f"{path}/{folder}/{name}")
    if relations:
        file_digests(spark, f"{path}/{folder}", list(relations)).write.parquet(f"{path}/digests/{folder}")
    told = {name: digest(spark.read.parquet(f"{path}/{folder}/{name}")) for name in relations}
    kinds = "version int, fingerprint string, folder string, took_ms long, relations map<string,string>"
    row = spark.createDataFrame([(VERSION, mark, folder, int(1000 * (time.monotonic() - began)), told)], kinds)
    row.withColumn("built_at", F.current_timestamp()).coalesce(1).write.mode("append").json(f"{path}/manifest")


def _check_files(spark: SparkSession, path: str, folder: str, names: list[str]) -> None:
    """Reject stored files that are missing, or of another size or hash.  Sizes are
    compared first, over listings alone; only where all agree are contents read."""
    try:
        stored = spark.read.parquet(f"{path}/digests/{folder}")
    except AnalysisException as error:
        raise Rejected("digests missing") from error
    try:
        sizes = file_digests(spark, f"{path}/{folder}", names).drop("sha256")
        both = stored.join(sizes.withColumnRenamed("size", "now"), ["relation", "file"], "left")
        off = both.where("now IS NULL OR now <> size").agg(F.min(F.struct(F.col("now").isNotNull().alias("there"), "relation", "file")).alias("m")).first()["m"]
        if off is not None:
            raise Rejected(f"size mismatch: {off.relation}" if off.there else f"file missing: {off.relation}")
        hashes = file_digests(spark, f"{path}/{folder}", names).select("relation", "file", F.col("sha256").alias("now"))
        off = stored.join(hashes, ["relation", "file"]).where("now <> sha256").agg(F.min("relation").alias("m")).first()["m"]
    except AnalysisException as error:
        raise Rejected("file missing: a table's folder") from error
    if off is not None:
        raise Rejected(f"hash mismatch: {off}")


def load(spark: SparkSession, path: str, mark: str, whole: bool = True) -> dict[str, DataFrame]:
    """The relations of the last snapshot.

    :class:`Rejected` tells the reason otherwise: ``manifest missing``, ``manifest
    unreadable``, ``version mismatch``, ``fingerprint mismatch``, ``digests missing``, ``file missing``, ``size
    mismatch`` or ``hash mismatch`` of a stored file, ``table unreadable``, or ``row
    count mismatch`` and ``digest mismatch`` of a table's rows (files that were
    added).  ``whole=False`` leaves the rows' own check out, which reads every
    column once more."""
    try:
        manifest = spark.read.schema(MANIFEST).json(f"{path}/manifest").orderBy(F.col("built_at").desc(), "folder").first()
    except AnalysisException as error:
        raise Rejected("manifest missing") from error
    if manifest is None or manifest.relations is None or manifest.folder is None:
        raise Rejected("manifest unreadable")
    if manifest.version != VERSION:
        raise Rejected("version mismatch")
    if manifest.fingerprint != mark:
        raise Rejected("fingerprint mismatch")
    if manifest.relations:
        _check_files(spark, path, manifest.folder, list(manifest.relations))
    found = {}
    for name, rows in manifest.relations.items():
        try:
            found[name] = spark.read.parquet(f"{path}/{manifest.folder}/{name}")
        except PySparkException as error:
            raise Rejected(f"table unreadable: {name}") from error
        if not whole:
            continue
        now = digest(found[name])
        if now.split(" ")[0] != rows.split(" ")[0]:
            raise Rejected(f"row count mismatch: {name}")
        if now != rows:
            raise Rejected(f"digest mismatch: {name}")
    return found
