"""An index that follows its files: what a micro-batch changes is taken out and put
in, and only the buckets that hold changed keys are rewritten.

Beside the relations that searches read, the index keeps what was found in each
file, by path, so that a file's old rows are known when it changes or goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import index, stored
from ..operators.csharp import members_of, scan_declarations, types_of
from ..operators.xml_defs import def_tokens, extract_defs
from ..sources.scratch import materialize

#: What was found in each file; the key is the path.
FOUND = ("declarations", "definitions")

CHANGES = "path string, ext string, content string, deleted boolean"


def _parse(files: DataFrame) -> dict[str, DataFrame]:
    """What files hold, by kind of file."""
    found = {
        "declarations": scan_declarations(files.where("ext = 'cs'")),
        "definitions": extract_defs(files.where("ext = 'xml'")),
    }
    return {name: materialize(rows.select(F.col("path").alias("key"), "*"), name) for name, rows in found.items()}


def _derived(found: dict[str, DataFrame]) -> dict[str, DataFrame]:
    declared, defs = found["declarations"].drop("key"), found["definitions"].drop("key")
    return stored.relations(types_of(declared), members_of(declared), defs, def_tokens(defs))


def create(spark: SparkSession, files: DataFrame, path: str, buckets: int = 32) -> stored.StoredIndex:
    """A new index at ``path`` over ``files (path, ext, content)``."""
    found = _parse(files)
    return stored.write_index(spark, _derived(found) | found, path, buckets)


def apply_changes(own: stored.StoredIndex, changes: DataFrame) -> None:
    """Bring the index up to ``changes (path, ext, content, deleted)``: files that are
    new, changed or deleted.

    Of several rows of one path any may count, so a batch should hold one.  The
    outcome is that of a new index over the files as they are; applying the
    same changes again alters nothing, so a batch that was cut off is repeated."""
    changes = materialize(changes.select("path", "ext", "content", "deleted").dropDuplicates(["path"]), "changes")
    paths = changes.select("path")
    new = _parse(changes.where("NOT deleted").drop("deleted"))
    old = {}
    for name in FOUND:
        beside, _ = own.rows_beside(name, paths.withColumnRenamed("path", "key"))
        old[name] = materialize(beside.join(paths, "path", "left_semi").select(beside.columns), name)
    before, after = _derived(old), _derived(new)

    def touched(name: str) -> DataFrame:
        return materialize(before[name].select("key").unionByName(after[name].select("key")).distinct(), "keys")

    def put(name: str, keys: DataFrame, kept, rows: DataFrame) -> None:
        """In the buckets of ``keys``, the ``kept`` old rows and the new ones."""
        beside, buckets = own.rows_beside(name, keys)
        own.replace_buckets(name, kept(beside).select(beside.columns).unionByName(rows), buckets)

    def of_other_files(rows: DataFrame) -> DataFrame:
        return rows.join(paths, "path", "left_anti")

    keys = {name: touched(name) for name in stored.RELATIONS}
    for name in ("types", "members", "tokens", "defs"):
        put(name, keys[name], of_other_files, after[name])
    # What has no path is told anew, for the names and member keys of the changed files, from the rows above.
    here, _ = own.rows_beside("types", keys["names"])
    name = F.when(F.col("rank") == 0, F.col("full_name")).otherwise(F.col("short_name")).alias("name")
    names = here.where("rank < 2").join(keys["names"], "key", "left_semi").groupBy("key").agg(F.min(name).alias("name"))
    names = materialize(names, "names")
    put("names", keys["names"], lambda rows: rows.join(keys["names"], "key", "left_anti"), names)
    gone = keys["names"].select(F.col("key").alias("_name"))
    grams = index.name_ngrams(names.select("name")).withColumnRenamed("ngram", "key")
    put("grams", keys["grams"], lambda rows: rows.join(gone, F.lower(rows["name"]) == gone["_name"], "left_anti"), grams)
    here, _ = own.rows_beside("members", keys["members"])
    present = materialize(here.join(keys["members"], "key", "left_semi").select("key").distinct(), "member_keys")
    gone_keys = keys["members"].select(F.col("key").alias("member_key"))
    put("member_grams", keys["member_grams"], lambda rows: rows.join(gone_keys, "member_key", "left_anti"), stored.member_grams(present))
    # Last: until here a repeated batch still finds the old rows.
    for found in FOUND:
        put(found, paths.withColumnRenamed("path", "key"), of_other_files, new[found])


def follow(spark: SparkSession, changes: DataFrame, path: str, state: str) -> StreamingQuery:
    """Apply a stream of changes to the index at ``path``, micro-batch by micro-batch,
    until none is left; ``state`` is the stream's checkpoint folder."""

    def apply(batch: DataFrame, _: int) -> None:
        apply_changes(stored.open_index(spark, path), batch)

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", state).trigger(availableNow=True).start()


def changes_since(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """``(path, deleted)``: paths of ``listing (path, stamp)`` that ``seen`` lacks or has
    under another stamp, and those of ``seen`` that are gone."""
    both = listing.select("path", "stamp").join(seen.select("path", F.col("stamp").alias("_stamp")), "path", "full_outer")
    return both.where(~F.col("stamp").eqNullSafe(F.col("_stamp"))).select("path", F.col("stamp").isNull().alias("deleted"))
