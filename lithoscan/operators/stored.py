"""A stored index: what searches ask for, written once and read by key.

Each relation is a table with a ``key``, dealt over folders by a hash of the key
and sorted by it.  A request reads the folders of its keys only, and inside
them the row groups that may hold them.  A catalogue, written last, names the
relations; an index without one is not there.

| relation | key | columns |
| --- | --- | --- |
| names | name, lower-cased | name |
| grams | 2-gram of a name | name |
| types | full (rank 0) or short (rank 1) name, or base (rank 2), lower-cased | rank, full_name, short_name, base_name, path |
| members | word of a member's name, or all of it | type_name, member_name, member_type, path |
| member_grams | 2-gram of a member key | member_key |
| tokens | token of a definition | field_path, path, def_type, def_name |
| defs | definition name (rank 0) or base name (rank 1), lower-cased | rank, and the definition's columns |
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ngrams
from ..sources import snapshot
from ..sources.scratch import materialize
from . import graph, index, search

RELATIONS = ("names", "grams", "types", "members", "member_grams", "tokens", "defs")

#: A key's rows are written by this many tasks, so a frequent one is not one task's work.
SPREAD = 8

_CATALOGUE = "relation string, buckets int, schema string"


def _keyed(rows: DataFrame, *named: str | None) -> DataFrame:
    """``rows`` with a ``key`` for each of the columns named, in lower case, and its
    place among them as ``rank``; null keys are left out."""
    keys = F.array(*[F.struct(F.lower(c).alias("key"), F.lit(i).alias("rank")) for i, c in enumerate(named)])
    return rows.select(F.explode(keys).alias("_k"), *rows.columns).select("_k.*", *rows.columns).where("key IS NOT NULL")


def member_grams(keys: DataFrame) -> DataFrame:
    """``(key, member_key)``: the different member keys by their 2-grams."""
    every = F.array_distinct(ngrams(F.col("key"), 2, 1 << 30))
    return keys.select("key").distinct().select(F.explode(every).alias("_g"), F.col("key").alias("member_key")).withColumnRenamed("_g", "key")


def relations(types: DataFrame, members: DataFrame, defs: DataFrame, tokens: DataFrame) -> dict[str, DataFrame]:
    """The relations of an index over ``types (full_name, short_name, base_name,
    path)``, ``members``, ``defs`` and the ``tokens`` of definitions."""
    names, keys = index.name_dictionary(types), index.member_keys(members.select(*search.MEMBER))
    return {
        "names": names.select(F.lower("name").alias("key"), "name"),
        "grams": index.name_ngrams(names).withColumnRenamed("ngram", "key"),
        "types": _keyed(types.select("full_name", "short_name", "base_name", "path"), "full_name", "short_name", "base_name"),
        "members": keys,
        "member_grams": member_grams(keys),
        "tokens": tokens.select(F.col("token").alias("key"), "field_path", "path", "def_type", "def_name"),
        "defs": _keyed(defs, "def_name_elem", "name_attr"),
    }


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class StoredIndex:
    """An index at ``path``: per relation the number of buckets and the schema."""

    spark: SparkSession
    path: str
    told: dict[str, tuple[int, str]]

    def whole(self, relation: str) -> DataFrame:
        """All rows of a relation."""
        _, schema = self.told[relation]
        return self.spark.read.schema(schema).parquet(f"{self.path}/{relation}").drop("bucket")

    def rows(self, relation: str, keys: Iterable[str]) -> DataFrame:
        """The rows of some keys, from the buckets of these alone."""
        buckets, schema = self.told[relation]
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/{relation}")
        asked = [F.lit(k) for k in sorted(set(keys))]
        if not asked:
            return stored.drop("bucket").limit(0)
        # Literals: the folders are chosen when the query is planned.
        here = F.col("bucket").isin(*[_bucket(k, buckets) for k in asked])
        return stored.where(here & F.col("key").isin(*asked)).drop("bucket")

    def rows_beside(self, relation: str, keys: DataFrame) -> tuple[DataFrame, list[int]]:
        """All rows of the buckets that ``keys (key)`` fall in, and these buckets: as
        many numbers at most as the relation has buckets."""
        buckets, schema = self.told[relation]
        found = sorted(r[0] for r in keys.select(_bucket(F.col("key"), buckets)).distinct().collect())
        stored = self.spark.read.schema(schema).parquet(f"{self.path}/{relation}")
        return stored.where(F.col("bucket").isin(found) if found else F.lit(False)).drop("bucket"), found

    def replace_buckets(self, relation: str, rows: DataFrame, buckets: list[int]) -> None:
        """Put ``rows``, all in ``buckets``, in place of what is in these.

        The rows are written beside first, so they may come from the buckets that
        they replace.  Doing it again gives the same."""
        rows = materialize(_dealt(rows, self.told[relation][0]), "buckets")
        left = {r[0] for r in rows.select("bucket").distinct().collect()}
        writer = rows.sortWithinPartitions("bucket", "key").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("bucket").parquet(f"{self.path}/{relation}")
        conf, hadoop = self.spark.sparkContext._jsc.hadoopConfiguration(), self.spark.sparkContext._jvm.org.apache.hadoop.fs
        for bucket in set(buckets) - left:  # nothing is left in these
            at = hadoop.Path(f"{self.path}/{relation}/bucket={bucket}")
            at.getFileSystem(conf).delete(at, True)


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows with their bucket, a bucket's rows over several tasks."""
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD))
    return rows.withColumn("bucket", _bucket(F.col("key"), buckets)).repartition("bucket", spread)


def write_index(spark: SparkSession, found: dict[str, DataFrame], path: str, buckets: int = 32, needed: Iterable[str] = RELATIONS) -> StoredIndex:
    """Write the relations to ``path``, then the catalogue; an index that is there
    already is replaced.  Relations that are not ``needed`` may be left out: those
    that no request to this index reads."""
    for name, rows in found.items():
        _dealt(rows, buckets).sortWithinPartitions("bucket", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
    told = [(name, buckets, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", bucket int") for name, rows in found.items()]
    spark.createDataFrame(told, _CATALOGUE).coalesce(1).write.mode("overwrite").parquet(f"{path}/catalogue")
    return open_index(spark, path, needed)


def open_index(spark: SparkSession, path: str, needed: Iterable[str] = RELATIONS) -> StoredIndex:
    """The index at ``path``; :class:`snapshot.Rejected` where there is none, or one
    without some relation that is ``needed``."""
    try:
        rows = spark.read.schema(_CATALOGUE).parquet(f"{path}/catalogue").collect()  # a row for each relation
    except AnalysisException as error:
        raise snapshot.Rejected("catalogue missing") from error
    told = {r.relation: (r.buckets, r.schema) for r in rows}
    if missing := set(needed) - set(told):
        raise snapshot.Rejected(f"relation missing: {', '.join(sorted(missing))}")
    return StoredIndex(spark, path, told)


def export_index(stored: StoredIndex, path: str, mark: str) -> None:
    """A snapshot of all relations of an index."""
    snapshot.save(stored.spark, {name: stored.whole(name) for name in stored.told}, path, mark)


def import_index(spark: SparkSession, path: str, mark: str, target: str, buckets: int = 32) -> StoredIndex:
    """An index made of a snapshot; :class:`snapshot.Rejected` where that can't be used."""
    return write_index(spark, snapshot.load(spark, path, mark), target, buckets)


# ---- searches ----

def _grams(word: str, most: int | None = 50) -> list[str]:
    low = word.lower()
    return [low[i : i + 2] for i in range(len(low) - 1)][:most]


def ngram_candidates(stored: StoredIndex, query: str, most: int = 500) -> DataFrame:
    """``(name, shared)``: names by how many of the query's 2-grams they share."""
    shared = stored.rows("grams", _grams(query)).groupBy("name").agg(F.count(F.lit(1)).alias("shared"))
    return shared.orderBy(F.col("shared").desc(), "name").limit(most)


def fuzzy_types(stored: StoredIndex, query: str, most: int = 20, few: int = 50) -> DataFrame:
    """As :func:`search.fuzzy_types`, by the buckets of the query's 2-grams."""
    return search.best_names(stored.whole("names"), ngram_candidates(stored, query), query, most, few)


def search_members(stored: StoredIndex, keywords: list[str], most: int = 30) -> DataFrame:
    """As :func:`search.search_members`: alike keys come from the buckets of the
    keywords' 2-grams, members from those of the keys that are hit."""
    words = [k.lower() for k in keywords if len(k) >= 2]
    if not words:
        return search.search_members(stored.whole("members"), keywords, most)
    asked = F.explode(F.array(*[
        F.struct(F.lit(i).alias("asked"), F.lit(w).alias("word"), F.array(*map(F.lit, _grams(w))).alias("grams")) for i, w in enumerate(words)
    ])).alias("_a")
    near = stored.rows("member_grams", [g for w in words for g in _grams(w)]).select("key", "member_key", asked)
    near = near.where(F.array_contains("_a.grams", F.col("key"))).select("_a.asked", "_a.word", F.col("member_key").alias("key")).distinct()
    near = near.where((F.length("word") >= 3) | F.startswith(F.col("key"), F.col("word")))
    alike = [r["key"] for r in search.alike_keys(near).collect()]  # ten for each keyword at most
    return search.members_by_hits(stored.rows("members", words + alike), words + alike, keywords, most)


def search_content(stored: StoredIndex, keywords: list[str], most: int = 30) -> DataFrame:
    """As :func:`search.search_content`, by the buckets of the keywords."""
    found = stored.rows("tokens", [k.lower() for k in keywords if len(k) >= 3])
    return search.search_content(found.withColumnRenamed("key", "token"), keywords, most)


def find_def(stored: StoredIndex, name: str) -> DataFrame:
    """As :func:`search.find_def`, by the bucket of the name."""
    found = stored.rows("defs", [name.lower()])
    return found.orderBy("rank", "path", "def_type", "def_name").limit(1).drop("key", "rank")


def paths_of_type(stored: StoredIndex, name: str) -> DataFrame:
    """As :func:`search.paths_of_type`, by the bucket of the name."""
    return search.paths_of_type(stored.rows("types", [name.lower()]).where("rank < 2").drop("key", "rank"), name)


def inheritors(stored: StoredIndex, symbol: str) -> DataFrame:
    """As :func:`graph.inheritors`: full names behind the symbol first, then the
    buckets of all bases it may stand for."""
    named = stored.rows("types", [symbol.lower()]).where("rank = 1").select("full_name").distinct()
    bases = {symbol.lower(), symbol.rpartition(".")[2].lower(), *(r["full_name"].lower() for r in named.collect())}  # types of one short name
    found = stored.rows("types", bases).where("rank = 2").select("full_name", "short_name", "base_name", "path")
    return graph.children(found)
