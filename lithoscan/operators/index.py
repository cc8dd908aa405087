"""Derived index relations: long tables that searches join to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ngrams, split_words


def name_dictionary(types: DataFrame) -> DataFrame:
    """``(name)``: full and short names, one row per name in any case (the smallest)."""
    names = types.select(F.col("full_name").alias("name")).unionByName(types.select(F.col("short_name").alias("name")))
    return names.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name")).select("name")


def name_ngrams(names: DataFrame, n: int = 2) -> DataFrame:
    """``(ngram, name)``, distinct: names are made distinct, then the n-grams inside
    each, so no task holds the pairs."""
    return names.select("name").distinct().select(F.explode(F.array_distinct(ngrams(F.col("name"), n))).alias("ngram"), "name")


def member_keys(members: DataFrame) -> DataFrame:
    """``(key, members' columns)``, distinct: lower-cased words of two characters or more, and the whole name."""
    name = F.col("member_name")
    words = F.filter(F.transform(split_words(name), lambda w: F.lower(w)), lambda w: F.length(w) >= 2)
    keys = F.array_distinct(F.concat(words, F.array(F.lower(name))))
    return members.dropDuplicates().select(F.explode(keys).alias("key"), "*")


def posting_lists(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``(key, value)`` distinct, keys in lower case."""
    return rows.select(F.lower(key).alias("key"), F.col(value).alias("value")).where("key IS NOT NULL").dropDuplicates()


def new_files(listing: DataFrame, seen: DataFrame, key: str = "path") -> DataFrame:
    """Rows of ``listing`` whose key has not been processed yet, in any case."""
    done = seen.select(F.lower(key).alias("_seen")).distinct()
    return listing.join(done, F.lower(listing[key]) == done["_seen"], "left_anti")
