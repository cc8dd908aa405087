"""Inheritance: direct children, chains upward, ancestors of definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..sources.scratch import materialize


#: For so many names chains are walked up one by one; for more, all are doubled.
FEW_NAMES = 100


def inheritors(types: DataFrame, symbol: str) -> DataFrame:
    """``(full_name, path, paths)`` of direct children: their base is the symbol, its
    last segment, or a full name whose short name is the symbol.  ``paths`` are
    all of a child's files, ``path`` the smallest."""
    last = symbol.rpartition(".")[2]
    named = types.where(F.lower("short_name") == symbol.lower()).select(F.lower("full_name").alias("_base"))
    spark = types.sparkSession
    asked = spark.createDataFrame([(symbol.lower(),), (last.lower(),)], "_base string").unionByName(named).distinct()
    return children(types.join(asked, F.lower(types["base_name"]) == asked["_base"], "left_semi"))


def children(found: DataFrame) -> DataFrame:
    """``(full_name, path, paths)``: one row per type in any case."""
    return found.groupBy(F.lower("full_name").alias("_key")).agg(
        F.min("full_name").alias("full_name"), F.min("path").alias("path"), F.array_sort(F.collect_set("path")).alias("paths")
    ).drop("_key")


def resolutions(types: DataFrame) -> DataFrame:
    """``(key, child)``: the full name a name stands for, exact before short."""
    exact = types.select(F.lower("full_name").alias("key"), F.lit(0).alias("_p"), "full_name")
    short = types.select(F.lower("short_name").alias("key"), F.lit(1).alias("_p"), "full_name")
    both = exact.unionByName(short)
    return both.groupBy("key").agg(F.min(F.struct("_p", "full_name")).alias("_m")).select("key", F.col("_m.full_name").alias("child"))


def ancestries(steps: DataFrame, most: int) -> DataFrame:
    """``steps (key, item, next)``, one row per key, to ``(key, items)``: the item of
    each key and of those that ``next`` leads to, ``most`` at the most.

    Chains are doubled: one join puts behind each chain the chain of where it
    ends, so a few joins by key reach any depth, for any number of keys."""
    chains, length = steps.select("key", F.array("item").alias("items"), "next"), 1
    while length < most:
        written = Observation()  # how many go on is counted while they are written
        chains = materialize(chains.observe(written, F.count("next").alias("open")), "chains")
        if not written.get.get("open"):
            break
        far = chains.select(F.col("key").alias("_key"), F.col("items").alias("_items"), F.col("next").alias("_next"))
        both = chains.join(far, chains["next"] == far["_key"], "left")
        longer = F.when(F.col("_items").isNull(), F.col("items")).otherwise(F.concat("items", "_items"))
        chains = both.select("key", longer.alias("items"), F.col("_next").alias("next"))
        length *= 2
    return chains.select("key", F.slice("items", 1, most).alias("items"))


def _first_times(items: Column, mark) -> Column:
    """The items up to the first one whose mark has come before: from there on a
    chain only repeats itself."""
    marks = F.transform(items, mark)
    return F.filter(items, lambda x, i: F.array_position(marks, mark(x)) == i + 1)


def inheritance_chains(types: DataFrame, names: DataFrame, most: int = 21) -> DataFrame:
    """``names (name)`` to ``(name, depth, child, parent)`` edges upward.

    A parent that no name resolves to is the last edge; chains stop before a
    repeated child and after ``most`` edges.  Declarations in several files
    count by the smallest path."""
    if names.limit(FEW_NAMES + 1).count() <= FEW_NAMES:
        types = types_above(types, names, most)
    key = resolutions(types)
    links = (
        types.where("base_name IS NOT NULL")
        .groupBy(F.col("full_name").alias("child"))
        .agg(F.min_by("base_name", F.struct("path", "base_name")).alias("parent"))
    )
    links = links.join(key.withColumnRenamed("child", "next"), F.lower("parent") == F.col("key"), "left")
    steps = links.select(F.col("child").alias("key"), F.struct("child", "parent").alias("item"), "next")
    start = names.join(key, F.lower("name") == F.col("key")).select("name", F.col("child").alias("key"))
    found = start.join(ancestries(steps, most), "key")
    edges = F.posexplode(_first_times(F.col("items"), lambda x: F.lower(x["child"])))
    return found.select("name", edges.alias("_i", "_e")).select("name", (F.col("_i") + 1).alias("depth"), "_e.child", "_e.parent")


def types_above(types: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """The rows of ``types`` that may matter to the chains of a few ``names (name)``: all
    that a name on the way up may stand for.  Each step up is a filter over ``types``;
    its names, as many as ``names`` at the most, come to the driver."""
    full, short = F.lower("full_name"), F.lower("short_name")
    met, fresh = set(), {r[0] for r in names.select(F.lower("name")).where("name IS NOT NULL").collect()}
    held = set()
    for _ in range(most + 1):
        if not fresh:
            break
        met |= fresh
        here = types.where(full.isin(fresh) | short.isin(fresh))
        # A name stands for one type, whose parts may name several bases, of which the first counts.
        own = {r["child"] for r in resolutions(here).where(F.col("key").isin(fresh)).select("child").collect()}
        above = types.where(F.col("full_name").isin(own) & F.col("base_name").isNotNull()).groupBy("full_name")
        rows = above.agg(F.min_by("base_name", F.struct("path", "base_name")).alias("base")).select("full_name", F.lower("base").alias("next")).collect()
        held |= fresh | {r["full_name"] for r in rows}
        fresh = {r["next"] for r in rows} - met
    return types.where(full.isin(held) | short.isin(held) | F.col("full_name").isin(held)) if held else types.limit(0)


def def_chains(defs: DataFrame, names: DataFrame, most: int, kept: list[str], mark) -> DataFrame:
    """``names (name)`` to ``(name, items)``: the columns ``kept`` of the definition and
    its parents, ``most`` nodes at the most, without what repeats a ``mark``.

    A parent is looked up by base name, then by definition name.  What is kept is
    carried through all rounds, so it should be short."""
    node = F.struct("path", "def_type", "def_name", "parent_name", *[c for c in kept if c not in _NODE]).alias("item")
    elem, attr = F.lower("def_name_elem"), F.lower("name_attr")
    keyed = defs.select(F.posexplode(F.array(elem, attr)).alias("_p", "key"), node).where("key IS NOT NULL")

    def best(order: Column) -> list[Column]:
        i = F.min(F.struct(order, "item"))["item"]
        return [F.struct(*[i[c].alias(c) for c in kept]).alias("item"), F.lower(i["parent_name"]).alias("next")]

    # Both orders in one pass: definition names come first for a name, base names for a parent.
    first = keyed.groupBy("key").agg(F.struct(*best(F.col("_p"))).alias("named"), F.struct(*best(-F.col("_p"))).alias("above"))
    first = materialize(first, "keyed")
    above = ancestries(first.select("key", "above.*"), most - 1).withColumnRenamed("key", "next")
    start = names.join(first, F.lower("name") == F.col("key")).select("name", "named.*")
    found = start.join(above, "next", "left")
    items = F.concat(F.array("item"), F.coalesce("items", F.array().cast(above.schema["items"].dataType)))
    return found.select("name", _first_times(items, mark).alias("items"))


_NODE = ["path", "def_type", "def_name", "parent_name"]


def def_ancestors(defs: DataFrame, names: DataFrame, most: int = 15) -> DataFrame:
    """``names (name)`` to ``(name, depth, def_type, def_name, path)``: the
    definition at depth 0 and its parents, ``most`` nodes at the most.

    A parent is looked up by base name, then by definition name; a node that
    has been met before ends the chain."""
    chains = def_chains(defs, names, most, ["path", "def_type", "def_name"], lambda x: F.struct(x["def_name"], x["path"]))
    nodes = F.posexplode("items").alias("depth", "_n")
    return chains.select("name", nodes).select("name", "depth", "_n.def_type", "_n.def_name", "_n.path")


def reachable(defs: DataFrame, names: DataFrame, most: int = 15) -> DataFrame:
    """The rows of ``defs`` that may matter to the chains of a few ``names (name)``:
    those of every name on the way up, however many have it.

    Each step up is a filter over ``defs``, which should be written; the names of a
    step, as many as ``names`` at the most, come to the driver."""
    elem, attr = F.lower("def_name_elem"), F.lower("name_attr")
    met, fresh = set(), {r[0] for r in names.select(F.lower("name")).where("name IS NOT NULL").collect()}
    held = set(fresh)
    for step in range(most):
        if not fresh:
            break
        # The first name is looked up by definition name, then by base name; parents the other way.
        keys = [elem, attr] if step == 0 else [attr, elem]
        here = defs.where(elem.isin(fresh) | attr.isin(fresh)).select(F.posexplode(F.array(*keys)).alias("_p", "_key"), F.struct(*_NODE).alias("_n"))
        best = here.where(F.col("_key").isin(fresh)).groupBy("_key").agg(F.min(F.struct("_p", "_n"))["_n"].alias("_n"))
        rows = best.select(F.lower("_n.def_name").alias("own"), F.lower("_n.parent_name").alias("next")).collect()
        fresh = {r["next"] for r in rows if r["next"] is not None} - met
        met |= fresh
        held |= fresh | {r["own"] for r in rows if r["own"] is not None}
    if not held:
        return defs.limit(0)
    return defs.where(elem.isin(held) | attr.isin(held) | F.lower("def_name").isin(held))
