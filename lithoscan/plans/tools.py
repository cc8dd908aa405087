"""The composed requests: locate, inspect and read.

Each returns named sections as DataFrames of display size; a section that a
request does not ask for is never planned.  Only facts of one row (is a section
empty, which definition is meant) come to the driver."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import lines_of
from ..operators import csharp, graph, index, search, stored, xml_defs
from ..sources.files import is_allowed, one_file
from ..sources.scratch import materialize
from .query import parse
from .render import chain_lines, file_name

Sections = dict[str, DataFrame]


@dataclass
class Config:
    """Roots to scan, and two switches."""

    csharp_source_paths: tuple[str, ...] = ()
    xml_source_paths: tuple[str, ...] = ()
    skip_path_security: bool = False
    check_updates: bool = True


def load_config(variable: str, beside: str) -> Config:
    """The JSON file that the environment variable names, else ``config.json`` in
    the folder ``beside``.  Keys count in any case and unknown ones are left out;
    a file that is missing or malformed gives the defaults."""
    path = os.environ.get(variable) or os.path.join(beside, "config.json")
    try:
        with open(path, encoding="utf-8-sig") as text:
            told = {k.lower(): v for k, v in json.load(text).items()}
    except (OSError, ValueError, AttributeError):
        return Config()
    found = {f.name: told[key] for f in fields(Config) if (key := f.name.replace("_", "")) in told}
    return Config(**{k: tuple(v or ()) if k.endswith("paths") else bool(v) for k, v in found.items()})


@dataclass
class Corpus:
    """What requests read: ``files``, the declarations found in them, and the definitions."""

    files: DataFrame
    found: DataFrame
    defs: DataFrame
    #: Folders that requests may read from, and whether that is checked.
    roots: tuple[str, ...] = ()
    checked: bool = True
    #: The index over these, where it has been written; searches then read by key.
    stored: stored.StoredIndex | None = None

    @property
    def types(self) -> DataFrame:
        return csharp.types_of(self.found)

    def with_types(self) -> Corpus:
        """The same corpus with its types written, for requests that ask for them more than once."""
        return _Typed(**{f.name: getattr(self, f.name) for f in fields(self)}, written_types=materialize(self.types, "types"))

    @property
    def members(self) -> DataFrame:
        return csharp.members_of(self.found)

    def written(self, path: str, buckets: int = 32) -> Corpus:
        """The same corpus with its index written to ``path``."""
        found = stored.relations(self.types, self.members, self.defs, xml_defs.def_tokens(self.defs))
        return replace(self, stored=stored.write_index(self.files.sparkSession, found, path, buckets))

    def best_types(self, query: str) -> DataFrame:
        if self.stored:
            return stored.fuzzy_types(self.stored, query)
        names = index.name_dictionary(self.types)
        return search.fuzzy_types(names, index.name_ngrams(names), query)

    def best_members(self, keywords: list[str]) -> DataFrame:
        if self.stored:
            return stored.search_members(self.stored, keywords)
        return search.search_members(index.member_keys(self.members), keywords)

    def best_content(self, keywords: list[str], most: int) -> DataFrame:
        if self.stored:
            return stored.search_content(self.stored, keywords, most)
        return search.search_content(xml_defs.def_tokens(self.defs), keywords, most)

    def paths_of_type(self, name: str) -> DataFrame:
        return stored.paths_of_type(self.stored, name) if self.stored else search.paths_of_type(self.types, name)

    def find_def(self, name: str) -> DataFrame:
        return stored.find_def(self.stored, name) if self.stored else search.find_def(self.defs, name)

    def inheritors(self, symbol: str) -> DataFrame:
        return stored.inheritors(self.stored, symbol) if self.stored else graph.inheritors(self.types, symbol)


@dataclass
class _Typed(Corpus):
    written_types: DataFrame | None = None

    @property
    def types(self) -> DataFrame:
        return self.written_types


def paths_of_names(names: DataFrame, types: DataFrame, missing: str) -> DataFrame:
    """``names (name, ...)`` with all ``paths`` of each as a full, else as a short type
    name, and the smallest as ``path``.  The names are a display's few rows, so
    they are broadcast."""
    keyed = types.select(F.explode(F.array(
        F.struct(F.lower("full_name").alias("key"), F.lit(0).alias("rank")),
        F.struct(F.lower("short_name").alias("key"), F.lit(1).alias("rank")),
    )).alias("k"), "path").select("k.*", "path")
    asked = names.select(F.lower("name").alias("key")).distinct()
    per_rank = keyed.join(F.broadcast(asked), "key").groupBy("key", "rank").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    first = per_rank.groupBy("key").agg(F.min_by("paths", "rank").alias("paths"))
    joined = names.join(first, F.lower("name") == F.col("key"), "left")
    none = F.array(F.lit(missing))
    return joined.select(*names.columns, F.coalesce(F.col("paths")[0], F.lit(missing)).alias("path"), F.coalesce("paths", none).alias("paths"))


def shown(rows: DataFrame) -> DataFrame:
    """A section's rows, of display size, fetched once: what is asked of them later
    does not run the search again."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def _best(hits: DataFrame, *order, most: int = 10) -> DataFrame:
    """The best ``most`` of a search's few hits, and how many there are, as ``total``."""
    counted = hits.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy(F.lit(0))))
    return counted.orderBy(F.col("score").desc(), *order).limit(most)


def _with_facts(hits: DataFrame, defs: DataFrame) -> DataFrame:
    """A display's definitions with their ``label``, and whether they are abstract."""
    key = ["def_type", "def_name", "path"]
    own = defs.join(F.broadcast(hits.select(*key)), key).groupBy(*key)
    return hits.join(own.agg(F.min("label").alias("label"), F.bool_or("is_abstract").alias("is_abstract")), key, "left")


def locate(corpus: Corpus, raw: str) -> Sections:
    """Types, members, definitions and content that a search string asks for; files
    only where these are all empty.  Empty sections are left out; each one is
    searched once.  ``total`` counts the hits of a section (of members: of
    their kind), of which the best are shown."""
    asked, out = parse(raw).sections(), {}
    if "types" in asked:
        corpus = corpus.with_types()
        types = corpus.types
        # The few hits are fetched before they are joined, so no join searches again.
        hits = search.collapse_aliases(shown(corpus.best_types(asked["types"])), types)
        hits = shown(_best(hits, F.length("name"), "name"))
        out["types"] = paths_of_names(hits, types, "unknown").orderBy(F.col("score").desc(), F.length("name"), "name")
    if "members" in asked:
        kind = Window.partitionBy("member_type")
        hits = corpus.best_members(asked["members"]).withColumn("total", F.count(F.lit(1)).over(kind))
        place = Window.partitionBy("member_type").orderBy(F.col("score").desc(), F.length("member_name"), *search.MEMBER)
        out["members"] = hits.withColumn("_r", F.row_number().over(place)).where("_r <= 5").orderBy("member_type", "_r").drop("_r")
    if "defs" in asked:
        order = [F.length("def_name"), "def_name", "def_type"]
        hits = shown(_best(search.search_defs(corpus.defs, asked["defs"]), *order))
        out["defs"] = _with_facts(hits, corpus.defs).orderBy(F.col("score").desc(), *order)
    if "content" in asked:
        hits = corpus.best_content(asked["content"], 30).withColumnRenamed("hits", "score")
        hits = _best(hits, F.length("def_name"), "def_name", "def_type").withColumnRenamed("score", "hits")
        more = F.greatest(F.size("fields") - 3, F.lit(0))
        out["content"] = hits.withColumns({"more_fields": more, "fields": F.slice("fields", 1, 3)})
    found = {name: shown(rows) for name, rows in out.items()}
    found = {name: rows for name, rows in found.items() if not rows.isEmpty()}
    return found or {"files": shown(_best(search.search_files(corpus.files, raw), F.length("stem"), "stem", "path"))}


def shortened(lines: Column, most: int = 300, head: int = 200, tail: int = 50) -> Column:
    """More than ``most`` lines: the first and the last ones, and how many lie between."""
    between = F.concat(F.lit("... "), (F.size(lines) - head - tail).cast("string"), F.lit(" lines ..."))
    return F.when(F.size(lines) > most, F.concat(F.slice(lines, 1, head), F.array(between), F.slice(lines, -tail, tail))).otherwise(lines)


def inspect(corpus: Corpus, name: str) -> Sections:
    """A definition with all it inherits, the files of its type and of the classes
    it names; else a type's files, chain upward and outline.  An unknown name is
    a ``LookupError``."""
    spark = corpus.files.sparkSession
    asked = spark.createDataFrame([(name,)], "name string")
    found = corpus.find_def(name).select("def_type").first()
    if found:
        # One definition: the linked classes below are its own, ten at the most.
        whole = xml_defs.resolve_defs(corpus.defs, asked)
        linked = whole.select(F.posexplode("classes").alias("place", "name")).where("place < 10")
        return {
            "definition": whole.select(
                "def_type", "depth", shortened(F.split("xml", "\n")).alias("xml"),
                F.size(F.split("xml", "\n")).alias("n_lines"), F.size("classes").alias("n_classes"),
            ),
            "type_files": corpus.paths_of_type(found["def_type"]),
            "classes": paths_of_names(linked, corpus.types, "not indexed"),
        }
    corpus = corpus.with_types()
    paths = shown(corpus.paths_of_type(name))
    if paths.isEmpty():
        raise LookupError(name)
    return {
        "type_files": paths,
        "chain": graph.inheritance_chains(corpus.types, asked),
        "outline": csharp.outline(corpus.found, name).join(paths, "path", "left_semi"),
    }


def inspect_lines(sections: Sections) -> DataFrame:
    """``(section, place, text)`` of what an inspect request found."""
    if "definition" in sections:
        xml = sections["definition"].select(F.posexplode("xml").alias("place", "text"))
        files = F.array_join(F.transform("paths", file_name), ", ")
        linked = F.concat(F.lit("- `"), "name", F.lit("` ("), files, F.lit(")"))
        parts = {"definition": xml, "classes": sections["classes"].select("place", linked.alias("text"))}
    else:
        order = F.row_number().over(Window.orderBy("path", "type_name", "place")) - 1  # the outline of one type
        parts = {
            "chain": chain_lines(sections["chain"]).withColumnRenamed("depth", "place"),
            "outline": sections["outline"].select(order.alias("place"), F.col("signature").alias("text")),
        }
    rows = [part.select(F.lit(name).alias("section"), "place", "text") for name, part in parts.items()]
    return rows[0].unionByName(rows[1])


def resolve_path(files: DataFrame, path: str, roots: tuple[str, ...] = (), checked: bool = True) -> str | None:
    """The path of one file by its absolute path, where that lies below an allowed
    root, or as the corpus has it; else by its stem, else its name, in any case."""
    if os.path.isabs(path) and os.path.isfile(path) and roots and is_allowed(path, list(roots), checked):
        return path
    asked, name = path.lower(), F.lower(F.element_at(F.split("path", "/"), -1))
    rank = F.when(F.lower("path") == asked, 0).when(F.lower("stem") == asked, 1).when(name == asked, 2)
    row = files.select(rank.alias("_r"), "path").where("_r IS NOT NULL").agg(F.min(F.struct("_r", "path")).alias("m")).first()
    return row["m"]["path"] if row["m"] else None


def read_code(
    corpus: Corpus, path: str, method: str | None = None, class_name: str | None = None,
    extract_class: str | None = None, start: int = 0, count: int = 150,
) -> DataFrame:
    """The source of a whole type, else of a member, else ``count`` lines from the
    0-based ``start``, with how many ``more`` follow.  A file, type or member that
    is not there, or a start behind the last line, is a ``LookupError``."""
    own = resolve_path(corpus.files, path, corpus.roots, corpus.checked)
    if own is None:
        raise LookupError(path)
    files, here = corpus.files.where(F.col("path") == own), corpus.found.where(F.col("path") == own)
    if files.isEmpty():  # an allowed file that is not in the corpus
        files = one_file(corpus.files.sparkSession, own)
        here = csharp.scan_declarations(files)
    if extract_class:
        rows = csharp.type_source(here, extract_class)
    elif method:
        rows = csharp.member_source(here, method, class_name)
    else:
        total = F.size(lines_of(F.col("content"))).alias("_n")
        n = files.select(total).first()["_n"]
        more = max(0, n - max(0, start) - count)
        rows = search.line_slice(files, own, start, count).withColumn("more", F.lit(more))
    if rows.isEmpty():
        raise LookupError(extract_class or method or f"{path}:{start}")
    return rows
