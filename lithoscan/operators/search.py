"""Fuzzy, keyword and line searches: DataFrames in, DataFrames out.

Sorts end in the name and the path, so results do not depend on partitioning.
Queries become literals or small inline tables; big sides are only filtered,
joined by key and partially aggregated."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clipped, lines_of, ngrams, whole_word, with_fuzzy_score
from ..sources.scratch import materialize

MEMBER = ["type_name", "member_name", "member_type", "path"]

#: Lines that ran into a time limit: how many characters of them a task remembers.
LATE_CHARS = 1 << 20

#: Hits of a search with a time limit; only the path is set for a file that went past it.
TIMED = pa.schema([("path", pa.string()), ("line_no", pa.int32()), ("line", pa.string()), ("file_hits", pa.int32())])


def _best(rows: DataFrame, size: Column, order: list, most: int) -> DataFrame:
    return rows.orderBy(F.col("score").desc(), size, *order).limit(most)


def score_names(names: DataFrame, query: str, most: int = 20) -> DataFrame:
    """``(name, score)``: the best names with a score over 0; the shorter first."""
    scored = with_fuzzy_score(names.select("name"), F.col("name"), query).where("score > 0")
    return _best(scored, F.length("name"), ["name"], most)


def ngram_candidates(grams: DataFrame, query: str, most: int = 500) -> DataFrame:
    """``(name, shared)``: names by how many of the query's 2-grams they share."""
    spark = grams.sparkSession
    asked = spark.range(1).select(F.explode(F.array_distinct(ngrams(F.lit(query)))).alias("ngram"))
    shared = grams.join(F.broadcast(asked), "ngram").groupBy("name").agg(F.count(F.lit(1)).alias("shared"))
    return shared.orderBy(F.col("shared").desc(), "name").limit(most)


def best_names(names: DataFrame, candidates: DataFrame, query: str, most: int = 20, few: int = 50) -> DataFrame:
    """Best names; long queries score only the candidates, unless these are few."""
    if len(query) > 4:
        found = candidates.select("name").collect()  # 500 rows at most
        if len(found) >= few:
            names = names.sparkSession.createDataFrame(found, "name string")
    return score_names(names, query, most)


def fuzzy_types(names: DataFrame, grams: DataFrame, query: str, most: int = 20, few: int = 50) -> DataFrame:
    """Best names; long queries score only those that share most 2-grams, unless these are few."""
    return best_names(names, ngram_candidates(grams, query), query, most, few)


def collapse_aliases(hits: DataFrame, types: DataFrame) -> DataFrame:
    """``(name, score)``: short names replaced by their best full name among the hits."""
    full = hits.join(types.select(F.col("full_name").alias("name"), "short_name").distinct(), "name")
    best = full.groupBy(F.lower("short_name").alias("_key")).agg(
        F.max_by("name", F.struct("score", F.length("name"), "name")).alias("_full")
    )
    named = hits.join(best, F.lower(hits["name"]) == best["_key"], "left")
    return named.groupBy(F.coalesce("_full", "name").alias("name")).agg(F.max("score").alias("score"))


def search_files(files: DataFrame, query: str, most: int = 30) -> DataFrame:
    """``(path, stem, score)``: files by the score of their stem."""
    scored = with_fuzzy_score(files.select("path", "stem"), F.col("stem"), query).where("score > 0").distinct()
    return _best(scored, F.length("stem"), ["stem", "path"], most)


def alike_keys(near: DataFrame, fuzzy_keys: int = 10, prefix_keys: int = 50) -> DataFrame:
    """``near (asked, word, key)``, keys that may be like a keyword, to ``(key)``: those
    that score 60 or more, ten for each keyword.  For two letters the first fifty
    keys are looked at."""
    by_key = Window.partitionBy("asked").orderBy("key")
    short = near.where("length(word) = 2").withColumn("_r", F.row_number().over(by_key)).where(F.col("_r") <= prefix_keys).drop("_r")
    alike = near.where("length(word) >= 3").unionByName(short)
    alike = with_fuzzy_score(alike, F.col("key"), F.col("word")).where("score >= 60")
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.col("score").desc(), "key"))
    return alike.withColumn("_r", rank).where(F.col("_r") <= fuzzy_keys).select("key")


def members_by_hits(keys: DataFrame, hits: list[str] | DataFrame, keywords: list[str], most: int = 30) -> DataFrame:
    """Members of ``keys`` by the keys that are hit; a key may be hit twice."""
    if isinstance(hits, list):
        hits = keys.sparkSession.createDataFrame([(k,) for k in hits], "key string")
    counts = keys.join(F.broadcast(hits), "key").groupBy(*MEMBER).agg(F.count(F.lit(1)).alias("hits"))
    bonus = F.least(F.col("hits") - 1, F.lit(5)) * 10.0
    scored = with_fuzzy_score(counts, F.col("member_name"), "".join(keywords))
    scored = scored.select(*MEMBER, F.least(F.col("score") + bonus, F.lit(100.0)).alias("score"))
    return _best(scored, F.length("member_name"), MEMBER, most)


def search_members(keys: DataFrame, keywords: list[str], most: int = 30, fuzzy_keys: int = 10, prefix_keys: int = 50) -> DataFrame:
    """Members by the keys that match the keywords, exactly and alike.

    A keyword's alike keys share one of its 2-grams (two letters: start with
    it), score 60 or more and are the best ten.  An exact key is also alike
    and so counts twice.  The score is that of the name against all keywords,
    and 10 for each hit but the first, five at most; 100 is the limit."""
    words = [k.lower() for k in keywords if len(k) >= 2]
    spark = keys.sparkSession
    if not words:
        return keys.select(*MEMBER, F.lit(0.0).alias("score")).limit(0)
    asked = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "asked int, word string")
    grams = ngrams(F.col("word"))
    known = keys.select("key").distinct()
    near = F.when(
        F.length("word") >= 3, F.exists(grams, lambda g: F.contains(F.col("key"), g))
    ).otherwise(F.startswith(F.col("key"), F.col("word")))
    # The few keywords are literals of the plan: each distinct key is tested against them.
    literal = F.explode(F.array(*[F.struct(F.lit(i).alias("asked"), F.lit(w).alias("word")) for i, w in enumerate(words)]))
    alike = known.select("key", literal.alias("_a")).select("key", "_a.asked", "_a.word").where(near)
    hit = asked.select(F.col("word").alias("key")).unionByName(alike_keys(alike, fuzzy_keys, prefix_keys))
    return members_by_hits(keys, hit, keywords, most)


def best_per_def(scored: DataFrame) -> DataFrame:
    """The best row of each definition."""
    return (
        scored.groupBy("def_type", "def_name")
        .agg(F.max_by(F.struct("path", "score"), F.struct("score", "path")).alias("_b"))
        .select("def_type", "def_name", "_b.path", "_b.score")
    )


def search_defs(defs: DataFrame, query: str, most: int = 50) -> DataFrame:
    """Definitions by name, base name and label; abstract ones count half."""
    weighted = [("def_name_elem", 1.2), ("name_attr", 1.0), ("label", 0.8)]
    found = F.explode(F.array(*[F.struct(F.col(c).alias("text"), F.lit(w).alias("weight")) for c, w in weighted])).alias("_t")
    rows = defs.select("def_type", "def_name", "path", "is_abstract", found)
    score = F.col("score") * F.col("_t.weight") * F.when(F.col("is_abstract"), 0.5).otherwise(1.0)
    scored = with_fuzzy_score(rows, F.col("_t.text"), query)
    scored = scored.select("def_type", "def_name", "path", score.alias("score")).where("score > 0")
    return _best(best_per_def(scored), F.length("def_name"), ["def_name", "def_type"], most)


def search_content(tokens: DataFrame, keywords: list[str], most: int = 30) -> DataFrame:
    """Definitions by exact tokens of their content; repeated keywords count again."""
    words = [(k.lower(),) for k in keywords if len(k) >= 3]
    asked = tokens.sparkSession.createDataFrame(words, "token string")
    hits = tokens.join(F.broadcast(asked), "token").groupBy("def_type", "def_name").agg(
        F.count(F.lit(1)).alias("hits"), F.array_sort(F.collect_set("field_path")).alias("fields"), F.min("path").alias("path")
    )
    return hits.orderBy(F.col("hits").desc(), F.length("def_name"), "def_name", "def_type").limit(most)


def matching_lines(files: DataFrame, pattern: str, per_file: int, most_lines: int | None = 20_001) -> DataFrame:
    """``(path, line_no, line, file_hits)``: each file's first matching lines.

    The cap per file is applied inside the row, so nothing is shuffled for it."""
    lines = lines_of(F.col("content"))
    if most_lines:
        lines = F.slice(lines, 1, most_lines)
    told = F.transform(lines, lambda line, i: F.struct((i + 1).alias("line_no"), line.alias("line")))
    hits = files.select("path", F.filter(told, lambda x: F.rlike(x["line"], F.lit(pattern))).alias("_h")).where(F.size("_h") > 0)
    return hits.select("path", F.explode(F.slice("_h", 1, per_file)).alias("_l"), F.size("_h").alias("file_hits")).select(
        "path", "_l.line_no", "_l.line", "file_hits"
    )


def grep(files: DataFrame, pattern: str, ignore_case: bool = True, ext: str | None = None, per_file: int = 5, most: int = 100) -> DataFrame:
    """``(path, line_no, preview)``: lines that match a Java pattern.  The
    extension is applied before the cap, so no hit is hidden by it."""
    if ext:
        files = files.where(F.endswith(F.lower("path"), F.lit(ext.lower())))
    if not pattern:
        raise ValueError("pattern cannot be empty")
    found = matching_lines(files, ("(?i)" if ignore_case else "") + pattern, per_file)
    return found.select("path", "line_no", F.trim("line").alias("preview")).orderBy("path", "line_no").limit(most)


def _within(batches: Iterator[pa.RecordBatch], pattern: str, per_file: int, most_lines: int, seconds: float) -> Iterator[pa.RecordBatch]:
    """Rows of ``TIMED`` of ``(path, content)`` rows."""
    asked, ends = regex.compile(pattern), regex.compile(r"\r\n|\n|\r")
    endless, held = set(), 0  # lines that take the whole time alone: a file with one is late
    for batch in batches:
        out = []
        for path, content in zip(*(c.to_pylist() for c in batch.columns)):
            lines = ends.split(content or "")
            lines = lines[: len(lines) - (lines[-1] == "")][:most_lines]
            hits, until = [], time.monotonic() + seconds
            line = ""
            try:
                for i, line in enumerate(lines):
                    if time.monotonic() >= until or line in endless:
                        break
                    if asked.search(line, timeout=seconds):
                        hits.append((i + 1, line))
                late = bool(lines) and time.monotonic() >= until or line in endless
            except TimeoutError:
                late = True
                if held + len(line) <= LATE_CHARS:
                    held += len(line)
                    endless.add(line)
            if late:
                out.append((path, None, None, None))
                continue
            out += [(path, no, line, len(hits)) for no, line in hits[:per_file]]
        columns = zip(*out) if out else [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(columns, TIMED)], schema=TIMED)


def matching_lines_within(files: DataFrame, pattern: str, per_file: int, seconds: float, most_lines: int = 20_001) -> DataFrame:
    """``(path, line_no, line, file_hits)`` as :func:`matching_lines` gives them, but a
    file that takes longer than ``seconds`` has one row with nulls instead.

    A line that takes the whole time by itself makes each file late that holds it, so a
    task tries such a line once.  Spark's own match can't be stopped, so this one runs in Python's ``regex``, whose
    searches take a time limit; its classes (letters, digits, case) are those of
    Unicode.  A malformed pattern is a ``ValueError`` before anything runs; null
    contents have no lines."""
    try:
        regex.compile(pattern)
    except regex.error as error:
        raise ValueError(f"invalid pattern: {error}") from error

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _within(batches, pattern, per_file, most_lines, seconds)

    return files.select("path", "content").mapInArrow(search, "path string, line_no int, line string, file_hits int")


def grep_within(
    files: DataFrame, pattern: str, seconds: float = 1.0, ignore_case: bool = True, ext: str | None = None, per_file: int = 5, most: int = 100
) -> tuple[DataFrame, DataFrame]:
    """What :func:`grep` finds in files that keep within ``seconds``, and ``(path)`` of
    those that do not, whose hits are left out.  The files are read once: their
    hits are written to the shared folder."""
    if not pattern:
        raise ValueError("pattern cannot be empty")
    if ext:
        files = files.where(F.endswith(F.lower("path"), F.lit(ext.lower())))
    found = materialize(matching_lines_within(files, ("(?i)" if ignore_case else "") + pattern, per_file, seconds), "timed_hits")
    hits = found.where("line_no IS NOT NULL").select("path", "line_no", F.trim("line").alias("preview"))
    return hits.orderBy("path", "line_no").limit(most), found.where("line_no IS NULL").select("path")


def usages(files: DataFrame, symbol: str, exts: tuple[str, ...] = ("cs", "xml"), per_file: int = 3, most: int = 50) -> DataFrame:
    """``(path, line_no, preview)``: lines that hold the symbol as a whole word."""
    found = matching_lines(files.where(F.col("ext").isin(*exts)), whole_word(symbol), per_file, None)
    return found.select("path", "line_no", clipped(F.col("line")).alias("preview")).orderBy("path", "line_no").limit(most)


def lookup(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose key equals ``value`` in any case."""
    return rows.where(F.lower(key) == value.lower())


def find_def(defs: DataFrame, name: str, parent_first: bool = False) -> DataFrame:
    """One definition by its name, else by its base name (``parent_first``: the other way round)."""
    a, b = F.lower("def_name_elem") == name.lower(), F.lower("name_attr") == name.lower()
    if parent_first:
        a, b = b, a
    ranked = defs.where(a | b).withColumn("_p", F.when(a, 0).otherwise(1))
    return ranked.orderBy("_p", "path", "def_type", "def_name").limit(1).drop("_p")


def paths_of_type(types: DataFrame, name: str) -> DataFrame:
    """``(path)`` of a type by its full name; only if there is none, by its short name."""
    exact = types.where(F.lower("full_name") == name.lower()).select(F.lit(0).alias("_p"), "path")
    short = types.where(F.lower("short_name") == name.lower()).select(F.lit(1).alias("_p"), "path")
    both = exact.unionByName(short)
    first = both.agg(F.min("_p").alias("_p"))
    return both.join(F.broadcast(first), "_p").select("path").distinct()


def line_slice(files: DataFrame, path: str, start: int = 0, count: int = 150) -> DataFrame:
    """``(line_no, line)``: ``count`` lines from the 0-based ``start`` on."""
    start = max(0, start)
    lines = F.slice(lines_of(F.col("content")), start + 1, count)
    return files.where(F.col("path") == path).select(F.posexplode(lines).alias("_i", "line")).select(
        (F.col("_i") + start + 1).alias("line_no"), "line"
    )
