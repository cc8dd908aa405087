"""Results as text: one row per block of text, in the order it is shown.

Hits are of display size here (their limits are features of the searches), so a
group is a few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def _grouped(hits: DataFrame) -> DataFrame:
    return hits.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_no", "preview"))).alias("_h"))


def _numbered(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda h: F.concat(F.lit("  L"), h["line_no"].cast("string"), F.lit(": "), h["preview"])), "\n")


def regex_blocks(hits: DataFrame, most_files: int = 50, per_file: int = 3) -> DataFrame:
    """``(path, text)``: each file's name and its first lines, and how many more
    there are; files in the order of their paths, ``most_files`` at the most."""
    groups = _grouped(hits)
    more = F.size("_h") - per_file
    told = F.when(more > 0, F.concat(F.lit("\n  ... +"), more.cast("string"), F.lit(" more in this file"))).otherwise("")
    text = F.concat(F.lit("`"), file_name(F.col("path")), F.lit("`\n"), _numbered(F.slice("_h", 1, per_file)), told)
    return groups.select("path", text.alias("text")).orderBy("path").limit(most_files)


def usage_blocks(hits: DataFrame) -> DataFrame:
    """``(path, text)``: each file's kind and name, and its lines."""
    kind = F.when(F.endswith("path", F.lit(".xml")), "[XML]").otherwise("[C#]")
    text = F.concat(kind, F.lit(" `"), file_name(F.col("path")), F.lit("`\n"), _numbered(F.col("_h")))
    return _grouped(hits).select("path", text.alias("text")).orderBy("path")


def totals(hits: DataFrame, most: int) -> DataFrame:
    """``(total, truncated)`` of hits that were cut off at ``most``: as many count as cut off."""
    n = F.count(F.lit(1))
    return hits.agg(n.alias("total"), (n >= most).alias("truncated"))


def numbered_lines(rows: DataFrame) -> DataFrame:
    """``(line_no, text)``: lines of a file behind their numbers."""
    return rows.select("line_no", F.concat(F.lit("L"), F.col("line_no").cast("string"), F.lit(": "), "line").alias("text"))


def inheritor_lines(found: DataFrame) -> DataFrame:
    """``(full_name, text)``: types and the names of all their files."""
    files = F.array_join(F.transform("paths", file_name), ", ")
    return found.select("full_name", F.concat(F.lit("- `"), "full_name", F.lit("` ("), files, F.lit(")")).alias("text"))


def _hit(name: Column | str, score: str, rest: Column) -> Column:
    return F.concat(F.lit("- `"), name, F.lit("` ("), F.format_string("%.0f", F.col(score)), F.lit("%) - "), rest)


def located_text(section: str) -> Column:
    """The text of a row in a section of a locate request."""
    if section == "types":
        return _hit("name", "score", file_name(F.col("path")))
    if section == "members":
        return F.concat(F.lit("  "), _hit(F.concat("type_name", F.lit("."), "member_name"), "score", file_name(F.col("path"))))
    if section == "defs":
        tag = F.when(F.col("is_abstract"), " [Abstract]").otherwise("")
        label = F.when(F.col("label") != "", F.concat(F.lit(' "'), "label", F.lit('"'))).otherwise("")
        return _hit("def_name", "score", F.concat("def_type", tag, label))
    if section == "content":
        more = F.when(F.col("more_fields") > 0, F.concat(F.lit(" +"), F.col("more_fields").cast("string"))).otherwise("")
        return F.concat(F.lit("- `"), "def_name", F.lit("` - "), F.array_join("fields", ", "), more)
    return F.concat(F.lit("- "), file_name(F.col("path")), F.lit(" - "), "path")


def locate_lines(sections: dict[str, DataFrame]) -> DataFrame:
    """``(section, place, text)`` of what a locate request found."""
    order, lines = F.monotonically_increasing_id(), []
    for name, rows in sections.items():
        lines.append(rows.coalesce(1).select(F.lit(name).alias("section"), order.alias("place"), located_text(name).alias("text")))
    out = lines[0]
    for more_lines in lines[1:]:
        out = out.unionByName(more_lines)
    return out


def chain_lines(chain: DataFrame) -> DataFrame:
    """``(depth, text)`` of a chain upward, as edges of a graph."""
    return chain.select("depth", F.concat("child", F.lit(" --> "), "parent").alias("text"))
