"""Whole answers to requests as one text: headings, rows, how many more there are, hints.

Searches run on Spark; what is put together here are the rows of a display, whose
limits are features of the requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search
from ..sources.files import is_allowed, list_folder
from . import render, tools
from .tools import Corpus

# Headings of the sections of a locate request.
HEADINGS = {
    "types": "**C# Types:**",
    "members": "**Members:**",
    "defs": "**XML Defs:**",
    "content": "**Content Matches:**",
    "files": "**Files:**",
}
#: Hits at which a search was cut off, and seconds a file may take in a pattern search.
MOST_HITS, MOST_USAGES, FILE_SECONDS = 100, 50, 1.0


def _texts(rows: DataFrame) -> list[str]:
    return [r["text"] for r in rows.select("text").collect()]


def _names(paths: list[str]) -> str:
    return ", ".join(p.replace("\\", "/").rpartition("/")[2] for p in paths)


def _more(total: int, shown: int, indent: str = "  ", what: str = "more") -> list[str]:
    return [f"{indent}... +{total - shown} {what}"] if total > shown else []


def locate(corpus: Corpus, query: str) -> str:
    """A heading for each section that has hits; members under their kinds."""
    lines = [f"## '{query}'"]
    for name, rows in tools.locate(corpus, query).items():
        got = rows.withColumn("text", render.located_text(name)).collect()
        if not got:
            continue
        lines += ["", HEADINGS[name]]
        if name == "members":
            for kind in dict.fromkeys(r["member_type"] for r in got):
                own = [r for r in got if r["member_type"] == kind]
                lines += [f"  {kind}s:", *(r["text"] for r in own), *_more(own[0]["total"], len(own), "    ")]
        else:
            lines += [*(r["text"] for r in got), *_more(got[0]["total"], len(got))]
    if len(lines) == 1:
        raise LookupError(f"No results for '{query}'.")
    return "\n".join(lines)


def inspect(corpus: Corpus, name: str) -> str:
    """A definition's facts, merged text and classes; else a type's chain, as the edges
    of a graph, and its outline in each of its files."""
    found = tools.inspect(corpus, name)
    if "definition" not in found:
        lines = [f"## C# Type: {name}"]
        chain = _texts(render.chain_lines(found["chain"]).orderBy("depth"))
        if chain:
            lines += ["", "**Inheritance:**", "```mermaid", "graph TD", *(f"    {edge}" for edge in chain), "```"]
        rows = found["outline"].orderBy("path", "type_name", "place").collect()
        for path in dict.fromkeys(r["path"] for r in rows):
            lines += ["", f"**Outline** (`{path}`):", *(r["signature"] for r in rows if r["path"] == path), "---"]
        return "\n".join(lines)
    own, of = found["definition"].first(), corpus.find_def(name).select("path").first()
    lines = [f"## Def: {name}", f"Type: {own['def_type']}"]
    files = sorted(r["path"] for r in found["type_files"].collect())
    lines += [f"C# Class: `{own['def_type']}` ({_names(files)})"] if files else []
    lines += [f"File: `{of['path']}`", "", "**Resolved XML:**", "```xml", *own["xml"], "```"]
    if own["n_lines"] > len(own["xml"]):
        lines.append(f"(Full XML: {own['n_lines']} lines)")
    linked = found["classes"].orderBy("place").collect()
    if linked:
        lines += ["", "**Linked C# Types:**", *(f"- `{r['name']}` ({_names(r['paths'])})" for r in linked)]
        lines += _more(own["n_classes"], len(linked), what="more types")
    return "\n".join(lines)


def trace(corpus: Corpus, symbol: str, mode: str) -> str:
    """Subclasses of a type, or the lines that use a symbol; any mode but
    ``inheritors`` asks for the latter."""
    if mode == "inheritors":
        rows = _texts(render.inheritor_lines(corpus.inheritors(symbol)).orderBy("full_name"))
        return "\n".join([f"Subclasses of '{symbol}':", *rows]) if rows else f"No subclasses of '{symbol}' found."
    hits = tools.shown(search.usages(corpus.files, symbol, most=MOST_USAGES))
    n = hits.count()
    if not n:
        return f"No references to '{symbol}' found."
    cut = ["", f"[Results truncated at {MOST_USAGES}, use a more specific symbol]"] if n >= MOST_USAGES else []
    return "\n".join([f"References to '{symbol}' ({n} found):", "", *_texts(render.usage_blocks(hits)), *cut])


def search_regex(corpus: Corpus, pattern: str, ignoreCase: bool, fileFilter: str | None, seconds: float = FILE_SECONDS) -> str:  # noqa: N803
    """Matching lines by file, and the files that took too long, ten by name."""
    hits, late = search.grep_within(corpus.files, pattern, seconds, ignoreCase, fileFilter, most=MOST_HITS)
    hits = tools.shown(hits)
    told = late.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    named = [r["path"] for r in late.orderBy("path").limit(10).collect()] if told else []
    tail = [f"[Left out, as they took over {seconds:g} s: {told} files, such as {_names(named)}]"] if told else []
    n = hits.count()
    if not n:
        return "\n\n".join([f"No matches for pattern: {pattern}", *tail])
    cut = ["[Results limited, use a more specific pattern]"] if n >= MOST_HITS else []
    return "\n\n".join([f"Regex matches for '{pattern}' ({n} found):", *_texts(render.regex_blocks(hits)), *cut, *tail])


def read_code(corpus: Corpus, path: str, methodName, className, extractClass, startLine: int, lineCount: int) -> str:  # noqa: N803
    """Source in a fence, headed by what it is; of a slice, which lines of how many."""
    if lineCount <= 0:
        raise ValueError("lineCount must be greater than 0")
    rows = tools.read_code(corpus, path, methodName, className, extractClass, startLine, lineCount)
    if "line_no" not in rows.columns:
        sources = [r["source"] for r in rows.orderBy("line").collect()]
        return "\n".join(["```csharp", f"// {extractClass or methodName}", "\n\n".join(sources), "```"])
    got = rows.orderBy("line_no").collect()
    first, last, more = got[0]["line_no"], got[-1]["line_no"], got[0]["more"]
    out = ["```csharp", f"// {_names([path])} (lines {first}-{last} of {last + more})", *(f"L{r['line_no']}: {r['line']}" for r in got), "```"]
    return "\n".join(out + (["", f"[{more} more lines available, use startLine={last}]"] if more else []))


def list_directory(corpus: Corpus, path: str, limit: int) -> str:
    if not is_allowed(path, list(corpus.roots), corpus.checked):
        raise PermissionError("Path outside allowed directories.")
    names, more = list_folder(corpus.files.sparkSession, path, limit)
    return "\n".join([f"`{path}`", *(r["name"] for r in names.collect()), *(["... [more entries available, increase limit]"] if more else [])])


PAGES = {f.__name__: f for f in (locate, inspect, trace, search_regex, read_code, list_directory)}
