"""Requests by name: their arguments are checked, then the search runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import search
from ..sources.files import is_allowed, list_folder
from . import pages, render, tools
from .tools import Corpus


@dataclass(frozen=True)
class Request:
    """``run(corpus, **arguments)`` returns rows of text; ``required`` arguments are
    strings that may not be empty; ``optional`` ones have defaults, whose types
    are theirs (None stands for a string)."""

    about: str
    run: Callable[..., DataFrame]
    required: tuple[str, ...]
    optional: dict[str, object] = field(default_factory=dict)

    def checked(self, given: dict) -> dict:
        """The arguments with defaults; unknown ones are left out; a ``ValueError``
        says which is missing, empty or of another type."""
        out = {}
        for name in self.required:
            if not isinstance(given.get(name), str) or not given[name]:
                raise ValueError(f"{name} cannot be empty")
            out[name] = given[name]
        for name, default in self.optional.items():
            value = given.get(name, default)
            kind = str if default is None else type(default)
            if value is not None and (not isinstance(value, kind) or kind is int and isinstance(value, bool)):
                raise ValueError(f"{name} must be of type {kind.__name__}")
            out[name] = value
        return out


    def schema(self) -> dict:
        """The arguments as a JSON schema."""
        kinds = {str: "string", bool: "boolean", int: "integer"}
        told = {name: {"type": "string"} for name in self.required}
        for name, default in self.optional.items():
            told[name] = {"type": "string"} if default is None else {"type": kinds[type(default)], "default": default}
        return {"type": "object", "properties": told, "required": list(self.required)}


def _locate(corpus: Corpus, query: str) -> DataFrame:
    sections = tools.locate(corpus, query)
    if all(rows.isEmpty() for rows in sections.values()):
        raise LookupError(query)
    return render.locate_lines(sections)


def _inspect(corpus: Corpus, name: str) -> DataFrame:
    return tools.inspect_lines(tools.inspect(corpus, name))


def _trace(corpus: Corpus, symbol: str, mode: str) -> DataFrame:
    """Any mode but ``inheritors`` asks for usages."""
    if mode == "inheritors":
        return render.inheritor_lines(corpus.inheritors(symbol))
    return render.usage_blocks(search.usages(corpus.files, symbol))


def _read(corpus: Corpus, path: str, methodName, className, extractClass, startLine: int, lineCount: int) -> DataFrame:  # noqa: N803
    if lineCount <= 0:
        raise ValueError("lineCount must be greater than 0")
    rows = tools.read_code(corpus, path, methodName, className, extractClass, startLine, lineCount)
    return render.numbered_lines(rows) if "line_no" in rows.columns else rows.select("line", rows["source"].alias("text"))


def _regex(corpus: Corpus, pattern: str, ignoreCase: bool, fileFilter) -> DataFrame:  # noqa: N803
    hits, late = search.grep_within(corpus.files, pattern, pages.FILE_SECONDS, ignoreCase, fileFilter)
    told = late.orderBy("path").limit(50).select("path", F.concat(F.lit("`"), render.file_name(F.col("path")), F.lit("` took too long")).alias("text"))
    return render.regex_blocks(hits).unionByName(told)


def _folder(corpus: Corpus, path: str, limit: int) -> DataFrame:
    if not is_allowed(path, list(corpus.roots), corpus.checked):
        raise PermissionError(path)
    return list_folder(corpus.files.sparkSession, path, limit)[0].withColumnRenamed("name", "text")


#: The names of requests and of their arguments.
REQUESTS = {
    "locate": Request("Types, members, definitions and files by name", _locate, ("query",)),
    "inspect": Request("A definition with all it inherits, or a type's outline", _inspect, ("name",)),
    "trace": Request("Inheritors or usages of a symbol", _trace, ("symbol", "mode")),
    "read_code": Request(
        "Source of a type, of a member or of some lines", _read, ("path",),
        {"methodName": None, "className": None, "extractClass": None, "startLine": 0, "lineCount": 150},
    ),
    "search_regex": Request("Lines that match a pattern", _regex, ("pattern",), {"ignoreCase": True, "fileFilter": None}),
    "list_directory": Request("Names in a folder", _folder, ("path",), {"limit": 100}),
}


def described() -> list[dict]:
    """Name, description and argument schema of every request, fit for ``json.dumps``."""
    return [{"name": name, "description": own.about, "inputSchema": own.schema()} for name, own in REQUESTS.items()]


def request(corpus: Corpus, called: str, /, **given) -> DataFrame:
    """Run a request by its name; an unknown one is a ``LookupError``."""
    if called not in REQUESTS:
        raise LookupError(called)
    own = REQUESTS[called]
    return own.run(corpus, **own.checked(given))


def answer(corpus: Corpus, called: str, /, **given) -> tuple[str, bool]:
    """The whole text of a request's result, and whether it is an error: an unknown
    name, wrong arguments, a path outside the roots, or nothing that fits."""
    if called not in REQUESTS:
        return f"Unknown request: {called}", True
    try:
        return pages.PAGES[called](corpus, **REQUESTS[called].checked(given)), False
    except (ValueError, LookupError, OSError) as error:
        return str(error.args[-1] if error.args else error), True
