"""C# declarations: types, first bases and members with their source spans.

Small helpers work on text: one blanks comments, literals and inactive ``#if``
branches of a file, one what stands in brackets, one reads the head of a single
declaration.  What lies between is DataFrame work: braces, semicolons and arrows
become rows; running sums in a window per file give nesting depths; what stands
in bodies is left out; statements are numbered inside the innermost open brace,
and joined to the type that the brace opens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize

MAX_BYTES = 10 * 1024 * 1024

_MARK_COLUMNS = ("mark", "end", "lines", "level", "may_open")
_CODE = T.StructType([T.StructField("masked", T.StringType()), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in _MARK_COLUMNS]])
_TEXTS = ("kind", "name", "base_name", "type_params", "value_type", "params")
HEADING = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in _TEXTS]))
_HEADING = pa.list_(pa.struct([(c, pa.string()) for c in _TEXTS]))

#: Code that one task cuts into statements, whatever the input.
TASK_BYTES = 16 << 20
#: Heads that a worker remembers, of so many characters at most.
KNOWN_HEADS, KNOWN_LENGTH = 1 << 16, 512

# ---- blanking ----

# Every choice starts with a character of its own, so the search skips what none starts with.
_LEXEME = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|\$[$@]*"+|@[$@]*"+|"+|'(?:\\.|[^'\\\n])+'|\#[^\n]*""", re.S)
_IN_STRING = re.compile(r'\\.|"+|\{+|\n', re.S)
_IN_HOLE = re.compile(r"/\*.*?\*/|[$@]*\"+|'(?:\\.|[^'\\\n])+'|[{}]", re.S)
_DIRECTIVE = re.compile(r"^[ \t]*\#[ \t]*(\w+)[ \t]*([^\n]*)", re.M)
_NOT_NEWLINE = re.compile(r"[^\n]")
_BRACKET = re.compile(r"[()\[\]]")
_COMPOUND = re.compile(r"[<>!=+\-*/%&|^?~]=(?!>)")


def _spaces(text: str) -> str:
    return _NOT_NEWLINE.sub(" ", text) if "\n" in text else " " * len(text)


def _string_end(code: str, opening: re.Match) -> int:
    """Just past the literal that ``opening``, its prefix and first quotes, begins."""
    prefix, quotes = opening[0].rstrip('"'), opening[0].count('"')
    holes, verbatim, at = prefix.count("$"), "@" in prefix, opening.end()
    if verbatim or quotes == 1:
        at, quotes = opening.start() + len(prefix) + 1, 1
    elif quotes == 2:
        return at
    while m := _IN_STRING.search(code, at):
        at, mark = m.end(), m[0]
        if mark[0] == '"':
            if quotes > 1 and len(mark) >= quotes or quotes == 1 and verbatim and len(mark) % 2:
                return at
            if quotes == 1 and not verbatim:
                return m.start() + 1
        elif mark[0] == "\\":
            if verbatim or quotes > 1:
                at = m.start() + 1
        elif mark == "\n":
            if quotes == 1 and not verbatim:
                return m.start()
        elif holes and (len(mark) % 2 if quotes == 1 else len(mark) >= holes):
            at = _hole_end(code, at)
    return len(code)


def _hole_end(code: str, at: int) -> int:
    """Just past the brace that closes an interpolated expression."""
    depth = 1
    while m := _IN_HOLE.search(code, at):
        at = m.end()
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            if not depth:
                return at
        elif m[0][-1] == '"':
            at = _string_end(code, m)
    return len(code)


def _holds(condition: str, symbols: set[str]) -> bool:
    """A condition of ``#if``: symbols, ``true``, ``false``, ``!``, ``==``, ``!=``,
    ``&&``, ``||`` and brackets; a malformed one does not hold."""
    marks = re.findall(r"\w+|&&|\|\||==|!=|[!()]", condition.partition("//")[0])

    def one() -> bool:
        mark = marks.pop(0)
        if mark == "!":
            return not one()
        if mark == "(":
            inner = chain(0)
            marks.pop(0)
            return inner
        return mark == "true" or mark in symbols

    def chain(level: int) -> bool:
        if level == 3:
            return one()
        value = chain(level + 1)
        while marks and marks[0] in (("||",), ("&&",), ("==", "!="))[level]:
            mark, other = marks.pop(0), chain(level + 1)
            value = {"||": value or other, "&&": value and other, "==": value == other, "!=": value != other}[mark]
        return value

    try:
        return chain(0)
    except IndexError:
        return False


def blanked(code: str, symbols: frozenset[str] = frozenset()) -> str:
    """The code at the same length, with spaces for comments, literals, lines of
    directives and the branches of ``#if`` that are not taken.

    Symbols are those given and those that the file defines."""
    out, done, at = [], 0, 0
    defined, stack = set(symbols), []  # per open #if: is this branch taken, was any, is the outside active

    def blank(upto: int) -> None:
        nonlocal done
        out.append(_spaces(code[done:upto]))
        done = upto

    while True:
        active = not stack or stack[-1][0]
        m = (_LEXEME if active else _DIRECTIVE).search(code, at)
        if m is None:
            break
        at, begin, told = m.end(), m.start(), None
        if active:
            if m[0][0] == "#":
                begin = code.rfind("\n", 0, begin) + 1
                if code[begin : m.start()].strip(" \t"):  # a directive has its line to itself
                    at = m.start() + 1
                    continue
                told = _DIRECTIVE.fullmatch(m[0])
            elif m[0][-1] == '"' and m[0][0] in '$@"':
                at = _string_end(code, m)
            out.append(code[done:begin])
            done = begin
        else:
            told = m
        blank(at)
        if told is None:
            continue
        word, rest = told.groups()
        if word == "if":
            taken = active and _holds(rest, defined)
            stack.append([taken, taken, active])
        elif word in ("elif", "else") and stack:
            _, before, outside = stack[-1]
            taken = outside and not before and (word == "else" or _holds(rest, defined))
            stack[-1] = [taken, before or taken, outside]
        elif word == "endif" and stack:
            stack.pop()
        elif active and word in ("define", "undef"):
            (defined.add if word == "define" else defined.discard)(rest.split("//")[0].strip())
    if stack and not stack[-1][0]:
        blank(len(code))
    out.append(code[done:])
    return "".join(out)


def outside_brackets(masked: str) -> str:
    """Blanked code at the same length, with spaces for what stands in brackets and
    for signs that end in ``=`` but assign nothing.  Behind a bracket that has no
    partner all is blank, until the brackets even out."""
    out, done, depth = [], 0, 0
    for m in _BRACKET.finditer(masked):
        if not depth:
            out.append(masked[done : m.start()])
            done = m.start()
        depth += 1 if m[0] in "([" else -1
        if not depth:
            out.append(_spaces(masked[done : m.end()]))
            done = m.end()
    out.append(_spaces(masked[done:]) if depth else masked[done:])
    return _COMPOUND.sub("  ", "".join(out))


# ---- the head of one declaration ----

_MODIFIERS = re.compile(
    r"\s*(?:(?:public|private|protected|internal|static|abstract|sealed|partial|readonly|ref|unsafe|new|file|virtual"
    r"|override|extern|async|const|volatile|required|implicit|explicit)\s+)*"
)
_TYPE = re.compile(r"(class|struct|interface|record(?:\s+(?:class|struct))?)\s+(\w+)\s*(<[^:({]*>)?\s*(\(.*?\))?\s*(?::\s*(.*))?$", re.S)
_NAMESPACE = re.compile(r"namespace\s+([\w.]+)\s*$")
_CALL = re.compile(r"(?:(.+?)\s+)?([\w.]+)\s*(?:<[^()]*>)?\s*\(", re.S)
_OPERATOR = re.compile(r"\boperator\s*(?:checked\s+)?([^\s\w(]+|true\b|false\b)?")
_ASSIGN = re.compile(r"(?<![=!<>])=(?![=>])")
_LIST = re.compile(r"(?<!:):(?!:)")


_GROUPS = [("(", re.compile(r"\([^()]*\)")), ("[", re.compile(r"\[[^\[\]]*\]")), ("{", re.compile(r"\{[^{}]*\}")), ("<", re.compile(r"<[\w\s,.?&]*>"))]


@lru_cache(1024)
def _flat(text: str) -> str:
    """The text with what brackets hold filled up, at the same length."""
    for opening, group in _GROUPS:
        found = 1
        while found and opening in text:
            text, found = group.subn(lambda m: "&" * len(m[0]), text)
    return text


def _split(text: str) -> list[str]:
    """Split at the commas outside brackets."""
    cuts = [m.start() for m in re.finditer(",", _flat(text))]
    return [text[a + 1 : b].strip() for a, b in zip([-1, *cuts], [*cuts, len(text)], strict=True)]


def _parameters(text: str) -> str:
    found = []
    for part in _split(text):
        part = re.sub(r"^(?:\[[^\]]*\]\s*)*(?:(?:ref|out|in|this|params|scoped|readonly)\s+)*", "", part.split("=")[0].strip())
        found.append(" ".join(part.split()))
    return ", ".join(p for p in found if p)


def _plain(head: str) -> str:
    """A head without the attributes and modifiers before it."""
    at = 0
    while m := re.compile(r"\s*\[").match(head, at):
        depth, at = 1, m.end()
        while depth and (m := re.compile(r"[\[\]]").search(head, at)):
            depth, at = depth + (1 if m[0] == "[" else -1), m.end()
        if depth:
            return ""
    return head[_MODIFIERS.match(head, at).end() :].strip()


Row = tuple[str, str, str | None, str, str, str]


def _members(head: str, mark: str) -> Iterator[Row]:
    """The members that a head declares.  What looks like a constructor is one where
    its name is the type's."""

    def row(kind: str, name: str, value_type: str = "", params: str = "") -> Row:
        return kind, name, None, "", " ".join(value_type.split()), params

    if not head or re.match(r"(enum|delegate|using|extern)\b", head) or head[0] in "=~":
        return
    cut = _LIST.search(_flat(head)) if mark != "=" and ":" in head else None
    head = head[: cut.start()].rstrip() if cut else head  # this(...), base(...) and constraints
    kind = "Field"
    if event := re.match(r"event\s+", head):
        if mark in "{=>" and mark != "=":
            return
        head, kind = head[event.end() :], "Event"
    elif operator := _OPERATOR.search(head):
        if operator[1]:
            yield row("Operator", operator[1], head[: operator.start()])
        return
    elif indexer := re.search(r"\bthis\s*\[", head):
        yield row("Indexer", "this", head[: indexer.start()])
        return
    elif (call := _CALL.match(head)) and not _ASSIGN.search(_flat(head)[: call.start(2)]):
        name, close = call[2].rpartition(".")[2], _flat(head[call.end() - 1 :])
        params = _parameters(head[call.end() : call.end() - 2 + len(re.match("&*", close)[0])])
        yield row("Method" if call[1] else "Constructor", name, call[1] or "", params)
        return
    elif mark in ("{", "=>"):
        if found := re.match(r"(.*\S)\s+([\w.]+)$", head, re.S):
            yield row("Property", found[2].rpartition(".")[2], found[1])
        return
    value_type = ""
    for i, part in enumerate(_split(head)):
        found = re.match(r"(.*?)(\w+)\s*$", _flat(part).split("=")[0], re.S)
        if found:
            value_type = value_type if i else part[: found.start(2)]
            yield row(kind, found[2], value_type)


def heading(text: str, mark: str) -> list[Row]:
    """What a blanked head declares that ends at ``mark``: a namespace, a type, or
    members; for fields the head is the whole statement."""
    head = _plain(text)
    if mark in ("{", ";"):
        if space := _NAMESPACE.match(head):
            return [("Namespace", space[1], None, "", "", "")]
        if found := _TYPE.match(re.sub(r"\bwhere\b.*", "", head, flags=re.S).strip()):
            base = _split(found[5])[0] if found[5] else None
            return [(found[1].split()[0].capitalize(), found[2], base, (found[3] or "").strip(), "", "")]
    return list(_members(head, mark))


@lru_cache(KNOWN_HEADS)
def _named(text: str, mark: str) -> list[dict]:
    """Files repeat short heads, so a worker reads each of these once."""
    return [dict(zip(_TEXTS, row, strict=True)) for row in heading(text, mark)]


@F.arrow_udf(HEADING)
def _headings(texts: pa.Array, marks: pa.Array) -> pa.Array:
    each = zip(texts.to_pylist(), marks.to_pylist(), strict=True)
    return pa.array([(_named if len(text) <= KNOWN_LENGTH else _named.__wrapped__)(text, mark) for text, mark in each], _HEADING)


# ---- statements and scopes as rows ----

_MARKS = ("{", "}", ";", "=>", "=")
_OPEN, _CLOSE, _END, _ARROW, _IS = range(len(_MARKS))
_MARK = re.compile(r"=>|[{};=]")
_SCOPE_WORD = re.compile(r"\b(?:class|struct|interface|record|namespace)\b")


def _marks(masked: str) -> Iterator[tuple[int, int, int, int, int]]:
    """The marks outside brackets: which one, where it ends, the lines and the open
    braces before it, and whether a word before it may open a type or namespace."""
    flat, at, lines, level = outside_brackets(masked), 0, 0, 0
    for m in _MARK.finditer(flat):
        mark, begin, at = _MARKS.index(m[0]), at, m.end()
        lines += flat.count("\n", begin, at)
        level -= mark == _CLOSE
        yield mark, at, lines, level, int(mark == _OPEN and _SCOPE_WORD.search(flat, begin, at) is not None)
        level += mark == _OPEN


def _code(texts: list[str]) -> pa.Array:
    """Blanked texts with their marks, a list for each of ``_MARK_COLUMNS``."""
    found = [list(_marks(text)) for text in texts]
    ends = pa.array(accumulate(map(len, found), initial=0), pa.int32())
    columns = zip(*chain.from_iterable(found)) if ends[-1].as_py() else [()] * len(_MARK_COLUMNS)
    lists = [pa.ListArray.from_arrays(ends, pa.array(c, pa.int32())) for c in columns]
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), *lists], ["masked", *_MARK_COLUMNS])


def _statements(read: DataFrame) -> DataFrame:
    """``read (_file, _marks)`` to one row per statement that stands in no brace or in
    one that may open a type or namespace: its place, its first mark, and the mark
    ``parent`` that opened the brace (-1 outside all).

    All windows are of one file, so rows stay in the tasks that ``read`` is dealt
    to; columns are numbers, which need no sorting to be put together."""
    rows = read.select("_file", F.posexplode("_marks").alias("i", "m")).select("_file", "i", "m.*")
    opens = F.col("mark") == _OPEN
    # A brace stands in the scope around it, and opens the one inside it.
    around = F.struct(F.col("level"), F.lit(False).alias("opener"))
    inside = F.struct((F.col("level") + 1).alias("level"), F.lit(True).alias("opener"))
    roles = F.when(opens, F.array(around, inside)).otherwise(F.array(around))
    rows = rows.withColumn("_r", F.explode(roles)).select("_file", "i", "mark", "may_open", "end", "lines", "_r.level", "_r.opener")
    by_level = Window.partitionBy("_file", "level").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.when(F.col("opener"), F.when(F.col("may_open") == 1, F.col("i")).otherwise(-2))
    # Bodies hold most statements; only those that stand in what may be a type or namespace are looked at.
    rows = rows.withColumn("parent", F.coalesce(F.last(opened, ignorenulls=True).over(by_level), F.lit(-1))).where("parent > -2").drop("may_open")
    before = Window.partitionBy("_file", "parent").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    latest = lambda when, what: F.last(F.when(when, what), ignorenulls=True).over(before)
    # Behind an assignment or an arrow a brace is part of an expression, which a semicolon ends.
    expression = F.coalesce(latest(F.col("mark").isin(_END, _IS, _ARROW), F.col("mark") != _END), F.lit(False))
    rows = rows.withColumn("stops", F.col("opener") | (F.col("mark") == _END) | ((F.col("mark") == _CLOSE) & ~expression))
    origin = [F.coalesce(latest(F.col("stops"), F.col(c)), F.lit(0)).alias(f"{c}_before") for c in ("end", "lines")]
    number = F.coalesce(F.sum(F.col("stops").cast("int")).over(before), F.lit(0)).alias("number")
    rows = rows.select("*", *origin, number).where(~F.col("opener"))
    told = rows.groupBy("_file", "parent", "number").agg(
        F.min("i").alias("brace"), F.min_by("mark", "i").alias("mark"), F.min_by("end", "i").alias("head_end"), F.min("level").alias("level"),
        F.max("end").alias("end"), F.min("end_before").alias("start"), F.min("lines_before").alias("lines"),
    )
    sign = F.get(F.array(*map(F.lit, _MARKS)), F.col("mark"))
    return told.select("_file", "parent", "level", "start", "end", "lines", "brace", sign.alias("mark"), (F.col("head_end") - F.length(sign)).alias("head_end"))


def _full_names(scopes: DataFrame, first: int, last: int) -> DataFrame:
    """The namespaces and types, at levels ``first`` to ``last``, with their
    ``full_name``: one join per level of nesting puts the name of what is around in front."""
    spaces = scopes.where("kind = 'Namespace' AND mark = ';'").groupBy("_file").agg(F.min_by("name", "start").alias("_space"))
    scopes = scopes.join(spaces, "_file", "left").where("kind <> 'Namespace' OR mark = '{'")
    columns, levels = [c for c in scopes.columns if c != "_space"], []
    for level in range(first, last + 1):  # below 0 where braces close that nothing opened
        here = scopes.where(F.col("level") == level)
        named = here.where("parent = -1").select(*columns, F.concat_ws(".", "_space", "name").alias("full_name"))
        if levels:
            outer = levels[-1].select("_file", F.col("brace").alias("parent"), F.col("full_name").alias("_outer"))
            inner = here.join(outer, ["_file", "parent"])
            named = named.unionByName(inner.select(*columns, F.concat_ws(".", "_outer", "name").alias("full_name")))
        levels.append(named)
    return reduce(DataFrame.unionByName, levels)


def scan_declarations(files: DataFrame, symbols: frozenset[str] = frozenset()) -> DataFrame:
    """``files (path, content)`` to one row per declaration with its ``source``
    text (leading comments included); ``symbols`` are defined for ``#if``.  Null
    and empty contents, and files over 10 MiB, give no rows; repeated files give
    their rows each; other columns are not carried."""

    @F.arrow_udf(_CODE)
    def masked(codes: pa.Array) -> pa.Array:
        return _code([blanked(code, symbols) for code in codes.to_pylist()])

    read, size = files.select("path", "content").where(F.octet_length("content") <= MAX_BYTES), Observation()
    read = read.select("path", "content", masked("content").alias("_c"), F.monotonically_increasing_id().alias("_file"))
    marks = F.arrays_zip(*[F.col(f"_c.{c}").alias(c) for c in _MARK_COLUMNS]).alias("_marks")
    read = read.select("path", "content", F.col("_c.masked").alias("_masked"), marks, "_file")
    read = materialize(read.observe(size, F.sum(F.octet_length("_masked")).alias("bytes")), "code")
    # Texts are dealt out before they become rows, many for each; a task's share does not grow with the input.
    tasks = max(int(read.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size.get["bytes"] or 0) // TASK_BYTES))
    near = _statements(read.select("_file", "_marks").repartition(tasks, "_file"))
    whole = F.col("mark").isin("=", ";")
    text = F.substr("_masked", F.col("start") + 1, F.when(whole, F.col("end") - F.lit(1)).otherwise(F.col("head_end")) - F.col("start"))
    near = near.join(read.drop("_marks").repartition(tasks, "_file").hint("merge"), "_file").withColumn("_text", text)
    blank = F.regexp_count(F.regexp_extract("_text", r"^\s*", 0), F.lit("\n"))
    near = near.select(
        "_file", "path", "parent", "level", "brace", "mark", "start", (F.col("end") - F.col("start")).alias("length"),
        (F.col("lines") + blank + 1).cast("int").alias("line"), F.substr("content", F.col("start") + 1, F.col("end") - F.col("start")).alias("source"),
        F.explode(_headings("_text", "mark")).alias("d"),
    )
    is_scope, nesting = F.col("kind").isin("Namespace", *_TYPE_KINDS), Observation()
    levels = [f(F.when(is_scope, F.col("level"))).alias(f.__name__) for f in (F.min, F.max)]
    near = materialize(near.select("*", "d.*").drop("d").observe(nesting, *levels), "headings")
    names = _full_names(near.where(is_scope), nesting.get["min"] or 0, nesting.get["max"] or 0).withColumnRenamed("full_name", "type_name")
    columns = ["path", "kind", "type_name", *_TEXTS[1:], "start", "length", "line", "source"]
    types = names.where("kind <> 'Namespace'")
    owners = types.select("_file", F.col("brace").alias("parent"), "type_name", F.col("name").alias("_owner"))
    inside = near.where(~is_scope).join(owners, ["_file", "parent"]).where("kind <> 'Constructor' OR name = _owner")
    return types.select(columns).unionByName(inside.select(columns))


_TYPE_KINDS = ("Class", "Struct", "Interface", "Record")
_INDEXED_KINDS = ("Method", "Property", "Field", "Event")


def types_of(found: DataFrame) -> DataFrame:
    """``(full_name, short_name, kind, base_name, path)``; of parts in one file the first."""
    rows = found.where(F.col("kind").isin(*_TYPE_KINDS))
    return rows.groupBy("path", F.col("type_name").alias("full_name")).agg(
        F.first("name").alias("short_name"), F.min_by("kind", "start").alias("kind"),
        F.min_by(F.struct("base_name"), "start")["base_name"].alias("base_name"),
    )


def members_of(found: DataFrame) -> DataFrame:
    """``(type_name, member_name, member_type, path)`` of methods, properties, fields and events."""
    rows = found.where(F.col("kind").isin(*_INDEXED_KINDS))
    return rows.select("type_name", F.col("name").alias("member_name"), F.col("kind").alias("member_type"), "path")


def outline(found: DataFrame, name: str | None = None) -> DataFrame:
    """``(path, type_name, kind, place, signature)``: per type its head, then
    properties, fields and methods; ``name`` is a full or short type name."""
    rows = found.where(F.col("kind").isin(*_TYPE_KINDS, "Property", "Field", "Method"))
    if name:
        last = F.substring_index("type_name", ".", -1)
        rows = rows.where((F.lower("type_name") == name.lower()) | (F.lower(last) == name.lower()))
    head = F.concat("kind", F.lit(": "), "type_name", F.lit(" "), "type_params")
    body = F.concat(F.lit("  "), "kind", F.lit(": "), "value_type", F.lit(" "), "name")
    order = F.when(F.col("kind") == "Property", 1).when(F.col("kind") == "Field", 2).when(F.col("kind") == "Method", 3).otherwise(0)
    text = F.when(order == 0, head).when(order == 3, F.concat(body, F.lit("("), "params", F.lit(")"))).otherwise(body)
    return rows.select("path", "type_name", "kind", F.struct(order.alias("part"), "start").alias("place"), text.alias("signature"))


def member_source(found: DataFrame, name: str, type_name: str | None = None) -> DataFrame:
    """Source of the members of a name (``.ctor``, ``this``, ``indexer`` and operator
    tokens too), of the innermost type ``type_name`` where it is given."""
    asked, kind = name.lower(), F.col("kind")
    named = kind.isin("Method", "Property", "Constructor", "Operator") & (F.lower("name") == asked)
    if asked == ".ctor":
        named = named | (kind == "Constructor")
    if asked in ("this", "indexer"):
        named = named | (kind == "Indexer")
    rows = found.where(named)
    if type_name:
        last = F.substring_index("type_name", ".", -1)
        rows = rows.where((F.lower("type_name") == type_name.lower()) | (F.lower(last) == type_name.lower()))
    return rows.select("path", "type_name", "kind", "name", "line", "source")


def type_source(found: DataFrame, name: str) -> DataFrame:
    """Source of the first type per file with this short or full name."""
    rows = found.where(F.col("kind").isin(*_TYPE_KINDS) & ((F.lower("name") == name.lower()) | (F.lower("type_name") == name.lower())))
    first = F.min_by(F.struct("type_name", "kind", "line", "source"), "start").alias("t")
    return rows.groupBy("path").agg(first).select("path", "t.*")
