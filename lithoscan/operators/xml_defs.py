"""XML definitions: extraction, tokens, inheritance and linked classes.

Files are parsed once, in parallel; ancestors are found by joins; chains, of 15
nodes as a rule, are numbers, and are merged in the order of their nodes, so that
what chains share is read and merged once in a part.
"""

from __future__ import annotations

import copy
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import partial
from itertools import islice
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import materialize
from . import graph

# Elements whose children are appended on inheritance, in any case.
LIST_CONTAINERS = frozenset("""
    comps stages modExtensions lifeStages hediffGivers parts verbs tools abilities hediffFilters disallowedTraits
    tags weaponTags apparelTags tradeTags thoughtContexts recipeUsers thingCategories researchPrerequisites
    skillRequirements descriptionHyperlinks forcedTraits disallowedTraitsWithDegree nullifyingTraitDegrees
    agreeableTraits disagreeableTraits disallowedThingDefs apparelRequired techHediffsRequired fixedInventory
    requirementSet fixedIngredientFilter defaultIngredientFilter requirementTags exclusionTags blacklistedGenders
    whiteListedGenders hediffClassList requiredHediffs requiredGeneDefs disallowedGenes startingResearchProjects
    addDesignators addDesignatorGroups
""".split())
_GATHERED = {name.lower() for name in LIST_CONTAINERS}

# Elements that name a class, beside all that end in Class or Worker.
CLASS_ELEMENTS = "modextension thinktree lordjob drawstyletype workertype worlddrawlayer designatortype".split()

DEPTH = 3

#: How much text a file's entities may come to, and how deep they may be nested.
ENTITY_CHARS, ENTITY_DEPTH = 1 << 20, 8

_REFERENCE = re.compile(r"&([^\s#;&]+);")

#: Definitions that a task hands over at a time.
BATCH_DEFS = 1000

#: Chains that a task merges, whatever the input, and the parts of these: it holds the texts of one at a time.
TASK_CHAINS, TASK_PARTS = 20_000, 4

_FIELD = pa.struct([("field_path", pa.string()), ("name", pa.string()), ("leaf_text", pa.string())])
_DEF = pa.schema([
    ("path", pa.string()), ("position", pa.int32()), ("def_type", pa.string()), ("def_name", pa.string()),
    ("def_name_elem", pa.string()), ("name_attr", pa.string()), ("parent_name", pa.string()), ("label", pa.string()),
    ("is_abstract", pa.bool_()), ("xml", pa.string()), ("fields", pa.list_(_FIELD)),
])
_DEF_DDL = (
    "path string, position int, def_type string, def_name string, def_name_elem string, name_attr string, parent_name string, "
    "label string, is_abstract boolean, xml string, fields array<struct<field_path: string, name: string, leaf_text: string>>"
)


def _local(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2]


def _value(node: ET.Element | None) -> str | None:
    return None if node is None else "".join(node.itertext())


class _Unfit(ValueError):
    """A file that is not read; the message is the reason."""


def _expanded(text: str) -> None:
    """Refuse what declares entities that are external, nested too deep, or come to
    more than ``ENTITY_CHARS`` characters where the document names them."""
    sizes: dict[str, tuple[int, int]] = {}

    def declared(name, is_parameter, value, base, system, public, notation):
        if value is None:
            raise _Unfit("external entity")
        inner = [sizes.get(n, (0, 0)) for n in _REFERENCE.findall(value)]
        size = (len(value) + sum(n for n, _ in inner), 1 + max((d for _, d in inner), default=0))
        if size[0] > ENTITY_CHARS or size[1] > ENTITY_DEPTH:
            raise _Unfit("entities too large")
        sizes.setdefault(name, size)

    parser, body = expat.ParserCreate(), []
    parser.EntityDeclHandler = declared
    parser.EndDoctypeDeclHandler = lambda: body.append(parser.CurrentByteIndex)
    parser.Parse(text.encode("utf-8", "replace"), False)
    named = _REFERENCE.findall(text.encode("utf-8", "replace")[body[0] :].decode("utf-8", "replace")) if sizes and body else []
    if sum(sizes.get(name, (0, 0))[0] for name in named) > ENTITY_CHARS:
        raise _Unfit("entities too large")


def _root(text: str | None) -> ET.Element:
    """The document's root, entities expanded within bounds; :class:`_Unfit` with the
    reason where there is none."""
    if not text:
        raise _Unfit("empty")
    try:
        if "<!ENTITY" in text:
            _expanded(text)
        return ET.fromstring(text)
    except (ET.ParseError, expat.ExpatError, RecursionError) as error:
        raise _Unfit("malformed") from error
    except ValueError as error:
        raise error if isinstance(error, _Unfit) else _Unfit("malformed") from error


def _fields(node: ET.Element, above: str = "", depth: int = 0) -> Iterator[dict]:
    place = f"{above}.{_local(node)}" if above else _local(node)
    yield {"field_path": place, "name": _local(node), "leaf_text": None if len(node) else node.text}
    if depth + 1 < DEPTH:
        for child in node:
            yield from _fields(child, place, depth + 1)


def _definitions(text: str | None) -> ET.Element:
    root = _root(text)
    if _local(root) != "Defs":
        raise _Unfit("another root")
    return root


def _rows(path: str | None, text: str | None, with_fields: bool = True) -> Iterator[dict]:
    """One file's definitions."""
    try:
        root = _definitions(text)
    except _Unfit:
        return
    for position, node in enumerate(root, 1):
        own, kind, base = _value(node.find("defName")), _local(node), node.get("Name")
        node.tail = None
        named = own if own is not None else base
        yield {
            "path": path, "position": position, "def_type": kind,
            "def_name": named if named is not None else f"[Unnamed_{kind}_{position}]",
            "def_name_elem": own or None, "name_attr": base or None, "parent_name": node.get("ParentName"),
            "label": _value(node.find("label")), "is_abstract": node.get("Abstract", "").lower() == "true",
            "xml": ET.tostring(node, encoding="unicode"), "fields": list(_fields(node)) if with_fields else None,
        }


def _parse(batches: Iterator[pa.RecordBatch], with_fields: bool = True) -> Iterator[pa.RecordBatch]:
    """Definitions of many files in one batch."""
    files = ((p.as_py(), t.as_py()) for batch in batches for p, t in zip(batch["path"], batch["content"], strict=True))
    rows = (row for path, text in files for row in _rows(path, text, with_fields))
    while some := list(islice(rows, BATCH_DEFS)):
        yield pa.RecordBatch.from_pylist(some, schema=_DEF)


def extract_defs(files: DataFrame, with_fields: bool = True) -> DataFrame:
    """``files (path, content)`` to one row per definition.

    Null, empty and malformed files, files with another root and files whose
    entities are external or too large give no rows (:func:`rejected_files`).  A definition without a name gets one
    from its type and place; the path of fields starts at the definition.  ``fields``
    are what tokens are made of; they may be left null."""
    return files.select(F.col("path").cast("string"), F.col("content").cast("string")).mapInArrow(partial(_parse, with_fields=with_fields), _DEF_DDL)


@F.pandas_udf(T.StringType())
def _reason(texts: pd.Series) -> pd.Series:
    def reason(text: str | None) -> str | None:
        try:
            _definitions(text)
        except _Unfit as error:
            return str(error)
        return None

    return texts.map(reason)


def rejected_files(files: DataFrame) -> DataFrame:
    """``(path, reason)`` of the files that :func:`extract_defs` leaves out."""
    return files.select("path", _reason(F.col("content").cast("string")).alias("reason")).where("reason IS NOT NULL")


def def_tokens(defs: DataFrame, tasks: int | None = None) -> DataFrame:
    """``(token, field_path, path, def_type, def_name)`` distinct: element names
    and the words of leaves, of three characters or more, lower-cased.

    Definitions are dealt to ``tasks`` (as many as shuffles have) before they become
    rows, and made distinct there: a given number, which Spark does not join by their
    few bytes, so what a task holds does not grow with the input."""
    own, most = ["path", "def_type", "def_name"], int(defs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = defs.select(*own, "fields").repartition(tasks or most, *own).select(*own, F.explode("fields").alias("f"))
    words = F.split(F.coalesce("f.leaf_text", F.lit("")), r"(?U)\W+")
    every = F.transform(F.concat(F.array("f.name"), words), lambda w: F.lower(w))
    tokens = F.array_distinct(F.filter(every, lambda w: F.length(w) >= 3))
    return found.select(F.explode(tokens).alias("token"), "f.field_path", "path", "def_type", "def_name").distinct()


def _overlay(base: ET.Element, own: ET.Element) -> None:
    """Lay ``own`` over ``base``: attributes are replaced; plain text, or
    ``Inherit="false"``, replaces the content; list items are appended; other
    children go over the first one of their name."""
    base.attrib = {k: v for k, v in own.attrib.items() if k != "Inherit"}
    if own.get("Inherit", "").lower() == "false" or (len(own) == 0 and own.text):
        base[:], base.text = copy.deepcopy(list(own)), own.text
        return
    gathers = _local(base).lower() in _GATHERED
    for piece in own:
        twin = None if gathers or _local(piece) == "li" else base.find(piece.tag)
        if twin is None:
            base.append(copy.deepcopy(piece))
        else:
            _overlay(twin, piece)


def _read(xml: str) -> ET.Element:
    node = ET.fromstring(xml)
    for part in node.iter():
        part.tail = None
        if part.text and not part.text.strip():
            part.text = None
    return node


def _finished(whole: ET.Element) -> str:
    """A merged definition as text: names first, without the marks of inheritance."""
    for name in ("description", "label", "defName"):
        if (head := whole.find(name)) is not None:
            whole.remove(head)
            whole.insert(0, head)
    for part in whole.iter():
        if part.keys():
            dropped = ["ParentName", "Abstract", "Inherit"] + ["Name"] * (part.find("defName") is not None)
            for key in dropped:
                part.attrib.pop(key, None)
    ET.indent(whole)
    return ET.tostring(whole, encoding="unicode")


_MERGED = pa.schema([("name", pa.string()), ("def_type", pa.string()), ("depth", pa.int32()), ("xml", pa.string())])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of chains to merged definitions: of each part first the texts of its
    nodes, at depth 0, then its chains in the order of their nodes, the root first.

    Neighbours share most of their ancestors: each level's merged form is held
    until a chain leaves it, so a part merges each definition once.  A task holds
    the texts of one part."""
    now, texts = None, {}
    keys: list[int] = []
    forms: list[ET.Element] = []
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "name", "def_type", "depth", "keys", "xml")), strict=True):
            part, name, def_type, depth, nodes, xml = row
            if part != now:
                now, texts, keys, forms = part, {}, [], []
            if depth == 0:
                texts[nodes[0]] = xml
                continue
            shared = 0
            while shared < min(len(keys), len(nodes)) and keys[shared] == nodes[shared]:
                shared += 1
            del forms[shared:]
            for node in nodes[shared:]:
                own = _read(texts[node])
                form = copy.deepcopy(forms[-1]) if forms else ET.Element(own.tag)
                _overlay(form, own)
                forms.append(form)
            keys = nodes
            out.append((name, def_type, depth, _finished(copy.deepcopy(forms[-1]))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _MERGED, strict=True)], schema=_MERGED)


@F.pandas_udf(T.ArrayType(T.StringType()))
def linked_classes(xml: pd.Series) -> pd.Series:
    """Class names in a definition's elements and ``Class`` attributes, in
    document order; of names equal in any case the first."""

    def found(text: str | None) -> list[str]:
        names: dict[str, str] = {}
        for node in list(ET.fromstring(text).iter())[1:] if text else []:
            tag = _local(node).lower()
            texts = [_value(node)] if tag in CLASS_ELEMENTS or tag.endswith(("class", "worker")) else []
            for name in (t.strip() for t in [*texts, node.get("Class", "")]):
                if name:
                    names.setdefault(name.lower(), name)
        return list(names.values())

    return xml.map(found)


def resolve_defs(defs: DataFrame, names: DataFrame | None = None, most: int = 15) -> DataFrame:
    """``names (name)``, or all that are defined, to ``(name, def_type, depth, xml,
    classes)``: the definition with all it inherits, its type that of the root
    ancestor.  Unknown names give no rows; a chain ends before a repeat and after
    ``most`` nodes.

    Chains are of numbers; a text goes once to each part of the chains that names
    it, and parts are neighbours in the order of nodes, so they share few.  Where few
    names are asked for, only what is on their way up is looked at."""
    spark, own = defs.sparkSession, ["path", "position", "def_type", "def_name", "def_name_elem", "name_attr", "parent_name"]
    if names is not None:  # may come from the same parse
        names = materialize(names.distinct(), "asked")
    defs = materialize(defs.select(F.monotonically_increasing_id().alias("_row"), *own, "xml"), "defs")
    if names is None:
        names = defs.select(F.col("def_name").alias("name")).distinct()
    elif names.limit(graph.FEW_NAMES + 1).count() <= graph.FEW_NAMES:
        defs = materialize(graph.reachable(defs, names, most), "reached")
    # Of definitions of one name in a file the first is read; those without a path are not.
    node = F.min_by("_row", "position").over(Window.partitionBy("path", "def_name"))
    nodes = defs.drop("xml").withColumn("node", F.when(F.col("path").isNotNull() & F.col("def_name").isNotNull(), node))
    chain = graph.def_chains(materialize(nodes, "nodes"), names, most, ["node", "def_type"], lambda x: x["node"])
    root_first = chain.select("name", F.reverse(F.filter("items", lambda x: x["node"].isNotNull())).alias("c")).where("size(c) > 0")
    chains = materialize(root_first.select("name", F.col("c")[0]["def_type"].alias("def_type"), F.size("c").alias("depth"), F.col("c.node").alias("keys")), "chains")
    n, most = chains.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(min(most, -(-n // 100)), -(-n // TASK_CHAINS), 1)
    dealt = materialize(chains.repartitionByRange(TASK_PARTS * tasks, "keys").withColumn("part", F.spark_partition_id()), "dealt")
    needed = dealt.select("part", F.explode("keys").alias("_row")).distinct()
    texts = needed.join(defs.select("_row", "xml"), "_row").select(
        "part", *[F.lit(None).cast("string").alias(c) for c in ("name", "def_type")], F.lit(0).alias("depth"), F.array("_row").alias("keys"), "xml"
    )
    both = texts.unionByName(dealt.withColumn("xml", F.lit(None).cast("string")))
    ordered = both.repartition(tasks, "part").sortWithinPartitions("part", F.col("depth") > 0, "keys")
    merged = ordered.mapInArrow(_merge, "name string, def_type string, depth int, xml string")
    return merged.withColumn("classes", linked_classes("xml"))
