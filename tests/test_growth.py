"""What a task holds does not grow with the input, and nothing is done twice."""

import re
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lithoscan import queries
from lithoscan.operators import csharp, graph, index, search, stored, xml_defs
from lithoscan.plans import tools
from lithoscan.sources import snapshot


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """300 parts in one file that one task reads."""
    d = str(tmp_path_factory.mktemp("tables"))
    parts = spark.range(300).selectExpr("id AS p_partkey", "concat('red bolt', id % 7) AS p_name", "concat('Brand#', id % 5) AS p_brand", "'BIG' AS p_type", "CAST(id % 50 AS int) AS p_size")
    parts.coalesce(1).write.parquet(f"{d}/part.parquet")
    return d


def test_parts_are_dealt_out_before_they_become_files(spark, tables, monkeypatch):
    monkeypatch.setattr(queries, "TASK_ROWS", 20)
    for made in (queries._code_files, queries._busy_files, queries._def_files, queries.defs, queries.types):
        sizes = made(spark, tables).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert sum(sizes) == 300 and max(sizes) < 60, made


def test_statements_stay_in_the_task_of_their_file(spark):
    codes = ["class A { void M() { int x = 1; } int b, c = 2; }", "namespace N; struct B { }"] * 3
    rows = [(i, [dict(zip(csharp._MARK_COLUMNS, m)) for m in csharp._marks(code)]) for i, code in enumerate(codes)]
    marks = spark.createDataFrame(rows, "_file long, _marks array<struct<mark:int,end:int,lines:int,level:int,may_open:int>>")
    found = csharp._statements(marks.repartition(5, "_file"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1
    got = sorted((r.parent, r.mark, codes[0][r.start : r.end]) for r in found.where("_file = 0").collect())
    assert [(mark, text.strip()) for _, mark, text in got] == [("{", codes[0]), ("=", "int b, c = 2;"), ("{", "void M() { int x = 1; }")]


def test_what_stands_in_brackets_has_no_marks():
    code = "[A(x = 1)] int M(int a = 2, T b = new { }) { a >= b; c[1] = 3; }"
    flat = csharp.outside_brackets(code)
    assert len(flat) == len(code) and [m for m in flat if m in "{}=;"] == ["{", ";", "=", ";", "}"]
    assert csharp.outside_brackets("a; ) b; ( c;") == "a;        c;"
    assert csharp.outside_brackets("a; ( b;\n c;").strip() == "a;"


def test_ngrams_are_made_of_distinct_names(spark):
    rows = spark.createDataFrame([("Aaab", 1), ("Aaab", 2), ("b", 1), (None, 1)], "name string, other int")
    found = index.name_ngrams(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and plan.count("Aggregate") == 1
    assert sorted(map(tuple, found.collect())) == [("aa", "Aaab"), ("ab", "Aaab")]


def test_member_keys_are_made_of_distinct_members(spark):
    rows = spark.createDataFrame([("T", "GoGo", "Method", "p")] * 2, ", ".join(f"{c} string" for c in search.MEMBER))
    found = index.member_keys(rows)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")
    assert sorted(r.key for r in found.collect()) == ["go", "gogo"]


def test_an_index_holds_what_is_asked(spark, tables):
    own = queries.stored_index(spark, tables, "defs")
    assert set(own.told) == {"defs"} and queries.stored_index(spark, tables, "defs").path == own.path
    whole = queries.stored_index(spark, tables)
    assert set(whole.told) == set(stored.RELATIONS)
    assert stored.find_def(own, "PART_30").collect() == stored.find_def(whole, "PART_30").collect() != []
    assert queries.stored_index(spark, tables, "types").path == whole.path
    with pytest.raises(snapshot.Rejected, match="relation missing"):
        stored.open_index(spark, own.path)


def test_a_line_that_takes_all_the_time_is_tried_once():
    trap, seconds = "an" * 60 + "-.", 0.5
    texts = [trap + "\nan."] * 8 + ["an.\nno", "", None, "an.\n" + trap]
    batch = pa.RecordBatch.from_pydict({"path": [str(i) for i in range(len(texts))], "content": texts})
    began = time.monotonic()
    rows = [r for b in search._within(iter([batch]), r"(a|an|n|na)+\.$", 5, 100, seconds) for r in b.to_pylist()]
    assert time.monotonic() - began < 4 * seconds
    assert [(r["path"], r["line_no"]) for r in rows] == [*[(str(i), None) for i in range(8)], ("8", 1), ("11", None)]


def _family(spark, n):
    """Definitions with three children each, some named by a base name, in one file each."""
    xml = "concat('<D', if(id % 10 = 0, concat(' Name=\"P', id, '\"'), ''), if(id > 0, concat(' ParentName=\"p', id div 3, '\"'), ''), '>', if(id % 10 <> 0, concat('<defName>P', id, '</defName>'), ''), '<tags><li>', id, '</li></tags></D>')"
    files = spark.range(n).selectExpr("concat(id, '.xml') AS path", f"concat('<Defs>', {xml}, '</Defs>') AS content")
    return xml_defs.extract_defs(files)


def _tags(rows):
    return {r.name: (r.depth, re.findall(r"<li>(\d+)</li>", r.xml)) for r in rows}


def _upward(k):
    return [*(_upward(k // 3) if k else []), str(k)]


def test_a_text_goes_once_to_each_part_of_the_chains(spark, monkeypatch):
    made, kept = {}, xml_defs.materialize
    monkeypatch.setattr(xml_defs, "materialize", lambda df, name: made.setdefault(name, kept(df, name)))
    whole = _tags(xml_defs.resolve_defs(_family(spark, 300)).collect())
    assert whole == {f"P{k}": (len(_upward(k)), _upward(k)) for k in range(300)}
    assert dict(made["chains"].dtypes)["keys"] == "array<bigint>" and "xml" not in made["dealt"].columns
    dealt = made["dealt"].collect()
    assert len({r.part for r in dealt}) > 4
    held = len({(r.part, key) for r in dealt for key in r["keys"]})
    assert held < 300 + 16 * 6 < sum(r.depth for r in dealt)  # 300 texts and a few ancestors for each of 16 parts


def test_few_names_are_walked_up(spark, monkeypatch):
    met, kept = [], graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: met.append(kept(df, name)) or met[-1])
    names = spark.createDataFrame([("p250",), ("P250",), ("P31",), ("none",), (None,)], "name string")
    defs = _family(spark, 300)
    whole = _tags(xml_defs.resolve_defs(defs, names).collect())
    assert whole == {"p250": (len(_upward(250)), _upward(250)), "P250": (len(_upward(250)), _upward(250)), "P31": (len(_upward(31)), _upward(31))}
    assert max(df.count() for df in met) < 20
    monkeypatch.setattr(graph, "FEW_NAMES", 0)
    assert _tags(xml_defs.resolve_defs(defs, names).collect()) == whole


def test_few_types_are_walked_up(spark, monkeypatch):
    rows = [(f"N.T{k}", f"T{k}", f"t{k // 3}" if k else None, f"{k}.cs") for k in range(300)]
    rows += [("M.T9", "T9", "N.T8", "m.cs"), ("n.T27", "T27", "Other", "n.cs"), ("N.T27", "T27", "A", "z.cs")]
    types = spark.createDataFrame(rows, "full_name string, short_name string, base_name string, path string")
    names = spark.createDataFrame([("T250",), ("n.t83",), ("M.T9",), ("none",), (None,)], "name string")
    assert graph.types_above(types, names, 21).count() < 20
    few = sorted(map(tuple, graph.inheritance_chains(types, names).collect()))
    assert ("T250", 2, "N.T83", "t27") in few and ("T250", 4, "M.T9", "N.T8") in few
    monkeypatch.setattr(graph, "FEW_NAMES", 0)
    assert sorted(map(tuple, graph.inheritance_chains(types, names).collect())) == few


def test_a_request_reads_its_types_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        read.add(1)
        return name

    files = spark.range(40).selectExpr("concat(id, '.cs') AS path", "concat('f', id) AS stem", "'cs' AS ext", "concat('class Part_', id, if(id > 0, concat(' : Part_', id div 3), ''), ' { int a; }') AS content")
    found = csharp.scan_declarations(files).withColumn("name", counted("name"))
    corpus = tools.Corpus(files, found, xml_defs.extract_defs(files))
    assert tools.locate(corpus, "t:Pa")["types"].count() == 10
    assert read.value <= 80  # each type, and the members beside it if they are not left out before
    read.value = 0
    lines = tools.inspect_lines(tools.inspect(corpus, "part_31")).collect()
    assert [r.text for r in lines if r.section == "chain"] == ["Part_31 --> Part_10", "Part_10 --> Part_3", "Part_3 --> Part_1", "Part_1 --> Part_0"]
    assert read.value <= 160


def test_tokens_of_definitions_are_not_joined_in_few_tasks(spark):
    found = xml_defs.def_tokens(_family(spark, 300))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1  # distinct where definitions were dealt to
    sizes = found.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert len(sizes) == 4 and max(sizes) < sum(sizes) / 2
    assert xml_defs.def_tokens(_family(spark, 300), 9).rdd.getNumPartitions() == 9
