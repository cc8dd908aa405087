import pytest
from pyspark.sql import functions as F

from lithoscan.functions.text import ngrams, split_words, with_fuzzy_score
from lithoscan.operators import graph
from lithoscan.plans.query import parse

GOLDEN = [
    ("CompShield", "compshield", 100), ("CompShieldBelt", "CompShield", 90), ("CompShield", "CompSheild", 88),
    ("CompShield", "CompShielx", 93), ("Pawn", "Pwn", 93), ("Pawn", "Pwan", 88), ("JobDriver_Wait", "JDW", 85),
    ("Apparel_ShieldBelt", "belt", 80), ("abcdefghijkl", "abcdefghixyz", 52.5), ("abcdefghij", "abcdefwxyz", 33),
    ("xxshieldyy", "hiel", 48), ("Apparel", "zzz", 0), ("", "x", 0), (None, "x", 0), ("été", "zté", 93),
]


def test_scores_words_and_grams(spark):
    df = spark.createDataFrame([(t, q, float(w)) for t, q, w in GOLDEN], "text string, query string, want double")
    got = with_fuzzy_score(df, F.col("text"), F.col("query")).collect()
    assert all(r.score == pytest.approx(r.want) for r in got), got
    row = spark.range(1).select(
        split_words(F.lit("JobDriver_WaitXMLNode")).alias("a"), ngrams(F.lit("C")).alias("b"), F.array_distinct(ngrams(F.lit("CompComp"))).alias("c")
    ).first()
    assert row.a == ["Job", "Driver", "Wait", "XML", "Node"] and row.b == [] and sorted(row.c) == ["co", "mp", "om", "pc"]


def test_parse():
    q = parse('t:Foo m:Bar "x y" http://z')
    assert (q.type, q.method, q.keywords, q.combined()) == ("Foo", "Bar", ["x y", "http://z"], "Foo Bar x y http://z")
    assert set(parse("type:Foo bar").sections()) == {"types", "members"}
    assert set(parse("def:Foo bar").sections()) == {"members", "defs", "content"}


def test_chains_of_many_types_and_cycles(spark):
    """A chain, a tree and a cycle; what several joins double is cut at the cap."""
    rows = [(f"T{i}", f"T{i}", f"T{i - 1}" if i else None, "a.cs") for i in range(30)] + [("A", "A", "B", "b"), ("B", "B", "a", "b"), ("C", "C", "Gone", "c")]
    types = spark.createDataFrame(rows, "full_name string, short_name string, base_name string, path string")
    names = spark.createDataFrame([("T29",), ("t3",), ("a",), ("C",), ("T0",)], "name string")
    got = {}
    for r in graph.inheritance_chains(types, names).orderBy("depth").collect():
        got.setdefault(r.name, []).append((r.child, r.parent))
    assert got["T29"] == [(f"T{i}", f"T{i - 1}") for i in range(29, 8, -1)] and len(got["t3"]) == 3
    assert got["a"] == [("A", "B"), ("B", "a")] and got["C"] == [("C", "Gone")] and "T0" not in got
