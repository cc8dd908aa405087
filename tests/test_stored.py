"""The stored index: the same hits as without it, from the buckets of the keys alone."""

from dataclasses import replace

import pytest

from lithoscan.operators import csharp, graph, index, search, stored, xml_defs
from lithoscan.plans import tools
from lithoscan.plans.requests import request
from lithoscan.sources import snapshot

from .test_sources import CODE, DEFS


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    more = "\n".join(f"namespace N{i % 7} {{ class ShieldBelt{i} : Belt {{ int shieldHealth{i}; void RepairShield() {{ }} }} }}" for i in range(80))
    rows = [("/s/Belt.cs", "Belt", "cs", CODE), ("/s/More.cs", "More", "cs", more), ("/s/Belts.xml", "Belts", "xml", DEFS)]
    files = spark.createDataFrame(rows, "path string, stem string, ext string, content string")
    found = csharp.scan_declarations(files.where("ext = 'cs'")).cache()
    plain = tools.Corpus(files, found, xml_defs.extract_defs(files.where("ext = 'xml'")).cache())
    return plain.written(str(tmp_path_factory.mktemp("index") / "own"), 8)


def rows(df):
    return list(map(str, df.collect()))


def plan(df):
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("query", ["ShieldBlt", "belt", "shieldbelt7", "xyzzyx", "N3.Shield"])
def test_types(corpus, query):
    names = index.name_dictionary(corpus.types)
    assert rows(stored.fuzzy_types(corpus.stored, query)) == rows(search.fuzzy_types(names, index.name_ngrams(names), query))


@pytest.mark.parametrize("words", [["shield"], ["repair", "shild"], ["sh"], ["re", "healht"], ["x"], [], ["a"], ["Full", "full"]])
def test_members(corpus, words):
    assert rows(stored.search_members(corpus.stored, words)) == rows(search.search_members(index.member_keys(corpus.members), words))


def test_definitions_and_names(corpus):
    tokens = xml_defs.def_tokens(corpus.defs)
    for words in (["belt", "mass"], ["Belt", "belt", "no"], ["zz"], []):
        assert rows(stored.search_content(corpus.stored, words)) == rows(search.search_content(tokens, words))
    for name in ("BELT", "baseapparel", "none"):
        here = stored.find_def(corpus.stored, name).select("def_type", "def_name", "path")
        assert rows(here) == rows(search.find_def(corpus.defs, name).select("def_type", "def_name", "path"))
    for name in ("game.core.belt", "inner", "shieldbelt3", "nobody"):
        assert sorted(rows(stored.paths_of_type(corpus.stored, name))) == sorted(rows(search.paths_of_type(corpus.types, name)))
    for name in ("Belt", "Game.Core.Belt", "nobody"):
        assert sorted(rows(stored.inheritors(corpus.stored, name))) == sorted(rows(graph.inheritors(corpus.types, name)))


def test_requests_read_the_index(corpus):
    plain = replace(corpus, stored=None)
    for called, given in [
        ("locate", {"query": "shieldbelt7"}), ("locate", {"query": "m:repair"}), ("locate", {"query": "d:belt mass"}),
        ("inspect", {"name": "belt"}), ("inspect", {"name": "Inner"}), ("trace", {"symbol": "Belt", "mode": "inheritors"}),
    ]:
        texts = [sorted(r.text for r in request(c, called, **given).collect()) for c in (corpus, plain)]
        assert texts[0] == texts[1] and texts[0], (called, given)


def test_only_the_buckets_of_the_keys_are_read(corpus):
    own = stored.ngram_candidates(corpus.stored, "ShieldBelt")
    told = plan(own)
    assert "PartitionFilters: [bucket" in told and "Generate" not in told and "PushedFilters: [In(key" in told
    run = corpus.stored.rows("members", ["repair"])._jdf.queryExecution().executedPlan()
    run.executeCollect()
    assert run.collectLeaves().head().metrics().apply("numPartitions").value() == 1


def test_frequent_keys_are_spread_over_files(spark, tmp_path):
    import glob

    data = spark.range(4000).selectExpr("IF(id < 3000, 'hot', CAST(id AS string)) AS key", "CAST(id AS string) AS name")
    empty = dict.fromkeys(stored.RELATIONS, data.limit(0))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # these few rows fit one task
    own = stored.write_index(spark, empty | {"names": data}, str(tmp_path / "i"), 4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert own.rows("names", ["hot"]).count() == 3000 and own.rows("names", ["hot", "3500", "no"]).count() == 3001
    assert own.whole("names").count() == 4000 and own.whole("grams").count() == own.rows("grams", ["x"]).count() == own.rows("names", []).count() == 0
    assert max(len(glob.glob(f"{tmp_path}/i/names/bucket={b}/*.parquet")) for b in range(4)) > 1


def test_catalogue_and_snapshot(spark, corpus, tmp_path):
    with pytest.raises(snapshot.Rejected, match="catalogue missing"):
        stored.open_index(spark, str(tmp_path / "none"))
    few = {"names": corpus.stored.whole("names")}
    with pytest.raises(snapshot.Rejected, match="relation missing: defs, grams"):
        stored.write_index(spark, few, str(tmp_path / "few"))
    stored.export_index(corpus.stored, str(tmp_path / "out"), "mark")
    back = stored.import_index(spark, str(tmp_path / "out"), "mark", str(tmp_path / "back"), 3)
    assert rows(stored.fuzzy_types(back, "ShieldBlt")) == rows(stored.fuzzy_types(corpus.stored, "ShieldBlt"))
    assert {n: back.whole(n).count() for n in stored.RELATIONS} == {n: corpus.stored.whole(n).count() for n in stored.RELATIONS}
    with pytest.raises(snapshot.Rejected, match="fingerprint"):
        stored.import_index(spark, str(tmp_path / "out"), "other", str(tmp_path / "no"))
