import json

import pytest

from lithoscan.operators import csharp, xml_defs
from lithoscan.plans import tools
from lithoscan.plans.requests import REQUESTS, answer, described, request

from .test_sources import CODE, DEFS


@pytest.fixture(scope="module")
def corpus(spark):
    code = CODE + "\nclass Wear { }\nclass Apparel { }\n"
    rows = [("/s/Belt.cs", "Belt", "cs", code), ("/s/Belts.xml", "Belts", "xml", DEFS)]
    files = spark.createDataFrame(rows, "path string, stem string, ext string, content string")
    found = csharp.scan_declarations(files.where("ext = 'cs'")).cache()
    return tools.Corpus(files, found, xml_defs.extract_defs(files.where("ext = 'xml'")).cache())


def test_locate(corpus):
    out = tools.locate(corpus, "belt")
    assert out["types"].first()["name"] == "Game.Core.Belt" and out["types"].first()["path"] == "/s/Belt.cs"
    assert out["defs"].first()["def_name"] == "Belt" and out["content"].first()["def_name"] == "Belt"
    assert "files" not in out
    only = tools.locate(corpus, "m:find")
    assert set(only) == {"members"} and only["members"].first()["member_name"] == "Find"
    assert {r.path for r in tools.locate(corpus, "m:Belts.")["files"].collect()} <= {"/s/Belt.cs", "/s/Belts.xml"}


def test_inspect(corpus):
    out = tools.inspect(corpus, "BELT")
    assert out["definition"].first()["depth"] == 2
    assert {(r.name, r.path) for r in out["classes"].collect()} == {("Apparel", "/s/Belt.cs"), ("CompProperties_Shield", "not indexed")}
    out = tools.inspect(corpus, "Inner")
    assert [r.path for r in out["type_files"].collect()] == ["/s/Belt.cs"] and out["outline"].count() == 2
    with pytest.raises(LookupError):
        tools.inspect(corpus, "Nobody")


def test_read(corpus):
    assert tools.read_code(corpus, "belt", method="mass", class_name="Belt").count() == 1
    assert tools.read_code(corpus, "Belt.cs", extract_class="Inner").first()["kind"] == "Struct"
    rows = tools.read_code(corpus, "/s/belt.cs", start=1, count=2).collect()
    assert [r.line_no for r in rows] == [2, 3] and rows[0].line == "namespace Game.Core" and rows[0].more == 21
    for bad in (dict(path="none"), dict(path="belt", start=10_000), dict(path="belt", method="none")):
        with pytest.raises(LookupError):
            tools.read_code(corpus, **bad)


def test_requests_by_name(corpus, tmp_path):
    ask = lambda called, **given: [r.text for r in request(corpus, called, **given).collect()]
    assert "- `Game.Core.Belt` (100%) - Belt.cs" in ask("locate", query="Game.Core.Belt")
    assert "- `Apparel` (Belt.cs)" in ask("inspect", name="belt") and "Wear" not in ask("inspect", name="belt")
    assert any("L" in t and "[XML] `Belts.xml`" in t for t in ask("trace", symbol="Apparel", mode="usages"))
    assert ask("read_code", path="/s/belt.cs", startLine=1, lineCount=1) == ["L2: namespace Game.Core"]
    assert ask("search_regex", pattern="mass", fileFilter=".CS") == ["`Belt.cs`\n  L12: [Pure] public float Mass { get; set; } = 2f;"]
    bad = [("locate", {}), ("locate", {"query": ""}), ("search_regex", {"pattern": ""}), ("read_code", {"path": "belt", "lineCount": 0})]
    bad += [("list_directory", {"path": "/", "limit": "x"}), ("trace", {"symbol": "x"})]
    for name, given in bad:
        with pytest.raises(ValueError):
            request(corpus, name, **given)
    with pytest.raises(LookupError):
        request(corpus, "none")
    with pytest.raises(PermissionError):
        request(corpus, "list_directory", path=str(tmp_path))
    (tmp_path / "Other.cs").write_text("class Other {\n}\n")
    open_corpus = tools.Corpus(corpus.files, corpus.found, corpus.defs, (str(tmp_path),))
    assert [r.text for r in request(open_corpus, "list_directory", path=str(tmp_path)).collect()] == ["Other.cs"]
    rows = request(open_corpus, "read_code", path=str(tmp_path / "Other.cs"), extractClass="Other").collect()
    assert rows[0].text.startswith("class Other {")


def test_shortened(spark):
    rows = spark.range(1).selectExpr("sequence(1, 301) AS a", "sequence(1, 300) AS b")
    long, short = rows.select(*[tools.shortened(rows[c].cast("array<string>")) for c in "ab"]).first()
    assert len(long) == 251 and long[200] == "... 51 lines ..." and long[-1] == "301" and len(short) == 300


def test_config(tmp_path, monkeypatch):
    assert tools.load_config("TOOLS_TEST_CONFIG", str(tmp_path)) == tools.Config()
    (tmp_path / "config.json").write_text('{"CSHARPSourcePaths": ["/a"], "checkUpdates": false, "other": 1}')
    assert tools.load_config("TOOLS_TEST_CONFIG", str(tmp_path)) == tools.Config(("/a",), (), False, False)
    (tmp_path / "bad.json").write_text("[1")
    monkeypatch.setenv("TOOLS_TEST_CONFIG", str(tmp_path / "bad.json"))
    assert tools.load_config("TOOLS_TEST_CONFIG", str(tmp_path)) == tools.Config()


def test_whole_answers(corpus, tmp_path):
    def ask(called, **given):
        text, failed = answer(corpus, called, **given)
        assert not failed, text
        return text

    text = ask("locate", query="belt")
    heads = ["## 'belt'", "**C# Types:**", "**Members:**", "**XML Defs:**", "**Content Matches:**"]
    assert [line for line in text.split("\n") if line.startswith(("#", "*"))] == [h for h in heads if h in text] and len(text.split("\n\n")) >= 4
    text = ask("locate", query="m:Belts.")
    assert text.startswith("## 'm:Belts.'\n\n**Files:**\n- Belt")
    assert ask("locate", query="m:find").split("\n")[:4] == ["## 'm:find'", "", "**Members:**", "  Methods:"]
    text = ask("inspect", name="belt")
    assert text.startswith("## Def: belt\nType: ThingDef\nFile: `/s/Belts.xml`\n\n**Resolved XML:**\n```xml\n<ThingDef>")
    assert text.endswith("**Linked C# Types:**\n- `Apparel` (Belt.cs)\n- `CompProperties_Shield` (not indexed)")
    text = ask("inspect", name="Game.Core.Belt")
    assert "graph TD\n    Game.Core.Belt --> Wear" in text and "**Outline** (`/s/Belt.cs`):\nClass: Game.Core.Belt <T>" in text
    assert ask("trace", symbol="none", mode="inheritors") == "No subclasses of 'none' found."
    text = ask("trace", symbol="Apparel", mode="usages")
    assert text.startswith("References to 'Apparel' (") and "[XML] `Belts.xml`\n  L" in text
    assert ask("search_regex", pattern="mass", fileFilter=".cs") == (
        "Regex matches for 'mass' (1 found):\n\n`Belt.cs`\n  L12: [Pure] public float Mass { get; set; } = 2f;"
    )
    assert ask("search_regex", pattern="nowhere") == "No matches for pattern: nowhere"
    text = ask("read_code", path="/s/belt.cs", startLine=1, lineCount=1)
    assert text == "```csharp\n// belt.cs (lines 2-2 of 24)\nL2: namespace Game.Core\n```\n\n[22 more lines available, use startLine=2]"
    assert ask("read_code", path="belt", extractClass="Inner").startswith("```csharp\n// Inner\n")
    for called, given in (("none", {}), ("locate", {}), ("search_regex", {"pattern": "("}), ("list_directory", {"path": str(tmp_path)}), ("inspect", {"name": "Nobody"})):
        assert answer(corpus, called, **given)[1], called
    (tmp_path / "a").mkdir()
    (tmp_path / "b").write_text("")
    own = tools.Corpus(corpus.files, corpus.found, corpus.defs, (str(tmp_path),))
    text, failed = answer(own, "list_directory", path=str(tmp_path), limit=1)
    assert not failed and text.split("\n")[1] in ("a/", "b") and text.endswith("increase limit]")


def test_definitions_tell_label_and_abstract_ones(corpus):
    text, failed = answer(corpus, "locate", query="d:base")
    assert not failed and any(line.endswith('- ThingDef [Abstract] "base"') for line in text.split("\n")), text
    text, _ = answer(corpus, "locate", query="d:belt")
    assert '- ThingDef "belt"' in text


def test_requests_describe_their_arguments():
    told = {one["name"]: one["inputSchema"] for one in json.loads(json.dumps(described()))}
    assert set(told) == set(REQUESTS) and told["locate"] == {"type": "object", "properties": {"query": {"type": "string"}}, "required": ["query"]}
    assert told["search_regex"]["properties"]["ignoreCase"] == {"type": "boolean", "default": True}
    assert told["read_code"]["properties"]["lineCount"] == {"type": "integer", "default": 150} and told["read_code"]["required"] == ["path"]


def test_a_pattern_that_takes_too_long(spark, corpus):
    """Files that go past the limit are told of; hits of others stay."""
    rows = [("/s/slow.cs", "slow", "cs", "ok\n" + "a" * 70 + "b"), ("/s/fast.cs", "fast", "cs", "caaa"), ("/s/none.cs", "none", "cs", None)]
    own = tools.Corpus(spark.createDataFrame(rows, "path string, stem string, ext string, content string"), corpus.found, corpus.defs)
    text, failed = answer(own, "search_regex", pattern="(a|aa)+$")
    assert not failed and text == "Regex matches for '(a|aa)+$' (1 found):\n\n`fast.cs`\n  L1: caaa\n\n[Left out, as they took over 1 s: 1 files, such as slow.cs]"
    assert [r.text for r in request(own, "search_regex", pattern="(a|aa)+$").collect()] == ["`fast.cs`\n  L1: caaa", "`slow.cs` took too long"]
