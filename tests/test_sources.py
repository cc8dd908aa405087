import xml.etree.ElementTree as ET

import pytest

from lithoscan.operators import csharp, xml_defs
from lithoscan.sources import files
from lithoscan.streaming.rescan import rescan

DEFS = """<?xml version="1.0" encoding="utf-8"?>
<Defs>
  <ThingDef Name="BaseApparel" Abstract="True">
    <label>base</label><thingClass>Apparel</thingClass><tags><li>A</li></tags><stats><mass>1</mass><cost>5</cost></stats>
  </ThingDef>
  <ThingDef ParentName="BaseApparel">
    <defName>Belt</defName><label>belt</label><tags><li>B</li></tags><stats><mass>2</mass></stats>
    <comps><li Class="CompProperties_Shield"/></comps>
  </ThingDef>
  <ThingDef ParentName="baseapparel"><defName>Bare</defName><tags Inherit="false"><li>B</li></tags></ThingDef>
  <ThingDef/>
</Defs>"""

BELT = """<ThingDef><defName>Belt</defName><label>belt</label><thingClass>Apparel</thingClass><tags><li>A</li><li>B</li></tags>
<stats><mass>2</mass><cost>5</cost></stats><comps><li Class="CompProperties_Shield"/></comps></ThingDef>"""

CODE = """using System;
namespace Game.Core
{
    // class Nothing { }
    public partial class Belt<T> : Wear<int, T>, IWorn where T : class
    {
        const string Text = "class Fake { }";
        private int a = 1, b;
        public event Action Worn, Lost;
        public Belt(int size) { a = size; }
        /// Weight.
        [Pure] public float Mass { get; set; } = 2f;
        public bool Full => a > b;
        public List<int> Find(string name, ref int at, int most = 3) { if (a == 1) { return null; } return null; }
        public static Belt<T> operator +(Belt<T> x, Belt<T> y) => x;
        public int this[int i] { get { return i; } }
        Action run = () => { int c = 1; };
        enum Kind { A, B }
        struct Inner { void Go<U>() where U : new() { } }
    }
}
"""


def _xml(text):
    return ET.canonicalize(text, strip_text=True)


def _files(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, content string")


def test_defs(spark):
    rows = _files(spark, ("a.xml", DEFS), ("b.xml", "<Defs><"), ("c.xml", None), ("d.xml", "<Other><X/></Other>"))
    defs = xml_defs.extract_defs(rows)
    got = [(r.def_type, r.def_name, r.parent_name, r.label, r.is_abstract) for r in defs.orderBy("position").collect()]
    assert got[:2] == [("ThingDef", "BaseApparel", None, "base", True), ("ThingDef", "Belt", "BaseApparel", "belt", False)]
    assert got[3][1] == "[Unnamed_ThingDef_4]"
    names = spark.createDataFrame([("belt",), ("Bare",), ("none",)], "name string")
    whole = {r.name: r for r in xml_defs.resolve_defs(defs, names).collect()}
    assert set(whole) == {"belt", "Bare"}
    assert _xml(whole["belt"].xml) == _xml(BELT) and whole["belt"].classes == ["Apparel", "CompProperties_Shield"]
    assert [x.text for x in ET.fromstring(whole["Bare"].xml).find("tags")] == ["B"]
    tokens = {(r.token, r.field_path) for r in xml_defs.def_tokens(defs.where("def_name = 'Belt'")).collect()}
    assert ("belt", "ThingDef.defName") in tokens and ("mass", "ThingDef.stats.mass") in tokens and not any(t == "li" for t, _ in tokens)


def test_entities_are_expanded_within_bounds(spark):
    laughs = "".join(f'<!ENTITY l{i} "{("&l%d;" % (i - 1)) * 10}">' for i in range(1, 8))
    one = lambda dtd, label: f"<!DOCTYPE Defs [{dtd}]><Defs><X><defName>A</defName><label>{label}</label></X></Defs>"
    rows = {
        "nested": one('<!ENTITY a "red"><!ENTITY b "&a; belt">', "&b;, &a;"),
        "comment": "<Defs><!-- <!ENTITY a 'b'> --><X><defName>A</defName><label>&lt;!ENTITY</label></X></Defs>",
        "laughs": one('<!ENTITY l0 "haha">' + laughs, "&l7;"), "often": one(f'<!ENTITY a "{"x" * 70000}">', "&a;" * 20),
        "outside": one('<!ENTITY a SYSTEM "file:///etc/hosts">', "&a;"), "unknown": one('<!ENTITY a "b">', "&c;"),
        "root": "<Other/>", "bad": "<Defs><", "none": None,
    }
    df = _files(spark, *rows.items())
    assert {r.path: r.label for r in xml_defs.extract_defs(df).collect()} == {"nested": "red belt, red", "comment": "<!ENTITY"}
    assert {r.path: r.reason for r in xml_defs.rejected_files(df).collect()} == {
        "laughs": "entities too large", "often": "entities too large", "outside": "external entity", "unknown": "malformed",
        "root": "another root", "bad": "malformed", "none": "empty",
    }


def test_chains_merge_the_same_in_any_order(spark):
    """Chains that share ancestors, are cut by a cycle, or are too long."""
    text = "".join(f'<X Name="N{i}" ParentName="N{i // 2}"><defName>D{i}</defName><tags><li>{i}</li></tags></X>' for i in range(1, 40))
    text += "".join(f'<Y ParentName="{f"L{i - 1}" if i else "none"}"><defName>L{i}</defName><tags><li>{i}</li></tags></Y>' for i in range(25))
    defs = xml_defs.extract_defs(_files(spark, ("a.xml", f"<Defs>{text}</Defs>")))
    whole = {r.name: r for r in xml_defs.resolve_defs(defs, defs.select(defs.def_name.alias("name"))).collect()}
    tags = lambda name: [x.text for x in ET.fromstring(whole[name].xml).find("tags")]
    for i in range(1, 40):
        up = [str(i >> k) for k in range(i.bit_length())]
        assert tags(f"D{i}") == up[::-1], i
    assert tags("L24") == [str(i) for i in range(10, 25)] and whole["L24"].depth == 15 and tags("L3") == ["0", "1", "2", "3"]


def test_declarations(spark):
    found = csharp.scan_declarations(_files(spark, ("a.cs", CODE), ("b.cs", None), ("c.cs", "namespace A.B; record P(int X) : Q(X); interface I { }")))
    found = found.cache()
    types = {(r.full_name, r.kind, r.base_name) for r in csharp.types_of(found).collect()}
    assert types == {
        ("Game.Core.Belt", "Class", "Wear<int, T>"), ("Game.Core.Belt.Inner", "Struct", None),
        ("A.B.P", "Record", "Q(X)"), ("A.B.I", "Interface", None),
    }
    members = {(r.member_type, r.member_name) for r in csharp.members_of(found.where("path = 'a.cs'")).collect()}
    assert members == {
        ("Field", "Text"), ("Field", "a"), ("Field", "b"), ("Event", "Worn"), ("Event", "Lost"), ("Property", "Mass"),
        ("Property", "Full"), ("Method", "Find"), ("Field", "run"), ("Method", "Go"),
    }
    lines = [r.signature for r in csharp.outline(found, "belt").orderBy("place").collect()]
    assert lines[0] == "Class: Game.Core.Belt <T>" and "  Property: float Mass" in lines
    assert "  Method: List<int> Find(string name, int at, int most)" in lines
    mass = csharp.member_source(found, "mass").first()
    assert mass.line == 12 and mass.source.strip().startswith("/// Weight.") and mass.source.endswith("}")
    assert csharp.member_source(found, ".ctor").count() == csharp.member_source(found, "+").count() == csharp.member_source(found, "this").count() == 1
    assert csharp.type_source(found, "inner").first().source.strip() == "struct Inner { void Go<U>() where U : new() { } }"


def test_scan_and_rescan(spark, tmp_path):
    tree = tmp_path / "tree"
    for name, text in (("x/a.xml", DEFS), ("x/Bin/b.xml", DEFS), ("y/c.cs", CODE), ("y/d.txt", "no")):
        (tree / name).parent.mkdir(parents=True, exist_ok=True)
        (tree / name).write_text(text)
    got = {(r.stem, r.ext, r.content == (DEFS if r.ext == "xml" else CODE)) for r in files.scan_files(spark, str(tree)).collect()}
    assert got == {("a", "xml", True), ("c", "cs", True)}
    assert files.scan_files(spark, str(tree / "none")).count() == 0
    target = str(tmp_path / "out")
    for new, n in ((None, 4), ("x/e.xml", 8), (None, 8)):
        if new:
            (tree / new).write_text(DEFS)
        rescan(spark, str(tree), target, str(tmp_path / "state")).awaitTermination()
        assert spark.read.parquet(target + "/defs").count() == n
    assert spark.read.parquet(target + "/declarations").where("kind = 'Class'").count() == 1
    names, more = files.list_folder(spark, str(tree), 1)
    assert names.count() == 1 and more
    assert files.is_allowed(str(tree / "x"), [str(tree)]) and not files.is_allowed("/etc/passwd", [str(tree)])


def test_walk_prunes_and_deals_out(spark, tmp_path, monkeypatch):
    """Skipped folders are never entered, unreadable ones passed over; any budget finds the same."""
    tree = tmp_path / "tree"
    want = set()
    for i in range(40):
        for name in (f"a{i % 3}/b{i % 7}/c{i}/F{i}.cs", f"a{i % 3}/OBJ/x{i}.cs", f"a{i}/_G{i}.xml", f"a{i}/.H.cs", f"a{i}/n.CS", f"a{i}/n.txt"):
            (tree / name).parent.mkdir(parents=True, exist_ok=True)
            (tree / name).write_bytes(b"\xef\xbb\xbfclass \xe9" + name.encode())
            if name.endswith((".cs", ".xml")) and "OBJ" not in name:
                want.add(str(tree / name))
    (tree / "a1/loop").symlink_to(tree)
    for budget, tasks in ((9, 3), (2000, 4)):
        assert {r.path for r in files.list_files(spark, str(tree), folders_a_task=budget, tasks=tasks).collect()} == want
    got = files.scan_files(spark, f"file://{tree}").collect()
    assert {r.path for r in got} == want and all(r.content.startswith("class �") and r.size > 10 for r in got)
    one = files.scan_files(spark, str(tree / "a5")).where("stem = '_G5'").first()
    assert (one.ext, one.content) == ("xml", "class �a5/_G5.xml")
    plain = {(path, inner) for path, inner, _, _ in files._entries(str(tree / "a1/b1"))}
    assert {(path.removeprefix("file://"), inner) for path, inner, _, _ in files._entries(f"file://{tree}/a1/b1")} == plain
    assert files._read(f"file://{tree}/a5/_G5.xml") == files._read(str(tree / "a5/_G5.xml")) and files._read(f"file://{tree}/x") is None
    seen, scandir = [], files.os.scandir

    def guarded(folder):
        seen.append(folder)
        if folder.endswith("a2"):
            raise PermissionError(folder)
        return scandir(folder)

    monkeypatch.setattr(files.os, "scandir", guarded)
    rows = {path for path, inner, _, _ in files._walk([str(tree)], (".cs", ".xml"), 10_000) if not inner}
    assert rows == {p for p in want if "/a2/" not in p} and not any("OBJ" in s or "loop" in s for s in seen)
    assert not list(files._walk([str(tree / "none"), f"file://{tree}/none"], (".cs",), 9))


def test_folder_listing_of_local_and_remote_folders(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"f{i}").write_text("")
    for root in (str(tmp_path), f"file://{tmp_path}"):
        names, more = files.list_folder(spark, root, 10)
        assert {r.name for r in names.collect()} == {f"d{i}/" for i in range(5)} | {f"f{i}" for i in range(5)} and not more
        names, more = files.list_folder(spark, root, 4)
        assert names.count() == 4 and more
    for bad, error in (("none", FileNotFoundError), ("f1", NotADirectoryError)):
        with pytest.raises(error):
            files.list_folder(spark, str(tmp_path / bad))
    assert files.is_allowed("hdfs://n:1/Src/a/../b", ["hdfs://N:1/src"]) and not files.is_allowed("hdfs://n:1/src/../b", ["hdfs://n:1/src"])
