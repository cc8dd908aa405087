"""An index that follows changes equals one that is built anew."""

import random

from lithoscan.operators import stored
from lithoscan.streaming import maintain

FILES = "path string, ext string, content string"


def code(rng):
    name = lambda: rng.choice(["Belt", "belt", "ShieldBelt", "Pawn", "JobDriver", "Map"]) + rng.choice(["", "", "A", "B2"])
    return " ".join(f"namespace N{rng.randrange(3)} {{ class {name()} : {name()} {{ int {name()}; void Do{name()}() {{ }} }} }}" for _ in range(rng.randrange(3)))


def defs(rng):
    one = lambda: f"<ThingDef Name=\"Base{rng.randrange(4)}\"><defName>D{rng.randrange(6)}</defName><label>{rng.choice(['red', 'blue'])} thing</label></ThingDef>"
    return "<Defs>" + "".join(one() for _ in range(rng.randrange(3))) + "</Defs>"


def contents(own):
    return {name: sorted(map(str, own.whole(name).select(sorted(own.whole(name).columns)).collect())) for name in (*stored.RELATIONS, *maintain.FOUND)}


def test_any_sequence_of_changes_equals_a_rebuild(spark, tmp_path):
    rng = random.Random(4)
    make = lambda path: (code if path.endswith("cs") else defs)(rng)
    paths = [f"/s/f{i}.{'cs' if i % 2 else 'xml'}" for i in range(8)]
    tree = {p: make(p) for p in paths[:5]}
    frame = lambda rows: spark.createDataFrame([(p, p.rpartition(".")[2], t) for p, t in rows], FILES)
    own = maintain.create(spark, frame(tree.items()), str(tmp_path / "own"), 4)
    for step in range(2):
        changed = {p: None if p in tree and rng.random() < 0.4 else make(p) for p in rng.sample(paths, 3)}
        if step == 1:
            changed = {p: None for p in tree}  # all goes
        rows = [(p, p.rpartition(".")[2], t, t is None) for p, t in changed.items()]
        batch = spark.createDataFrame(rows, maintain.CHANGES)
        maintain.apply_changes(own, batch)
        tree = {p: t for p, t in (tree | changed).items() if t is not None}
        anew = maintain.create(spark, frame(tree.items()), str(tmp_path / f"anew{step}"), 4)
        assert contents(own) == contents(anew), step
        if step == 0:  # a batch that is repeated alters nothing
            maintain.apply_changes(own, batch)
            assert contents(own) == contents(anew)
    assert not any(contents(own).values())


def test_stream_of_changes(spark, tmp_path):
    own = maintain.create(spark, spark.createDataFrame([("/a.cs", "cs", "class A { }")], FILES), str(tmp_path / "own"), 2)
    feed = tmp_path / "feed"
    for rows in ([("/b.cs", "cs", "class B : A { }", False)], [("/a.cs", "cs", None, True), ("/c.cs", "cs", "class C : B { }", False)]):
        spark.createDataFrame(rows, maintain.CHANGES).coalesce(1).write.mode("append").json(str(feed))
        changes = spark.readStream.schema(maintain.CHANGES).json(str(feed))
        maintain.follow(spark, changes, own.path, str(tmp_path / "state")).awaitTermination()
    assert {r.name for r in own.whole("names").collect()} == {"B", "C"}
    assert [r.full_name for r in stored.inheritors(own, "B").collect()] == ["C"]


def test_changes_since(spark):
    frame = lambda rows: spark.createDataFrame(rows, "path string, stamp string")
    got = maintain.changes_since(frame([("a", "1"), ("b", "2"), ("c", "1")]), frame([("a", "1"), ("b", "1"), ("d", "1")]))
    assert {tuple(r) for r in got.collect()} == {("b", False), ("c", False), ("d", True)}
