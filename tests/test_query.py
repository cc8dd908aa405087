import pytest

from lithoscan.plans.query import parse

CASES = {
    't:Foo m:Bar "x y" http://z': ("Foo", "Bar", None, None, ["x y", "http://z"], "Foo Bar x y http://z", "members types"),
    "type:Foo bar": ("Foo", None, None, None, ["bar"], "Foo bar", "members types"),
    "D:a d:b c": (None, None, None, "b", ["c"], "b c", "content defs members"),
    "f: p:w": (None, None, "w", None, [], "w", "members"),
    "plain words": (None, None, None, None, ["plain", "words"], "plain words", "content defs members types"),
    "": (None, None, None, None, [], "", "defs types"),
    '"an open quote': (None, None, None, None, ["an open quote"], "an open quote", "content defs members types"),
}


@pytest.mark.parametrize("raw", list(CASES))
def test_search_strings(raw):
    q = parse(raw)
    assert (q.type, q.method, q.field, q.definition, q.keywords, q.combined(), " ".join(sorted(q.sections()))) == CASES[raw]
