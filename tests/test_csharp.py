"""C# declarations of code that is not laid out simply."""

from collections import Counter

import pytest

from lithoscan.operators import csharp


def scan(spark, *codes, **given):
    rows = [(f"{i}.cs", code) for i, code in enumerate(codes)]
    return csharp.scan_declarations(spark.createDataFrame(rows, "path string, content string"), **given)


def found(spark, code, **given):
    return sorted((r.kind, r.type_name, r.name) for r in scan(spark, code, **given).collect())


CASES = {
    "constructor initialisers": (
        "class A : B { public A(int x) : base(x) { } public A() : this(1) { } void M() {} }",
        {("Class", "A"), ("Constructor", "A"), ("Method", "M")},
    ),
    "attribute with braces": (
        '[A(new string[] { "x" })] class K { int a; } class L { int b; }',
        {("Class", "K"), ("Field", "a"), ("Class", "L"), ("Field", "b")},
    ),
    "nested interpolation": (
        'class A { string s = $"{(x ? "}" : "{")}"; int Q; void M(){} }',
        {("Class", "A"), ("Field", "s"), ("Field", "Q"), ("Method", "M")},
    ),
    "conversion operators": (
        "class A { public static explicit operator string(A a) { return null; } public static implicit operator A(int i) => new A(); public static A operator checked +(A x, A y) => x; int Q; }",
        {("Class", "A"), ("Operator", "+"), ("Field", "Q")},
    ),
    "branches that each open a brace": (
        "class A {\n#if X\nvoid M() {\n#else\nvoid N() {\n#endif\n}\nint Q;\n#if true\nint R;\n#endif\n}",
        {("Class", "A"), ("Method", "N"), ("Field", "Q"), ("Field", "R")},
    ),
    "literals of every kind": (
        'class A { char a = \'{\', b = \'\\\'\'; string c = @"\\{""", d = $@"{{ {1} """, e = """{ "x" {""", f = $$"""{ {{ "}" }} """, g = "", h = @""; int Q; }',
        {("Class", "A"), *(("Field", n) for n in "abcdefghQ")},
    ),
    "initialisers and lambdas": (
        "class A { int[] a = { 1, 2 }; B b = new B { C = { 1 }, D = () => { int x; } }; Func<int> c = () => { return 1; }, d; int P { get { return 1; } } = 3; int E => x switch { 1 => 2, _ => 3 }; int Q; }",
        {("Class", "A"), *(("Field", n) for n in "abcdQ"), ("Property", "P"), ("Property", "E")},
    ),
    "tuples, generics and local types": (
        "class A<T> where T : class { (int a, int b) M((int, int) p, int q = 1) { class_ x; return p; } Dictionary<string, List<int>> F, G; int this[int i] { get => 1; } global::X.Y Z { get; } }",
        {("Class", "A"), ("Method", "M"), ("Field", "F"), ("Field", "G"), ("Indexer", "this"), ("Property", "Z")},
    ),
    "enums, delegates and events": (
        "interface I { enum K { A = 1, B } delegate void D(int x); event Action E, F; event Action G { add { } remove { } } void M(); int P { get; } }",
        {("Interface", "I"), ("Event", "E"), ("Event", "F"), ("Method", "M"), ("Property", "P")},
    ),
    "comparison operators": (
        "struct S { public static bool operator ==(S a, S b) => true; public static bool operator <=(S a, S b) { return a == b; } public static bool operator true(S a) => true; int Q = 1; }",
        {("Struct", "S"), ("Operator", "=="), ("Operator", "<="), ("Operator", "true"), ("Field", "Q")},
    ),
    "a brace that nothing closes": ("class A { void M() { int x = 1; ", {("Class", "A"), ("Method", "M")}),
    "braces that nothing opens": ("} } class A { int Q; class B { } } }", {("Class", "A"), ("Field", "Q"), ("Class", "B")}),
    "nothing": ("", set()),
}


@pytest.fixture(scope="module")
def every(spark):
    names = list(CASES)
    rows = scan(spark, *[CASES[n][0] for n in names]).collect()
    return {n: {(r.kind, r.name) for r in rows if r.path == f"{i}.cs"} for i, n in enumerate(names)}


@pytest.mark.parametrize("name", list(CASES))
def test_ordinary_code(every, name):
    assert every[name] == CASES[name][1]


def test_full_names_follow_nesting(spark):
    code = "namespace A.B { namespace C { class D { struct E { interface F { void M(); } } int g; } } record R(int X) : Q(X); }"
    assert found(spark, code) == [
        ("Class", "A.B.C.D", "D"), ("Field", "A.B.C.D", "g"), ("Interface", "A.B.C.D.E.F", "F"), ("Method", "A.B.C.D.E.F", "M"),
        ("Record", "A.B.R", "R"), ("Struct", "A.B.C.D.E", "E"),
    ]
    assert found(spark, "namespace A.B;\nclass C { class D { } }\nclass E { }") == [("Class", "A.B.C", "C"), ("Class", "A.B.C.D", "D"), ("Class", "A.B.E", "E")]


def test_symbols_and_conditions(spark):
    code = "#define OWN\nclass A {\n#if OWN && (X || !Y) // told\nint a;\n#elif Y == false\nint b;\n#else\nint c; // {\n#endif\n#undef OWN\n#if OWN\nint {{ d;\n#if true\nint e;\n#endif\n#endif\nint f;\n}"
    fields = lambda **given: {n for kind, _, n in found(spark, code, **given) if kind == "Field"}
    assert fields() == {"a", "f"} and fields(symbols=frozenset({"Y"})) == {"c", "f"} and fields(symbols=frozenset({"X", "Y"})) == {"a", "f"}
    assert csharp.blanked("#if (\nx\n#endif\n#if\ny\n#endif\nz") == "     \n \n      \n   \n \n      \nz"


def test_blanking_keeps_length_and_lines():
    for code, _ in CASES.values():
        masked = csharp.blanked(code)
        assert len(masked) == len(code) and masked.count("\n") == code.count("\n") and not set("\"'#") & set(masked)
    for code in ('$"{', '"', "'", "/*", '@"', '$"""{', "#if", '$"{"{', "#if x\n{", "//"):
        assert len(csharp.blanked(code)) == len(code)


def test_odd_files(spark):
    code = "// first\nclass A\n{\n    /* b */ int b;\n}\n"
    rows = [("a.cs", code), ("a.cs", code), (None, code), ("n.cs", None), ("e.cs", "")]
    df = spark.createDataFrame(rows, "path string, content string").selectExpr("*", "'clash' AS kind", "1 AS start", "'x' AS _file")
    got = csharp.scan_declarations(df).collect()
    assert Counter((r.path, r.kind, r.name, r.line) for r in got) == Counter(
        {("a.cs", "Class", "A", 2): 2, ("a.cs", "Field", "b", 4): 2, (None, "Class", "A", 2): 1, (None, "Field", "b", 4): 1}
    )
    assert all(code[r.start : r.start + r.length] == r.source for r in got)
    assert next(r.source for r in got if r.kind == "Field") == "\n    /* b */ int b;"
    assert csharp.scan_declarations(df.limit(0)).count() == 0
