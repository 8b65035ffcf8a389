import pytest

from codeloom.sources.extract import parse
from codeloom.sources.samples import C, GO, JAVA, MD, PY, RUST, TS


def rows(text, lang):
    return [(s["name"], s["symbol_type"], s["signature"], s["is_exported"]) for s in parse(text, lang).symbols]


def test_rust():
    f = parse(RUST, "rust")
    assert rows(RUST, "rust") == [("Point", "class", None, True), ("Shape", "enum", None, True), ("Shape::Circle", "enum", "variant of Shape", True), ("Shape::Square", "enum", "variant of Shape", True), ("LIMIT", "static", "usize", False), ("impl Point", "class", None, False), ("new", "method", "(x: i32)", True), ("show", "method", "(&self)", False), ("helper", "function", "(v: i32)", False)]
    assert set(f.called) == {("helper", 6), ("println", 7), ("text", 7), ("with", 7), ("abs", 9)}
    assert [(x["name"], x["type"], x["optional"]) for x in f.fields if x["symbol_ordinal"] == 0] == [("x", "i32", False), ("name", "Option<String>", True), ("m", "HashMap<K, V>", False)]
    assert f.imports == [("std::fmt", None)]
    assert [s["parent_ordinal"] for s in f.symbols if s["symbol_type"] == "method"] == [5, 5]


def test_go():
    f = parse(GO, "go")
    assert rows(GO, "go") == [("User", "class", "struct", True), ("Runner", "class", "interface", True), ("Make", "function", "(*User, error)", True), ("Rename", "method", "(s string)", True), ("A", "static", None, True), ("b", "static", None, False)]
    assert set(f.called) == {("Println", 16), ("helper", 16), ("set", 17)}
    assert [(x["name"], x["type"], x["optional"]) for x in f.fields] == [("Name", "string", False), ("Nick", "string", False), ("Next", "*User", True)]
    assert {i for i, _ in f.imports} == {"fmt", "os"} and f.symbols[0]["docstring"] == "// User is one."


def test_java():
    f = parse(JAVA, "java")
    assert rows(JAVA, "java") == [("Box", "class", None, True), ("Shape", "class", None, False), ("Color", "enum", None, False), ("MAX", "static", "int", False), ("name", "method", "(int a)", True), ("later", "method", "()", False), ("area", "method", "(int k)", False), ("Box", "method", "(int n)", True)]
    assert set(f.called) == {("init", 7), ("call", 8), ("trim", 8)}
    assert f.imports == [("java.util.List", None)] and f.symbols[0]["docstring"] == "/** Doc. */"


def test_typescript():
    f = parse(TS, "typescript")
    got = [(n, k) for n, k, _, _ in rows(TS, "typescript")]
    assert ("Box", "class") in got and ("make", "function") in got and ("plain", "function") in got and ("get", "method") in got
    assert got[-3:] == [("Shape", "interface"), ("Id", "type"), ("Color", "enum")]
    assert ("test:works", "function") in got and ("describe:box", "function") in got
    assert {i for i, _ in f.imports} >= {"lib", "fs"}
    assert {n for n, _ in f.called} >= {"require", "find", "make", "describe", "it", "expect"} and "Box" not in {n for n, _ in f.called}
    assert [(x["name"], x["type"], x["optional"], x["default_value"]) for x in f.fields] == [("n", "number", False, "1"), ("name", "string", True, None)]


def test_c():
    f = parse(C, "c")
    assert rows(C, "c") == [("Node", "class", "struct", False), ("sum", "function", "(int a, int b)", False)]
    assert set(f.called) == {("printf", 5), ("add", 5)} and f.imports == [("stdio.h", None), ("own.h", None)]


def test_python():
    f = parse(PY, "python")
    assert rows(PY, "python") == [("Top", "class", None, True), ("In", "class", None, False), ("LIMIT", "static", "3", True), ("run", "method", "(self, k)", False), ("deep", "method", "(self)", False), ("free", "function", "(a, *b)", True)]
    assert set(f.called) == {("go", 8), ("helper", 11), ("x", 11)}
    assert f.imports == [("os.path", None), ("c", "a.b"), ("d", "a.b")]
    assert [(x["name"], x["type"], x["optional"]) for x in f.fields] == [("size", "int", True), ("note", "Optional[str]", True)]
    s = next(x for x in f.symbols if x["name"] == "LIMIT")
    assert (s["line_start"], s["line_end"]) == (1, 11)  # a constant spans the module


def test_relative_imports_lose_their_first_name():
    assert parse("from . import x\nfrom .m import y, z\n", "python").imports == [("z", "y")]


def test_broken_python_falls_back_to_lines():
    f = parse("class A:\n    def f(self):\n        g(1)\ndef h(:\n    pass\n", "python")
    assert [(s["name"], s["symbol_type"]) for s in f.symbols] == [("A", "class"), ("f", "method"), ("h", "function")] and ("g", 3) in f.called


def test_markdown():
    f = parse(MD, "markdown")
    assert [(s["name"], s["symbol_type"], s["signature"], s["parent_ordinal"]) for s in f.symbols] == [("One", "heading", "h1 (#)", None), ("Three", "heading", "h3 (###)", 0), ("Two", "heading", "h2 (##)", 1), ("[code: py]", "code_block", "py", None)]
    assert f.symbols[-1]["docstring"] == "# no\na\nb..."


@pytest.mark.parametrize("lang", ["python", "rust", "go", "java", "javascript", "typescript", "c", "markdown", "unknown"])
def test_odd_sources_never_fail(lang):
    for text in ("", "\n", "{{{", ")))", "\"", "'", "/*", "fn", "class", "func (", "struct {", "impl", "import", "type X", "\0", "é" * 10, RUST[:70], JAVA[:150], TS[:90], "```", "#" * 9):
        parse(text, lang)


def test_calls_are_counted_once_a_line():
    assert list(parse("def f():\n    g(1); g(2)\n    g(3)\n", "python").called) == [("g", 2), ("g", 3)]
