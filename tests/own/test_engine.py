import subprocess

import pytest
from pyspark.sql import functions as F

from codeloom import cli
from codeloom.engine import CodeIndex, search_tree
from codeloom.functions import signatures as S
from codeloom.functions import text as X
from codeloom.operators import callgraph, history
from codeloom.plans import maintain

APP = """import helpers
from helpers import load
class Store(Base):
    size: int = 1
    def save(self, item: Item):
        self.check(item)
        return write(item)
    def check(self, item):
        return bool(item)
def main():
    s = Store()
    s.save(load())
def lonely(a: Store):
    return 1
"""
HELPERS = "def load():\n    return read()\ndef write(x):\n    return x\ndef read():\n    return load()\n"
TESTS = "from helpers import load\ndef test_load():\n    assert load()\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    d = tmp_path_factory.mktemp("tree")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", str(d), *a], check=True, capture_output=True)
    (d / "node_modules").mkdir()
    (d / "node_modules" / "skip.py").write_text("def skipped(): pass\n")
    (d / "app.py").write_text("def old(a):\n    return a\n" + APP)
    (d / "helpers.py").write_text(HELPERS)
    (d / "gone.py").write_text("def vanished():\n    pass\n")
    git("init", "-q")
    git("add", "app.py", "helpers.py", "gone.py")
    git("commit", "-qm", "one|first")
    (d / "app.py").write_text(APP.replace("def lonely(a: Store)", "def lonely(a)"))
    (d / "gone.py").unlink()
    git("add", "-A", "app.py", "gone.py")
    git("commit", "-qm", "two")
    (d / "app.py").write_text(APP)
    (d / "test_helpers.py").write_text(TESTS)
    (d / "bad.py").write_bytes(b"\xff\xfe\x00")
    (d / "README.md").write_text("# Title\n\n## helpers.py\n")
    git("add", "app.py")
    git("commit", "-qm", "three")
    return d


@pytest.fixture(scope="module")
def index(spark, tree):
    return CodeIndex.of_tree(spark, str(tree))


def test_scan(index):
    assert {r.path for r in index.files.collect()} == {"app.py", "helpers.py", "test_helpers.py", "README.md"}


def test_search(index, spark, tree):
    assert [r.name for r in index.query("load").collect()] == ["load", "test_load"]
    assert [r.name for r in index.query("functions").collect()] == ["main", "lonely", "load", "write", "read", "test_load"]
    fast = [r.name for r in search_tree(spark, str(tree), "load", fast=True).collect()]
    assert fast == [r.name for r in search_tree(spark, str(tree), "load").collect()] == ["load", "test_load"]
    assert index.query("load", symbol_type="nonsense").count() == 0


def test_call_graph(index):
    got = {(r.caller_name, r.path, r.line) for r in index.callers("load").collect()}
    assert got == {("main", "app.py", 12), ("read", "helpers.py", 6), ("test_load", "test_helpers.py", 3)}
    assert index.callers("bool").count() == 0  # called, but not defined
    assert {(r.callee_name, r.path, r.line) for r in index.callees("save").collect()} == {("check", "app.py", 8), ("write", "helpers.py", 3)}
    assert {(r.callee_name, r.path, r.line) for r in index.callees("check").collect()} == {("bool", "<external>", 10)}
    assert [(r.test_name, r.call_line) for r in index.tests("load").collect()] == [("test_load", 3)]
    assert [(r.name, r.called_from_line) for r in index.test_deps("test_helpers.py").collect()] == [("load", 3)]
    with pytest.raises(ValueError):
        index.test_deps("app.py")
    assert [r.name for r in index.trace("main", "write").collect()] == ["main", "Store", "write"]  # the class's span holds the call
    assert [r.name for r in index.trace("load", "load").collect()] == ["load", "read", "load"]
    assert index.trace("write", "main").count() == 0
    assert "load" not in {r.name for r in index.untested().collect()}
    assert [(r.category, r.name) for r in index.entrypoints().collect()] == [("main", "main"), ("unused", "lonely")]
    parts = index.impact("lonely")
    assert parts["totals"].first().is_untested and parts["target"].first().name == "lonely"
    assert set(index.impact("no such name")) == {"target", "shortlist"}


def test_depth_bound(spark):
    n = 13
    text = "".join(f"def f{i}():\n    f{i + 1}()\n" for i in range(n))
    x = CodeIndex.of_files(spark.createDataFrame([("a.py", "python", text, len(text), "h")], "path string, language string, content string, size long, hash string"))
    assert x.trace("f0", "f10").count() == 11 and x.trace("f0", "f11").count() == 0


def test_enclosing_takes_the_narrowest(spark):
    calls = spark.createDataFrame([("a", 0, "f", 40, ""), ("a", 1, "g", 500, ""), ("b", 2, "h", 1, "")], "path string, ordinal int, call_name string, line int, context string")
    syms = spark.createDataFrame([("a", 0, "wide", "class", 1, 400), ("a", 1, "in", "method", 33, 64), ("a", 2, "also", "method", 33, 64)], "path string, ordinal int, name string, symbol_type string, line_start int, line_end int")
    from codeloom.operators.relations import enclosing

    assert {r.call_name: r.enc and r.enc.sname for r in enclosing(calls, syms).collect()} == {"f": "in", "g": None, "h": None}


def test_qualified_names(spark):
    df = spark.createDataFrame([("show", "Point::show(p)"), ("show", "other.show()"), ("Point::show", "x")], "c string, t string")
    got = lambda q, fuzzy=False: df.filter(callgraph.call_matches(F.col("c"), F.col("t"), q, fuzzy)).count()
    assert got("show") == 3 and got("Point::show") == 1 and got("how", True) == 3


def test_deps_types_schema(index):
    assert [r.import_name for r in index.imports_of("app.py").collect()] == ["helpers", "load"]
    assert {(r.path, r.line) for r in index.used_by("load").collect()} == {("app.py", 2), ("app.py", 12), ("helpers.py", 6), ("test_helpers.py", 1), ("test_helpers.py", 2), ("test_helpers.py", 3)}
    assert [(r.param, r.type, r.def_path) for r in index.types("lonely").collect()] == [("a", "Store", "app.py")]
    assert [f.field for f in index.schema("Store").first().fields] == ["size"]
    assert [(r.implementor, r.kind) for r in index.implements("Base").collect()] == [("Store", "inherits")]


def test_implements_by_language(spark):
    rows = [("a.rs", 1, "impl Show for Box<T> {"), ("a.rs", 2, "impl Box {"), ("a.ts", 1, "class A<T> extends B<T> implements C, D<E> {"), ("A.java", 1, "interface I extends J, K {"), ("a.go", 1, "type T struct {"), ("a.go", 2, "  Base"), ("a.go", 3, "}"), ("a.go", 4, "Base"), ("a.py", 1, "class É(x.P[int], Q):")]
    from codeloom.operators.implements import implementations, implements

    df = spark.createDataFrame(rows, "path string, line int, text string")
    got = {(r.implementor, r.interface, r.kind) for r in implementations(df).collect()}
    assert got == {("Box", "Show", "impl"), ("Box", "Box", "impl"), ("A", "C", "implements"), ("A", "D", "implements"), ("A", "B", "extends"), ("I", "J", "extends"), ("I", "K", "extends"), ("T", "Base", "implements"), ("É", "P", "inherits"), ("É", "Q", "inherits")}
    assert {r.interface for r in implements(df, "Box", trait_only=True).collect()} == {"Show"}


def test_signatures(spark):
    cases = [
        ("rust", "fn f(&self, a: Vec<String, u32>, b: &mut User) -> Result<User>", [("a", "Vec<String, u32>"), ("b", "&mut User")], "Result<User>"),
        ("python", "(self, a: int = 3, b: Dict[str, X]) -> X:", [("a", "int"), ("b", "Dict[str, X]")], "X"),
        ("typescript", "f(a?: Foo, b: Bar = x): Promise<Baz> {", [("a", "Foo"), ("b", "Bar")], "Promise<Baz>"),
        ("go", "func f(a int, u *User) (error) {", [("a", "int"), ("u", "*User")], "(error)"),
        ("java", "public List<X> f(final Y y, @N Z z)", [("y", "Y"), ("z", "Z")], "List<X>"),
        ("c", "int f(struct User *u, void)", [("u", "struct User*")], "int"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _, _) in enumerate(cases)], "i int, l string, s string")
    got = df.select("i", S.parameters(F.col("l"), F.col("s")).alias("p"), S.return_type(F.col("l"), F.col("s")).alias("r")).orderBy("i").collect()
    for row, (_, _, params, ret) in zip(got, cases, strict=True):
        assert [(x["name"], x["type"]) for x in row.p] == params and row.r == ret, row
    base = lambda t: spark.range(1).select(S.base_types(F.lit(t)).alias("b")).first().b
    assert base("Vec<User>") == ["User"] and base("Option<String>") == [] and base("HashMap<String, User>") == ["User"] and base("&mut Foo<Bar>") == ["Foo", "Bar"]


def test_lines(spark):
    get = lambda t: spark.createDataFrame([(t,)], "t string").select(X.lines(F.col("t")).alias("l")).first().l
    assert get("") == [] and get("a\r\nb\n") == ["a", "b"] and get("a\n\n") == ["a", ""] and get("\n") == [""]


def test_test_marks(spark):
    java = "class A {\n  @Test\n  public void one() {}\n  @Override\n  // note\n  public void two() {}\n  // @Test in words\n\n  @Test\n  @Slow\n  void three() {}\n  void testFour() {}\n}\n"
    rust = "#[test] fn a() {}\n#[test]\nfn b() {}\nfn test_c() {}\n"
    files = spark.createDataFrame([("A.java", "java", java, 1, "h"), ("a.rs", "rust", rust, 1, "h")], "path string, language string, content string, size long, hash string")
    x = CodeIndex.of_files(files)
    got = {r.name: r.is_test for r in callgraph.test_symbols(x.symbols, x.files).collect()}
    assert {n for n, t in got.items() if t} == {"one", "three", "testFour", "a", "test_c"}


def test_words_and_aliases():
    assert X.SINGULAR["fn"] == "function" and X.PLURALS["funcs"] == "function" and X.PLURALS["classes"] == "class" and X.PLURALS["type_aliases"] == X.PLURALS["types"] == "type" and X.PLURALS["headers"] == "heading"
    assert len(X.API_WORDS) == 21 and len(X.MAIN_WORDS) == 7


def test_history(index):
    d = {(r.change_type, r.name) for r in index.diff("HEAD~2").collect()}
    assert ("deleted", "old") in d and ("deleted", "vanished") in d and not any(n == "load" for _, n in d)
    b = {(r.change_type, r.name) for r in index.since("HEAD~1", breaking=True).collect()}
    assert b == {("signature_changed", "lonely")}
    last = index.blame("lonely", "app.py").first()
    assert (last.message, last.old_signature, last.new_signature) == ("three", "(a)", "(a: Store)")
    assert [(r.message, r.existed) for r in index.history("lonely", "app.py").collect()] == [("three", True), ("two", True), ("one|first", True)]
    assert [(r.message, r.existed) for r in index.history("old", "app.py").collect()] == [("two", False), ("one|first", True)]
    with pytest.raises(ValueError):
        index.diff("nonsense")


def test_history_rules(spark):
    def run(*rows):  # newest first: (present, signature, length)
        data = [("p", i, f"c{i}", p, "function", s, 1 if p else None, n if p else None) for i, (p, s, n) in enumerate(rows)]
        df = spark.createDataFrame(data, "path string, seq int, hash string, present boolean, symbol_type string, signature string, line_start int, line_end int")
        return [(r.seq, r.existed) for r in history.history(df).orderBy("seq").collect()], history.blame(df).first().seq

    assert run((True, "a", 3), (True, "a", 3), (True, "a", 3)) == ([(2, True)], 0)  # never changed: the newest commit
    assert run((True, "b", 3), (True, "a", 3), (False, None, None)) == ([(0, True), (1, True)], 0)
    assert run((True, "a", 3), (False, None, None), (True, "a", 3)) == ([(0, True), (1, False), (2, True)], 0)
    assert run((True, None, 3), (False, None, None), (True, None, 3))[0] == [(2, True)]  # a null signature leaves no trace


def test_diff_in_a_folder_and_of_some_extensions(spark, tmp_path):
    """Below the repository's root only that folder's files count, by the index's paths; other extensions and ignored folders don't."""
    git = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", str(tmp_path), *a], check=True, capture_output=True)
    for d in ("sub", "sub/build", "other"):
        (tmp_path / d).mkdir()
    for name in ("sub/a.py", "sub/build/b.py", "other/c.py"):
        (tmp_path / name).write_text("def one(a): pass\ndef two(): pass\n")
    (tmp_path / "sub" / "d.js").write_text("function three(a) { return a; }\n")
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    for name in ("sub/a.py", "sub/build/b.py", "other/c.py"):
        (tmp_path / name).write_text("def one(a, b): pass\n")
    (tmp_path / "sub" / "d.js").write_text("function four(a) { return a; }\n")
    git("add", "-A")
    git("commit", "-qm", "two")
    both = CodeIndex.of_tree(spark, str(tmp_path / "sub"))
    got = {(r.path, r.change_type, r.name) for r in both.diff("HEAD~1").collect()}
    assert got == {("a.py", "signature_changed", "one"), ("a.py", "deleted", "two"), ("d.js", "deleted", "three"), ("d.js", "added", "four")}
    some = CodeIndex.of_tree(spark, str(tmp_path / "sub"), ("py",))
    assert {(r.path, r.name) for r in some.since("HEAD~1").collect()} == {("a.py", "one"), ("a.py", "two")}
    whole = CodeIndex.of_tree(spark, str(tmp_path), ("js",))
    assert {(r.path, r.name) for r in whole.diff("HEAD~1").collect()} == {("sub/d.js", "three"), ("sub/d.js", "four")}


def test_refreshed_reads_what_changed(spark, tmp_path, monkeypatch):
    import os

    from codeloom import engine

    root, folder = tmp_path / "t", str(tmp_path / "cache")
    root.mkdir()
    for i in range(12):
        (root / f"m{i}.py").write_text(f"def f{i}(a): return g{i}(a)\n")
    rows = lambda x: sorted((r.path, r.name, r.signature) for r in x.symbols.collect())
    first = CodeIndex.refreshed(spark, folder, str(root))
    read = []
    inner = engine.read_files
    monkeypatch.setattr(engine, "read_files", lambda s, r, paths, *a: read.append(sorted(paths)) or inner(s, r, paths, *a))
    assert rows(CodeIndex.refreshed(spark, folder, str(root))) == rows(first) and not read
    (root / "m1.py").write_text("def f1(a, b): return g1(a)\n")
    (root / "m2.py").unlink()
    (root / "m12.py").write_text("def f12(): pass\n")
    os.utime(root / "m3.py", (1, 1))  # another time, the same content
    new = CodeIndex.refreshed(spark, folder, str(root))
    assert read == [["m1.py", "m12.py", "m3.py"]] and rows(new) == rows(CodeIndex.of_tree(spark, str(root)))
    assert rows(CodeIndex.refreshed(spark, folder, str(root))) == rows(new) and len(read) == 1
    assert {r.path for r in maintain.load_manifest(spark, folder).collect()} == {r.path for r in new.files.collect()}
    (root / "m4.py").write_bytes(b"\xff\xfe\x00")  # no longer text
    assert "m4.py" not in {p for p, *_ in rows(CodeIndex.refreshed(spark, folder, str(root)))}
    with pytest.raises(ValueError):
        maintain.save_index({"files": new.files}, folder, new.files.select("path", "hash", "size").limit(1))


def test_snapshots(index, spark, tmp_path):
    folder = str(tmp_path / "snap")
    index.snapshot(folder, "one")
    index.snapshot(folder, "two")
    assert [r.snapshot for r in maintain.list_snapshots(spark, folder).collect()] == ["one", "two"]
    assert index.compare(folder, "one").count() == 0
    assert maintain.delete_snapshot(spark, folder, "two")
    with pytest.raises(ValueError):
        maintain.load_snapshot(spark, folder, "two")


def test_update_parses_only_changes(index, spark, tmp_path):
    files = index.files.withColumn("content", F.when(F.col("path") == "helpers.py", F.lit("def fresh():\n    pass\n")).otherwise(F.col("content"))).withColumn("hash", X.content_hash(F.col("content"))).filter("path <> 'README.md'")
    new = index.updated(files)
    full = CodeIndex.of_files(files)
    key = lambda df: sorted((r.path, r.ordinal, r.name) for r in df.collect())
    assert key(new.symbols) == key(full.symbols) and "fresh" in {r.name for r in new.symbols.collect()}
    new.save(str(tmp_path / "i"))
    assert key(CodeIndex.load(spark, str(tmp_path / "i")).symbols) == key(full.symbols)
    assert maintain.inconsistent(new.files, new.files).count() == 0
    assert maintain.needs_full_rebuild(101, 10**6) and not maintain.needs_full_rebuild(100, 1000)


def test_stream(spark, index, tmp_path):
    from codeloom.streaming.watch import follow

    src = tmp_path / "in"
    spark.createDataFrame([(1, "app.py", "python", "def a(): pass\n"), (2, "app.py", "python", "def b(): pass\n"), (3, "helpers.py", "python", None)], "seq long, path string, language string, content string").write.parquet(str(src))
    state = {"symbols": index.symbols, "imports": index.imports, "calls": index.calls, "fields": index.fields}
    q = follow(spark.readStream.schema("seq long, path string, language string, content string").parquet(str(src)), lambda: state, lambda t, i: state.update(t), str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    names = {(r.path, r.name) for r in state["symbols"].collect()}
    assert ("app.py", "b") in names and not any(p == "helpers.py" or n in ("a", "main") for p, n in names) and ("test_helpers.py", "test_load") in names


def test_command_line(spark, tree, tmp_path):
    run = lambda *a: cli.run(["--format", "ai", "--cache-dir", str(tmp_path), *a], spark)
    out = run("stats", str(tree)).split("\n")
    assert out[0] == "[STATS]" and out[1] == "LANGS: markdown:1 python:3" and out[3].startswith("TOTALS: files:4 syms:")
    assert run("trace", "main", "write", str(tree)).split("\n")[1:3] == ["FOUND:true STEPS:3", "PATH:main|Store|write"]
    assert run("callers", "load", str(tree)).startswith("[CALLERS:load|3]\nmain|f|app.py:12")
    assert "F:size?|int|=1" in run("schema", "Store", str(tree))
    assert run("untested", str(tree)).startswith("[UNTESTED:")
    assert run("query", "load", str(tree), "--fast").startswith("[RESULTS:2]\nload|f|helpers.py|1-2|exp\n")
    assert run("query", "load", str(tree), "--fast", "--context", "full").startswith("[RESULTS:2]\nload|f|helpers.py|1-2|exp|sig:()\n")
    assert run("query", "load", str(tree), "--exact", "--show-body").split("\n") == ["[RESULTS:1]", "load|f|helpers.py|1-2|exp|body:", "  def load():", "      return read()"]
    size = len((tree / "helpers.py").read_text())
    assert run("inspect", "helpers.py", str(tree)).split("\n") == ["[FILE:helpers.py]", f"LANG:python SIZE:{size} SYMS:3", "load|f|1-2|sig:()", "write|f|3-4|sig:(x)", "read|f|5-6|sig:()"]
    assert run("map", str(tree), "--level", "3").split("\n")[4:6] == ["[FILES]", f"README.md|markdown|{len((tree / 'README.md').read_text())}|h:Title@1-1,h:helpers.py@3-3"]
    assert cli.run(["--format", "human", "stats", str(tree)], spark).startswith("Stats") and "| metric |" in cli.run(["stats", str(tree)], spark)
    with pytest.raises(ValueError):
        cli.run(["stats", str(tree / "nothing")], spark)


def test_snapshots_on_the_command_line(spark, tree, tmp_path):
    run = lambda *a: cli.run(["--format", "ai", "--cache-dir", str(tmp_path), *a], spark)
    assert run("snapshot", "any", str(tree), "--list") == "[SNAPSHOTS:0]"
    with pytest.raises(ValueError):
        run("compare", "first", str(tree))
    head, counts = run("snapshot", "first", str(tree)).split("\n")
    assert head == "[SNAPSHOT_SAVED:first]" and counts.startswith("FILES:4 SYMBOLS:")
    assert run("snapshot", "any", str(tree), "--list") == "[SNAPSHOTS:1]\nfirst" and run("compare", "first", str(tree)) == "NO_CHANGES"
    assert run("snapshot", "any", str(tree), "--delete", "first") == "deleted" and run("snapshot", "any", str(tree), "--list") == "[SNAPSHOTS:0]"


def test_symbol_forms_and_totals(spark, tree):
    show = lambda form, *a: cli.run(["--format", form, *a], spark)
    plain = show("default", "query", "load", str(tree), "--exact", "--show-body", "--context", "full").split("\n")
    assert plain == ["# 1 symbols", "", "## load", "- Type: function (exported)", "- File: helpers.py", "- Lines: 1-2", "- Signature: ()", "", "Code:", "def load():", "    return read()"]
    human = show("human", "inspect", "helpers.py", str(tree)).split("\n")
    assert human[0].startswith("helpers.py: python, ") and human[0].endswith(" 3 symbols") and human[2].split() == "| Name | Type | File | Lines | Exported |".split()
    assert show("default", "callers", "load", str(tree), "--limit", "2").startswith("# Callers (2 of 3)\n") and show("default", "callers", "load", str(tree), "--limit", "9").startswith("# Callers (3)\n")
    assert "No results." in show("human", "query", "no_such_name", str(tree))
