"""Steps must not move or repeat more than their input: what the plans of the larger queries look like, and their rows by brute force."""

import random
import re

from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import callgraph, search, types
from codeloom.operators.relations import CALLS, FILES, SYMBOLS, enclosing, file_lines
from codeloom.plans.queries import Q
from codeloom.sources import adapters as A


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _symbols(spark, rows):
    """From (path, ordinal, name, symbol_type, signature, line_start, line_end)."""
    return spark.createDataFrame([(p, i, n, k, s, None, a, b, None, True) for p, i, n, k, s, a, b in rows], SYMBOLS)


def _files(spark, contents):
    langs = {"py": "python", "rs": "rust", "java": "java"}
    return spark.createDataFrame([(p, langs[p.rsplit(".", 1)[-1]], len(c), "", c) for p, c in contents.items()], FILES)


def _shuffled(spark, run):
    """Bytes that the stages of ``run`` wrote for shuffles."""
    sc = spark.sparkContext
    none, empty = sc._jvm.java.util.ArrayList(), sc._gateway.new_array(sc._jvm.double, 0)

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(none, False, False, empty, none)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (stages.apply(i) for i in range(stages.size()))}

    before = total()
    out = run()
    return out, sum(n for k, n in total().items() if k not in before)


def test_trace_shuffles_no_more_than_its_frontiers(spark):
    n = 20_000
    symbols = spark.range(n).select(F.lit("f.py").alias("path"), F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("n"), "id").alias("name"), F.lit("function").alias("symbol_type"), F.lit(None).cast("string").alias("signature"), F.lit(None).cast("string").alias("docstring"), (F.col("id") * 2 + 1).cast("int").alias("line_start"), (F.col("id") * 2 + 2).cast("int").alias("line_end"), F.lit(None).cast("int").alias("parent_ordinal"), F.lit(True).alias("is_exported"))
    calls = spark.range(n).select(F.lit("f.py").alias("path"), F.col("id").cast("int").alias("ordinal"), F.concat(F.lit("n"), (F.col("id") * 7 + 1) % n).alias("call_name"), (F.col("id") * 2 + 2).cast("int").alias("line"), F.lit("x").alias("context"))
    got, moved = _shuffled(spark, lambda: [r.name for r in callgraph.trace(symbols, calls, "n1", "n400").orderBy("step").collect()])
    assert got == ["n1", "n8", "n57", "n400"]
    assert moved < 50_000


def test_bodies_split_a_file_once(spark):
    text = "".join(f"line {i}\n" for i in range(1, 41))
    s = _symbols(spark, [("a.py", i, f"n{i}", "function", None, i, min(40, i + i % 5)) for i in range(1, 41)] + [("gone.py", 0, "g", "function", None, 1, 1)])
    for cap in (None, 2):
        df = search.with_bodies(s, _files(spark, {"a.py": text}), cap=cap)
        assert _plan(df).index("Join") < _plan(df).index("split(")  # below the join of a file's symbols with its lines
        want = {i: "\n".join(f"line {j}" for j in range(i, min(40, i + i % 5) + 1)) for i in range(1, 41)}
        want = {i: b if cap is None or b.count("\n") < cap else None for i, b in want.items()}
        assert {r.ordinal: r.body for r in df.collect()} == {**want, 0: None}


def test_bodies_move_only_the_columns_asked_for(spark, tmp_path):
    text = "The cat sat\n\n123\nA dog\nran\n"
    spark.createDataFrame([(1, text, "en", "web"), (2, text.replace("\n", "\r\n"), "fr", "web"), (3, None, "en", "web"), (4, "", "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    capped, whole = ({(r.path, r.ordinal): r.body for r in Q[name](spark, str(tmp_path)).collect()} for name in ("O9_capped_bodies", "X15_symbol_bodies"))
    paths = ("web/1.py", "web/2.js")
    assert whole == {(p, i): b for p in paths for i, b in ((1, "The cat sat\n\n123"), (4, "A dog"), (5, "ran"))}
    assert capped == {k: b if "\n" not in b else None for k, b in whole.items()}
    for name in ("O9_capped_bodies", "X15_symbol_bodies"):
        plan = _plan(Q[name](spark, str(tmp_path)))
        assert "collect_list" not in plan
        assert plan.count("regexp_extract(") == 1  # a symbol's name; not its signature
        assert plan.count("Window") == 2


def test_lines_without_carriage_returns_need_no_pattern(spark):
    texts = ["", "\n", "\n\n", "a", "a\n", "a\n\n", "a\nb", "\na", "a\r\nb\r\n", "a\rb\n", "a\n\r\n", "\r", "\r\n", "a\r", "ä€\U0001f600\n", "a\x85b\u2028c\x0c\nd", None]
    want = {t: None if t is None else [] if t == "" else re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", t)) for t in texts}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.ls for r in df.select("t", X.lines(F.col("t")).alias("ls")).collect()} == want
    bad = spark.sql("select cast(x as string) t from values (X'61E20A'), (X'E2') as v(x)").select(F.transform(X.lines(F.col("t")), lambda s: s.cast("binary")).alias("ls"))
    assert [[bytes(x) for x in r.ls] for r in bad.collect()] == [["a\ufffd".encode()], ["\ufffd".encode()]]


def test_enclosing_groups_no_calls(spark):
    rnd = random.Random(7)
    spans = [(p, i, a, min(150, a + rnd.choice((0, 3, 40, 120)))) for p in ("a.py", "b.py") for i, a in enumerate(rnd.choices(range(1, 150), k=60))]
    s = _symbols(spark, [(p, i, f"{p}{i}", "function", None, a, b) for p, i, a, b in spans])
    calls = [(p, i, "f", line, "") for p in ("a.py", "b.py", "c.py") for i, line in enumerate(range(1, 171))]
    df = enclosing(spark.createDataFrame(calls, CALLS), s)
    assert "Aggregate" not in _plan(df).split("Join", 1)[0]
    around = lambda p, n: min(((b - a, i) for q, i, a, b in spans if q == p and a <= n <= b), default=None)
    assert {(r.path, r.line): r.enc and (r.enc.span, r.enc.sordinal) for r in df.collect()} == {(p, n): around(p, n) for p, _, _, n, _ in calls}


def test_callees_shuffle_lines_before_they_are_taken_apart(spark):
    f = _files(spark, {"a.py": "The cat sat\nA The dog ran\nThe end cat\n", "b.py": "None The\nThe dog\nsat Any\n"})
    ls = file_lines(f)
    df = callgraph.callees(A.symbols(ls), A.calls(ls), "The")
    words = _plan(df).index("posexplode(array_distinct(")
    assert words < _plan(df).index("LeftSemi")
    got = sorted((r.callee_name, r.path, r.line, r.context) for r in df.collect())
    assert got == [("cat", "<external>", 2, "The cat sat"), ("dog", "<external>", 3, "The dog"), ("end", "<external>", 4, "The end cat"), ("sat", "b.py", 3, "(Any)")]


def _marked(lines, marks, opening):
    out = set()
    for i in range(len(lines)):
        for line in lines[i::-1]:
            if any(m in line for m in marks):
                out.add(i + 1)
                break
            if line.strip() and not line.strip().startswith((opening, "//")):
                break
    return out


def test_marks_are_found_without_the_lines_of_a_file_at_each_symbol(spark):
    rnd = random.Random(3)
    rust = rnd.choices(["#[test]", "  #[a]", "", "// c", "fn f() {}", "x(); // #[test]"], k=80)
    java = rnd.choices(["@Test", " @A", "", "// @Test", "void f() {}"], k=80)
    f = _files(spark, {"a.rs": "\n".join([*rust, "end"]), "b.java": "\n".join([*java, "end"]), "c.py": "#[test]\nx"})
    s = _symbols(spark, [(p, i, "f", "function", None, i, i) for p in ("a.rs", "b.java", "c.py") for i in range(1, 81)])
    df = callgraph.test_symbols(s, f)
    assert "aggregate(" not in _plan(df)
    want = {"a.rs": _marked(rust, ("#[test]", "#[tokio::test]"), "#["), "b.java": _marked(java, ("@Test",), "@"), "c.py": set()}
    got = df.collect()
    assert len(got) == 240
    assert {p: {r.line_start for r in got if r.path == p and r.marked} for p in want} == want


def test_impact_reads_all_calls_once(spark):
    f = _files(spark, {"a.py": "def load():\n    load()\n", "test_a.py": "def test_load():\n    load()\n"})
    s = _symbols(spark, [("a.py", 0, "load", "function", None, 1, 2), ("test_a.py", 0, "test_load", "function", None, 1, 2)])
    c = spark.createDataFrame([("a.py", 0, "load", 2, "load()"), ("test_a.py", 0, "load", 2, "load()")], CALLS)
    x = callgraph.impact(s, c, f, "load", limit=None)
    assert "Join LeftOuter" not in _plan(x["totals"])
    assert [tuple(r) for r in x["totals"].collect()] == [(1, 1, False)]
    assert [(r.caller_name, r.path) for r in x["callers"].collect()] == [("test_load", "test_a.py")]


def test_types_are_resolved_once_each(spark):
    s = _symbols(spark, [("p.py", i, f"part_{i}", "function", "(a: List[Big], b: int) -> big", i + 1, i + 1) for i in range(50)] + [("b.py", 0, "Big", "class", None, 9, 9)])
    df = types.types_of(s, "part_", fuzzy=True)
    assert "Aggregate" not in _plan(df)
    rows = df.groupBy("kind", "param", "type", "def_path", "def_line").count().collect()
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, [("param", "a", "List[Big]", "b.py", 9, 50), ("param", "b", "int", None, None, 50), ("return", None, "big", "b.py", 9, 50)]))
