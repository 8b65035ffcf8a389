"""Callers, callees, tests, untested symbols, entry points, impact and call paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.relations import bucket_of, bucketed, enclosing, file_lines, first_definitions
from codeloom.operators.search import name_matches, score
from codeloom.session import cut, side, small

TOP = "<top-level>"
DEPTH = 10


def call_matches(call: Column, context: Column, wanted: str, fuzzy: bool) -> Column:
    """The call rule: the last parts agree or the whole; a qualified name must also be in the line."""
    if fuzzy:
        hit = F.lower(call).contains(X.tail_of(wanted).lower())
    else:
        hit = (X.tail(call) == X.tail_of(wanted)) | (call == wanted)
    if X.tail_of(wanted) != wanted:
        hit = hit & X.squashed(context).contains("".join(wanted.split()).lower())
    return hit


def callers(symbols: DataFrame, calls: DataFrame, wanted: str, fuzzy: bool = False, limit: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """(caller_name, caller_type, path, line, context); none if no such symbol is defined. ``near``: the symbols of all files with such calls, where they are at hand."""
    defined = symbols.filter(name_matches(F.col("name"), X.tail_of(wanted), fuzzy)).limit(1).select(F.lit(1).alias("one"))
    hits = calls.filter(call_matches(F.col("call_name"), F.col("context"), wanted, fuzzy))
    first = hits.groupBy("path", "line").agg(F.min(F.struct("ordinal", "call_name", "context")).alias("c")).select("path", "line", "c.ordinal", "c.context")
    at = enclosing(first, symbols if near is None else near).crossJoin(F.broadcast(defined))
    out = at.select(F.coalesce("enc.sname", F.lit(TOP)).alias("caller_name"), F.coalesce("enc.stype", F.lit("function")).alias("caller_type"), "path", "line", "context")
    return out.orderBy("path", "line").limit(limit) if limit is not None else out


def body_calls(symbols: DataFrame, calls: DataFrame, broadcast: bool = False) -> DataFrame:
    """(path, symbol_ordinal, sname, sline, ordinal, call_name, rel_line, context): the calls inside
    each symbol's span, rel_line 1 at its first line. ``broadcast``: the symbols were found small.

    Lines outside all spans are left out first, by a subquery: unlike a join it is planned below
    whatever takes a line apart into calls, so lines are shuffled and not their calls with a copy of
    the line each.
    """
    s = symbols.select(F.col("path").alias("sp"), F.col("ordinal").alias("symbol_ordinal"), F.col("name").alias("sname"), F.col("line_start").alias("sline"), F.col("line_end").alias("send"))
    s = bucketed(s, "sline", "send", "sb")
    s = F.broadcast(s) if broadcast else s.hint("shuffle_hash")
    inside = lambda path, line: (path == F.col("sp")) & (bucket_of(line) == F.col("sb")) & line.between(F.col("sline"), F.col("send"))
    outer = lambda name: F.col(f"outside.{name}").outer()  # noqa: E731  qualified: a bare name may be met inside the subquery
    near = calls.alias("outside").filter(s.filter(inside(outer("path"), outer("line"))).exists())
    hit = near.join(s, inside(F.col("path"), F.col("line")))
    return hit.select("path", "symbol_ordinal", "sname", "sline", "ordinal", "call_name", (F.col("line") - F.col("sline") + 1).alias("rel_line"), "context")


def _resolve(found: DataFrame, symbols: DataFrame) -> DataFrame:
    """Join calls to the first definition of their name; externals keep nulls. Definitions are broadcast if they are small, since few names make up most calls."""
    d = first_definitions(symbols).select(F.col("name").alias("dname"), F.col("path").alias("dpath"), F.col("ordinal").alias("dordinal"), F.col("symbol_type").alias("dtype"), F.col("line_start").alias("dline"), F.col("signature").alias("dsignature"))
    return found.join(side(cut(d)), F.col("call_name") == F.col("dname"), "left")


def callees(symbols: DataFrame, calls: DataFrame, wanted: str, fuzzy: bool = False, limit: int | None = None) -> DataFrame:
    """(callee_name, callee_type, path, line, context) of the calls in all symbols of that name.

    Internal callees are given by their definition and signature; external ones by the call's line
    (one more than the true line, as the reported contract has it) and text.
    """
    targets = symbols.filter(name_matches(F.col("name"), X.tail_of(wanted), fuzzy))
    r = _resolve(body_calls(targets, calls), symbols)  # before the choice, so that only external calls take their line along
    known = F.col("dname").isNotNull()
    told = (F.when(known, F.col("dtype")).otherwise("function").alias("callee_type"), F.when(known, F.col("dpath")).otherwise("<external>").alias("at"), F.when(known, F.col("dline")).otherwise(F.col("sline") + F.col("rel_line")).cast("int").alias("line"), F.when(known, F.coalesce("dsignature", F.lit(""))).otherwise(F.col("context")).alias("context"))
    first = r.groupBy("path", "call_name", "rel_line").agg(F.min(F.struct("sline", "symbol_ordinal", "ordinal", *told)).alias("c"))
    out = first.select(F.col("call_name").alias("callee_name"), "c.callee_type", F.col("c.at").alias("path"), "c.line", "c.context")
    return out.orderBy("path", "line", "callee_name").limit(limit) if limit is not None else out


def marked_lines(files: DataFrame) -> DataFrame:
    """(mp, at): the lines from which a search upward meets a test's mark.

    The search ends at the first line that isn't passed over, so the last mark must not be before
    the last such line. Only files of languages with marks are taken apart.
    """
    found, passed = X.test_mark(F.col("language"), F.col("text"))
    own = files.filter(F.col("language").isin(*X.TEST_MARKS)).select("path", "language", F.posexplode(X.lines(F.col("content"))).alias("at", "text"))
    own = own.select("path", F.col("at") + 1, found.alias("found"), passed.alias("passed")).toDF("mp", "at", "found", "passed")
    w = Window.partitionBy("mp").orderBy("at")
    last = lambda which: F.max(F.when(which, F.col("at"))).over(w)
    met = own.select("mp", "at", last(F.col("found")).alias("mark"), last(~F.col("passed")).alias("stop"))
    return met.filter(F.col("mark") >= F.coalesce("stop", F.lit(0))).select("mp", "at")


def with_marks(rows: DataFrame, files: DataFrame, line: Column) -> DataFrame:
    """rows (path, ...) with their file's language, and marked: whether a test's mark stands at a line."""
    named = rows.withColumn("marked_at", line).join(files.select("path", "language"), "path", "left")
    met = named.join(marked_lines(files), (F.col("path") == F.col("mp")) & (F.col("marked_at") == F.col("at")), "left")
    return met.withColumn("marked", F.col("mp").isNotNull()).drop("marked_at", "mp", "at")


def definition_lines(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols with language, definition (the text of their first line) and marked: whether a test's
    mark stands there."""
    ls = file_lines(files).toDF("lp", "ln", "definition")
    d = with_marks(symbols, files, F.col("line_start")).join(ls, (F.col("path") == F.col("lp")) & (F.col("line_start") == F.col("ln")), "left")
    return d.select(*symbols.columns, "language", "definition", "marked")


def test_symbols(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols with language, marked and is_test."""
    d = with_marks(symbols, files, F.col("line_start"))
    return d.withColumn("is_test", X.is_test_symbol(F.col("name"), F.col("language"), F.col("marked")))


def tests_of(symbols: DataFrame, calls: DataFrame, files: DataFrame, wanted: str, fuzzy: bool = False) -> DataFrame:
    """(test_name, test_type, path, line, call_line, context): calls of the raw name from tests."""
    hits = calls.filter(name_matches(F.col("call_name"), wanted, fuzzy))
    first = hits.groupBy("path", "line").agg(F.min(F.struct("ordinal", "context")).alias("c")).select("path", "line", "c.ordinal", "c.context")
    at = with_marks(enclosing(first, symbols), files, F.col("enc.sline"))
    is_test = F.col("enc").isNotNull() & X.is_test_symbol(F.col("enc.sname"), F.col("language"), F.col("marked"))
    at = at.filter(X.is_test_file(F.col("path")) | F.coalesce(is_test, F.lit(False)))
    return at.select(F.coalesce("enc.sname", F.lit("<test-file-level>")).alias("test_name"), F.coalesce("enc.stype", F.lit("function")).alias("test_type"), "path", F.coalesce("enc.sline", "line").alias("line"), F.col("line").alias("call_line"), "context")


def tested_names(symbols: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """Names called in test files or in the bodies of test symbols."""
    in_files = calls.filter(X.is_test_file(F.col("path"))).select("call_name")
    bodies = body_calls(test_symbols(symbols, files).filter("is_test").select(*symbols.columns), calls).select("call_name")
    return in_files.unionByName(bodies).distinct()


def untested(symbols: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """(name, symbol_type, path, line, signature) of symbols that no test calls directly."""
    own = test_symbols(symbols, files).filter(~X.is_test_file(F.col("path")) & ~F.col("is_test") & ~F.col("symbol_type").isin(*X.DOCS))
    own = own.filter(~((F.col("language") == "python") & F.col("name").startswith("_")))
    names = tested_names(symbols, calls, files).withColumnRenamed("call_name", "name")
    return own.join(names, "name", "left_anti").select("name", "symbol_type", "path", F.col("line_start").alias("line"), "signature")


def coverage(symbols: DataFrame, untested_rows: DataFrame) -> DataFrame:
    """(total, untested, percent); the total counts all symbols, tests and docs too."""
    return symbols.agg(F.count(F.lit(1)).alias("total")).crossJoin(untested_rows.agg(F.count(F.lit(1)).alias("untested"))).withColumn("percent", F.when(F.col("total") == 0, 100.0).otherwise(100.0 * (F.col("total") - F.col("untested")) / F.col("total")))


def entrypoints(symbols: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """(category, name, symbol_type, path, line, signature) of visible symbols that nothing calls."""
    called = calls.select(F.col("call_name").alias("name")).distinct()
    is_test = X.is_test_symbol(F.col("name"), F.col("language"), F.col("marked"))
    own = definition_lines(symbols, files).filter(~X.is_test_file(F.col("path")) & ~is_test & ~F.col("symbol_type").isin(*X.DOCS))
    seen = own.filter(X.exported_by_definition(F.col("name"), F.col("language"), F.col("definition"))).join(called, "name", "left_anti")
    return seen.select(X.entrypoint_category(F.col("name"), F.col("symbol_type")).alias("category"), "name", "symbol_type", "path", F.col("line_start").alias("line"), "signature")


def by_category(points: DataFrame) -> DataFrame:
    return points.groupBy("category").agg(F.count(F.lit(1)).alias("entrypoints"))


def test_deps(symbols: DataFrame, calls: DataFrame, files: DataFrame, test_file: str) -> DataFrame:
    """(name, symbol_type, path, line, called_from_line): production symbols that a test file calls."""
    first = calls.filter(F.col("path") == test_file).groupBy("call_name").agg(F.min("line").alias("called_from_line"))
    hit = _resolve(first, symbols).filter(F.col("dname").isNotNull() & (F.col("dpath") != test_file) & ~X.is_test_file(F.col("dpath")))
    marked = test_symbols(symbols, files).filter("is_test").select(F.col("path").alias("dpath"), F.col("ordinal").alias("dordinal"))
    hit = hit.join(marked, ["dpath", "dordinal"], "left_anti")
    return hit.select(F.col("call_name").alias("name"), F.col("dtype").alias("symbol_type"), F.col("dpath").alias("path"), F.col("dline").alias("line"), "called_from_line")


def test_reach(symbols: DataFrame, calls: DataFrame, files: DataFrame) -> DataFrame:
    """The same for all test files at once: (test_file, name, symbol_type, path, line, called_from_line)."""
    first = calls.filter(X.is_test_file(F.col("path"))).groupBy(F.col("path").alias("test_file"), "call_name").agg(F.min("line").alias("called_from_line"))
    hit = _resolve(first, symbols).filter(F.col("dname").isNotNull() & (F.col("dpath") != F.col("test_file")) & ~X.is_test_file(F.col("dpath")))
    marked = test_symbols(symbols, files).filter("is_test").select(F.col("path").alias("dpath"), F.col("ordinal").alias("dordinal"))
    hit = hit.join(marked, ["dpath", "dordinal"], "left_anti")
    return hit.select("test_file", F.col("call_name").alias("name"), F.col("dtype").alias("symbol_type"), F.col("dpath").alias("path"), F.col("dline").alias("line"), "called_from_line")


def in_order(points: DataFrame) -> DataFrame:
    """Entry points by category, file and line."""
    rank = F.when(F.col("category") == "main", 0).when(F.col("category") == "api", 1).otherwise(2)
    return points.orderBy(rank, "path", "line")


def impact(symbols: DataFrame, calls: DataFrame, files: DataFrame, wanted: str, exact: bool = False, include_docs: bool = False, limit: int | None = 10) -> dict[str, DataFrame]:
    """target (best match), shortlist (top 5), callers, tests, and totals before the limit."""
    own = symbols if include_docs else symbols.filter(~F.col("symbol_type").isin(*X.DOCS))
    ranked = own.filter(name_matches(F.col("name"), wanted, not exact)).withColumn("score", score(F.col("name"), wanted)).orderBy(F.col("score").desc(), "path", "ordinal")
    best = ranked.first()
    if best is None:
        return {"target": ranked.limit(1), "shortlist": ranked.limit(5)}
    name = best["name"]
    hits = cut(calls.filter(call_matches(F.col("call_name"), F.col("context"), name, False) | (F.col("call_name") == name)))  # all calls are read once
    paths = hits.select(F.col("path").alias("hp")).distinct()
    near = cut(symbols.alias("outside").filter(paths.filter(F.col("hp") == F.col("outside.path").outer()).exists()))
    who = cut(callers(symbols, hits, name, near=near).filter(F.col("caller_name") != name))
    tests = cut(tests_of(near, hits, files, name))
    cap = lambda df: df.orderBy("path", "line").limit(limit) if limit is not None else df
    lone = F.lit(best["symbol_type"] in ("function", "method"))
    totals = who.agg(F.count(F.lit(1)).alias("callers")).crossJoin(tests.agg(F.count(F.lit(1)).alias("tests"))).withColumn("is_untested", lone & (F.col("tests") == 0))
    return {"best": name, "target": ranked.limit(1), "shortlist": ranked.limit(5), "callers": cap(who), "tests": cap(tests), "totals": totals}


def trace(symbols: DataFrame, calls: DataFrame, source: str, target: str, fuzzy: bool = False, depth: int = DEPTH) -> DataFrame:
    """(step, name, symbol_type, path, line): a shortest call path, by breadth-first search.

    Each level looks up the calls inside the frontier's symbols and the definitions of their names,
    so the graph itself is never shuffled; a frontier is broadcast if it is small. Each is cut into
    the shared folder; only whether it met the target comes to the driver. Ties go to the smaller
    rank of the caller, then to the earlier call. Paths have at most depth + 1 steps.
    """
    spark = symbols.sparkSession
    schema = "step int, name string, symbol_type string, path string, line int"
    own = symbols.select("path", "ordinal", "name", "symbol_type", "signature", "line_start", "line_end")
    goals = side(cut(symbols.filter(name_matches(F.col("name"), target, fuzzy)).select(F.lower("name").alias("goal")).distinct()))
    here = cut(own.filter(name_matches(F.col("name"), source, fuzzy)))
    first = F.struct(F.col("name"), F.col("symbol_type"), F.col("path"), F.col("line_start").alias("line"))
    front = cut(here.select(F.array(F.col("path"), F.lpad(F.col("ordinal").cast("string"), 10, "0")).alias("rank"), first.alias("at"), F.array(first).alias("steps")))
    seen = cut(front.select(F.concat_ws(":", "at.path", F.lower("at.name")).alias("key")).distinct())
    for _ in range(depth):
        spans = cut(here.join(front.select("at.name", "at.path", F.col("at.line").alias("line_start")).distinct(), ["name", "path", "line_start"], "left_semi"))
        inside = body_calls(spans, calls, small(spans))
        each = cut(inside.groupBy("path", "sname", "sline", "call_name").agg(F.min("ordinal").alias("call_ordinal")))
        here = cut(own.join(side(cut(each.select(F.col("call_name").alias("name")).distinct())), "name", "left_semi"))
        r = _resolve(each, here)
        known = F.col("dname").isNotNull()
        node = F.struct(F.col("call_name").alias("name"), F.when(known, F.col("dtype")).otherwise("function").alias("symbol_type"), F.when(known, F.col("dpath")).otherwise("<external>").alias("path"), F.when(known, F.col("dline")).otherwise(F.lit(0)).cast("int").alias("line"))
        edges = r.select(F.col("sname").alias("fname"), F.col("path").alias("fpath"), F.col("sline").alias("fline"), "call_ordinal", node.alias("to"))
        nxt = front.join(edges, (F.col("at.name") == F.col("fname")) & (F.col("at.path") == F.col("fpath")) & (F.col("at.line") == F.col("fline")))
        nxt = cut(nxt.select(F.concat("rank", F.array(F.lpad(F.col("call_ordinal").cast("string"), 10, "0"))).alias("rank"), F.col("to").alias("at"), F.concat("steps", F.array("to")).alias("steps")))
        met = nxt.join(goals, F.lower("at.name") == F.col("goal"), "left_semi").orderBy("rank", "steps").limit(1).collect()
        if met:
            return spark.createDataFrame([(i + 1, *s) for i, s in enumerate(met[0]["steps"])], schema)
        key = F.concat_ws(":", "at.path", F.lower("at.name"))
        one = nxt.withColumn("key", key).join(seen, "key", "left_anti").groupBy("key").agg(F.min(F.struct("rank", "at", "steps")).alias("n"))
        front = cut(one.select("key", "n.rank", "n.at", "n.steps"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front.select("key")))
        front = front.drop("key")
    return spark.createDataFrame([], schema)
