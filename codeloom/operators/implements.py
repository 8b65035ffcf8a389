"""Implementations of an interface, found line by line with built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X

_OUT = ("implementor", "interface", "kind", "language", "path", "line")


def _matches(name: Column, wanted: str, fuzzy: bool) -> Column:
    return (name == wanted) | F.lower(name).contains(wanted.lower()) if fuzzy else name == wanted


def _parents(text: Column, strip: str) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda p: F.trim(F.regexp_extract(p, strip, 1))), lambda p: p != "")


def _list(lines: DataFrame, pattern: str, lang: tuple[str, ...], kind: str, strip: str, last_part: bool = False) -> DataFrame:
    t = F.trim("text")
    hit = lines.filter(F.col("language").isin(*lang) & t.rlike(pattern))
    ps = _parents(F.regexp_extract(t, pattern, 2), strip)
    ps = F.transform(ps, lambda p: F.element_at(F.split(p, r"\."), -1)) if last_part else ps
    return hit.select(F.regexp_extract(t, pattern, 1).alias("implementor"), F.explode(ps).alias("interface"), F.lit(kind).alias("kind"), "language", "path", "line")


def implementations(lines: DataFrame) -> DataFrame:
    """All (implementor, interface, kind, language, path, line) of ``lines(path, line, text)``."""
    ls = lines.withColumn("language", X.language(F.col("path")))
    t = F.trim("text")
    rust_for = r"(?U)impl\s+(?:<[^>]*>\s*)?(\w+)(?:<[^>]*>)?\s+for\s+(\w+)"
    rust_own = r"(?U)impl\s+(?:<[^>]*>\s*)?(\w+)(?:<[^>]*>)?\s*\{"
    rust = ls.filter((F.col("language") == "rust") & t.rlike(rust_for)).select(F.regexp_extract(t, rust_for, 2).alias("implementor"), F.regexp_extract(t, rust_for, 1).alias("interface"), F.lit("impl").alias("kind"), "language", "path", "line")
    own = ls.filter((F.col("language") == "rust") & t.rlike(rust_own) & ~t.contains(" for ")).select(F.regexp_extract(t, rust_own, 1).alias("implementor"), F.regexp_extract(t, rust_own, 1).alias("interface"), F.lit("impl").alias("kind"), "language", "path", "line")
    python = _list(ls, r"(?U)class\s+(\w+)\s*\(([^)]+)\)\s*:", ("python",), "inherits", r"^([^\[]*)", True)
    oo = ("javascript", "typescript", "java")
    impl = _list(ls, r"(?U)class\s+(\w+)(?:<[^>]*>)?(?:\s+extends\s+\w+(?:<[^>]*>)?)?\s+implements\s+([^{]+)", oo, "implements", r"^([^<]*)")
    ext = _list(ls, r"(?U)class\s+(\w+)(?:<[^>]*>)?\s+extends\s+(\w+)", oo, "extends", r"^(.*)$")
    iface = _list(ls, r"(?U)interface\s+(\w+)(?:<[^>]*>)?\s+extends\s+([^{]+)", ("java",), "extends", r"^([^<]*)")
    out = rust
    for x in (own, python, impl, ext, iface, go_embeds(ls)):
        out = out.unionByName(x.select(*_OUT))
    return out


def go_embeds(ls: DataFrame) -> DataFrame:
    """Go: the first word of each line inside a struct's braces, reported at the struct's line.

    A struct line opens at depth 1 and its own text isn't read further; the struct lasts until its
    braces balance. Running sums over the lines of a file.
    """
    go = ls.filter(F.col("language") == "go")
    pattern = r"(?U)type\s+(\w+)\s+struct\s*\{"
    t = F.trim("text")
    start = t.rlike(pattern)
    w = Window.partitionBy("path").orderBy("line")
    go = go.withColumn("start", start).withColumn("group", F.sum(start.cast("int")).over(w))
    inner = Window.partitionBy("path", "group").orderBy("line")
    net = F.regexp_count("text", F.lit(r"\{")) - F.regexp_count("text", F.lit(r"\}"))
    go = go.filter("group > 0").withColumn("depth", F.sum(F.when(F.col("start"), 1).otherwise(net)).over(inner))
    go = go.withColumn("least", F.min("depth").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    go = go.withColumn("implementor", F.first(F.when(F.col("start"), F.regexp_extract(t, pattern, 1)), True).over(inner)).withColumn("at", F.first("line").over(inner))
    word = F.regexp_extract(t, r"^(\S+)", 1)
    return go.filter(~F.col("start") & (F.col("least") > 0) & (word != "") & (word != "}")).select("implementor", word.alias("interface"), F.lit("implements").alias("kind"), "language", "path", F.col("at").alias("line"))


def implements(lines: DataFrame, wanted: str, fuzzy: bool = False, trait_only: bool = False) -> DataFrame:
    """Rust rows match on either name, others on the interface; ordered by path and line."""
    rows = implementations(lines)
    hit = _matches(F.col("interface"), wanted, fuzzy) | ((F.col("language") == "rust") & _matches(F.col("implementor"), wanted, fuzzy))
    rows = rows.filter(hit)
    if trait_only:
        rows = rows.filter(F.col("implementor") != F.col("interface"))
    return rows.orderBy("path", "line")
