"""Canonical relations and helpers that every operator builds on.

files    (path, language, size, hash, content)
symbols  (path, ordinal, name, symbol_type, signature, docstring, line_start, line_end, parent_ordinal, is_exported)
imports  (path, ordinal, import_name, from_module)
calls    (path, ordinal, call_name, line, context)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import text as X

FILES = "path string, language string, size long, hash string, content string"
SYMBOLS = "path string, ordinal int, name string, symbol_type string, signature string, docstring string, line_start int, line_end int, parent_ordinal int, is_exported boolean"
IMPORTS = "path string, ordinal int, import_name string, from_module string"
CALLS = "path string, ordinal int, call_name string, line int, context string"
FIELDS = "path string, symbol_ordinal int, ordinal int, name string, type string, optional boolean, default_value string"


def with_facts(content: DataFrame) -> DataFrame:
    """files from (path, content): language, byte size and hash; unknown languages stay."""
    return content.select("path", X.language(F.col("path")).alias("language"), F.octet_length("content").cast("long").alias("size"), X.content_hash(F.col("content")).alias("hash"), "content")


def file_lines(files: DataFrame) -> DataFrame:
    """(path, line, text), 1-based."""
    return files.select("path", F.posexplode(X.lines(F.col("content"))).alias("line", "text")).withColumn("line", (F.col("line") + 1).cast("int"))


def first_definitions(symbols: DataFrame) -> DataFrame:
    """One symbol a name: the first by path and ordinal. A map-side combined minimum, no window."""
    rest = [c for c in symbols.columns if c not in ("name", "path", "ordinal")]
    return symbols.groupBy("name").agg(F.min(F.struct("path", "ordinal", *rest)).alias("d")).select("name", "d.*")


#: Lines to a bucket of the range joins.
BUCKET = 32


def bucketed(spans: DataFrame, start: str, end: str, bucket: str = "bucket") -> DataFrame:
    """A row for each bucket of lines that a span touches.

    Range joins meet on (path, bucket), so a file with a hundred thousand symbols is no cross product.
    """
    return spans.withColumn(bucket, F.explode(F.sequence(F.expr(f"{start} div {BUCKET}"), F.expr(f"greatest({start}, {end}) div {BUCKET}"))))


def bucket_of(line: str | Column) -> Column:
    return F.call_function("div", F.col(line) if isinstance(line, str) else line, F.lit(BUCKET))


def stretches(symbols: DataFrame) -> DataFrame:
    """(sp, since, until, enc): lines of a file in stretches that don't overlap, each with the
    narrowest symbol around it. Symbols meet only the lines where one begins or has just ended."""
    s = symbols.select(F.col("path").alias("sp"), F.col("line_start").alias("s0"), F.col("line_end").alias("s1"), F.struct((F.col("line_end") - F.col("line_start")).alias("span"), F.col("ordinal").alias("sordinal"), F.col("name").alias("sname"), F.col("symbol_type").alias("stype"), F.col("line_start").alias("sline"), F.col("line_end").alias("send")).alias("s"))
    edges = s.select(F.col("sp").alias("ep"), F.explode(F.array("s0", F.col("s1") + 1)).alias("since")).filter("since is not null").distinct()
    met = edges.join(bucketed(s, "s0", "s1", "sb"), (F.col("ep") == F.col("sp")) & (bucket_of("since") == F.col("sb")) & F.col("since").between(F.col("s0"), F.col("s1")), "left")
    each = met.groupBy(F.col("ep").alias("sp"), "since").agg(F.min("s").alias("enc"))
    until = F.lead("since").over(Window.partitionBy("sp").orderBy("since")) - 1
    return each.withColumn("until", until).filter("enc is not null").select("sp", "since", "until", "enc")


def enclosing(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """calls with enc: the narrowest symbol around each (sname, stype, sline, ...), or null.

    Equal widths go to the lower ordinal. One equi-join on (path, bucket of lines) with a range
    condition. A line is in one stretch at most, so calls are shuffled once and neither sorted nor
    grouped, and the hashed side has at most a bucket's lines to a key.
    """
    s = bucketed(stretches(symbols), "since", "until", "sb").hint("shuffle_hash")
    hit = calls.join(s, (F.col("path") == F.col("sp")) & (bucket_of("line") == F.col("sb")) & F.col("line").between(F.col("since"), F.col("until")), "left")
    return hit.select(*calls.columns, "enc")
