"""Symbol search and listings: query, inspect, map, stats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as X

REPORTED = ("function", "class", "method", "enum", "static", "heading", "code_block")


def name_matches(name: Column, wanted: str, fuzzy: bool) -> Column:
    return F.lower(name).contains(wanted.lower()) if fuzzy else name == wanted


def score(name: Column, wanted: str) -> Column:
    """100 equal, 50 prefix, else minus the edit distance, which for a contained pattern is the
    difference of the lengths."""
    low = F.lower(name)
    return F.when(low == wanted.lower(), 100).when(low.startswith(wanted.lower()), 50).otherwise(F.lit(len(wanted)) - F.char_length(low)).cast("int")


def exact_search(symbols: DataFrame, wanted: str) -> DataFrame:
    return symbols.filter(F.col("name") == wanted)


def fuzzy_search(symbols: DataFrame, wanted: str) -> DataFrame:
    """Case-insensitive containment, best first."""
    return symbols.filter(name_matches(F.col("name"), wanted, True)).withColumn("score", score(F.col("name"), wanted)).orderBy(F.col("score").desc(), "path", "ordinal")


def query(symbols: DataFrame, wanted: str, exact: bool = False, symbol_type: str | None = None, full: bool = False, exports_only: bool = False, limit: int | None = None) -> DataFrame:
    """Lookup, then type, then anonymous, then exports, then limit. A plural such as 'functions'
    lists all symbols of that type. An unknown type gives no rows."""
    if wanted.lower() in X.PLURALS and symbol_type is None:
        out = symbols.filter(F.col("symbol_type") == X.PLURALS[wanted.lower()]).withColumn("score", F.lit(100))
    elif exact:
        out = exact_search(symbols, wanted).withColumn("score", F.lit(100))
    else:
        out = symbols.filter(name_matches(F.col("name"), wanted, True)).withColumn("score", score(F.col("name"), wanted))
    if symbol_type is not None:
        out = out.filter(F.col("symbol_type") == X.SINGULAR.get(symbol_type.lower(), ""))
    if not full:
        out = out.filter(F.col("name") != "anonymous")
    if exports_only:
        out = out.filter("is_exported")
    out = out.orderBy(F.col("score").desc(), "path", "ordinal")
    return out.limit(limit) if limit is not None else out


def candidate_files(files: DataFrame, wanted: str, fuzzy: bool = True) -> DataFrame:
    """Fast mode: the files whose text holds the name, before any parsing; binary files are left out.

    The predicate is built in, so it is evaluated next to the scan and only candidates reach the
    parsers. Extracting from these and filtering by name gives the rows of the full scan.
    """
    c = F.col("content")
    has = F.lower(c).contains(wanted.lower()) if fuzzy else c.contains(wanted)
    return files.filter(has & ~c.contains("\0"))


def total(rows: DataFrame, section: str) -> DataFrame:
    """(section, total): how many rows there are before any limit."""
    return rows.agg(F.count(F.lit(1)).alias("total")).select(F.lit(section).alias("section"), "total")


def inspect(symbols: DataFrame, path: str, full: bool = False, exports_only: bool = False, files: DataFrame | None = None) -> DataFrame:
    """Symbols of one file, in order; with ``files``, an error for a file that isn't there or has no known language."""
    if files is not None:
        known = files.filter(F.col("path") == path).select("language").first()
        if known is None or known[0] == "unknown":
            raise ValueError(f"no file {path}" if known is None else f"{path}: unknown language")
    out = symbols.filter(F.col("path") == path)
    if not full:
        out = out.filter(F.col("name") != "anonymous")
    if exports_only:
        out = out.filter("is_exported")
    return out.orderBy("ordinal")


def with_bodies(symbols: DataFrame, files: DataFrame, cap: int | None = 50) -> DataFrame:
    """body text of each symbol; null for bodies longer than ``cap`` lines.

    A content moves and is split once, below the join, however many symbols it has. Symbols meet
    its lines as rows, so that of their columns only those asked for are computed and moved.
    """
    split = files.select("path", X.lines(F.col("content")).alias("ls"))
    body = X.span_text(F.col("ls"), F.col("line_start"), F.col("line_end"))
    body = body if cap is None else F.when(F.col("line_end") - F.col("line_start") + 1 <= cap, body)
    out = symbols.join(split, "path", "left").select(*symbols.columns, body.alias("body"))
    return out.orderBy(F.col("score").desc(), "path", "ordinal") if "score" in symbols.columns else out


def files_by_language(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count(F.lit(1)).alias("files"))


def symbols_by_type(symbols: DataFrame) -> DataFrame:
    """Counts of the seven reported types, 0 where there is none; in one aggregate, no join."""
    sums = symbols.agg(*(F.count_if(F.col("symbol_type") == t).alias(t) for t in REPORTED))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(t).alias("symbol_type"), F.col(t).alias("symbols")) for t in REPORTED))).alias("r")).select("r.*")


def totals(files: DataFrame, symbols: DataFrame) -> DataFrame:
    f = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    s = symbols.agg(F.count(F.lit(1)).alias("symbols"))
    return f.crossJoin(s)  # one row each


def stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(metric, key, value) rows of languages, types and totals."""
    one = lambda df, m, k, v: df.select(F.lit(m).alias("metric"), k.alias("key"), v.cast("long").alias("value"))
    t = totals(files, symbols)
    total = t.select(F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("long").alias("value")) for k in ("files", "symbols", "bytes")))).alias("r"))
    return one(files_by_language(files), "language", F.col("language"), F.col("files")).unionByName(one(symbols_by_type(symbols), "type", F.col("symbol_type"), F.col("symbols"))).unionByName(total.select(F.lit("total").alias("metric"), "r.key", "r.value"))


def symbols_per_file(files: DataFrame, symbols: DataFrame) -> DataFrame:
    n = symbols.groupBy("path").agg(F.count(F.lit(1)).alias("symbol_count"))
    return files.select("path", "language", "size").join(n, "path", "left").fillna(0, ["symbol_count"])


def file_map(files: DataFrame, symbols: DataFrame, level: int = 1) -> DataFrame:
    """Level 1: stats; 2: files with symbol counts; 3: with the symbols of each."""
    if level == 1:
        return stats(files, symbols)
    if level == 2:
        return symbols_per_file(files, symbols)
    listed = symbols.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("ordinal", "name", "symbol_type", "line_start", "line_end"))).alias("symbols"))
    return symbols_per_file(files, symbols).join(listed, "path", "left")
