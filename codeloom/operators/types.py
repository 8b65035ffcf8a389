"""Types of parameters and results, resolved to their definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import signatures as S
from codeloom.functions import text as X
from codeloom.operators.search import name_matches
from codeloom.session import cut, side


def signature_types(symbols: DataFrame) -> DataFrame:
    """symbols with params (array<struct<name,type>>) and return_type."""
    lang, sig = X.language(F.col("path")), F.coalesce("signature", F.lit(""))
    return symbols.withColumn("params", S.parameters(lang, sig)).withColumn("return_type", S.return_type(lang, sig))


def resolve_types(named: DataFrame, symbols: DataFrame, column: str = "type") -> DataFrame:
    """named with def_path and def_line: the first base type that is a class or enum; exact names
    before names that differ in case, then the order of the base types.

    Each distinct type is resolved once, so that few names with many uses make no large partitions.
    """
    own = symbols.filter(F.col("symbol_type").isin("class", "enum"))
    exact = own.groupBy("name").agg(F.min(F.struct("path", "ordinal", "line_start")).alias("d")).select(F.col("name").alias("en"), F.col("d").alias("ed"))
    loose = own.groupBy(F.lower("name").alias("ln")).agg(F.min(F.struct("path", "ordinal", "line_start")).alias("ld"))
    b = named.select(F.col(column).alias("rt")).filter("rt is not null").distinct().select("rt", F.posexplode(S.base_types(F.col("rt"))).alias("pos", "base"))
    met = b.join(exact, F.col("base") == F.col("en"), "left").join(loose, F.lower("base") == F.col("ln"), "left")
    d = F.coalesce("ed", "ld")
    best = F.min(F.when(d.isNotNull(), F.struct("pos", F.when(F.col("ed").isNotNull(), 0).otherwise(1).alias("tier"), d.alias("d"))))
    r = met.groupBy("rt").agg(best.alias("r")).filter("r is not null").select("rt", F.col("r.d.path").alias("def_path"), F.col("r.d.line_start").alias("def_line"))
    return named.join(side(cut(r)), F.col(column) == F.col("rt"), "left").drop("rt")


def types_of(symbols: DataFrame, wanted: str, fuzzy: bool = False) -> DataFrame:
    """A row for each parameter and result: (name, symbol_type, path, line, kind, position, param,
    type, def_path, def_line)."""
    own = symbols.filter(name_matches(F.col("name"), wanted, fuzzy) & ~F.col("symbol_type").isin(*X.DOCS))
    t = signature_types(own)
    none = F.lit(None).cast("string")
    rows = F.concat(F.transform("params", lambda p, i: F.struct(F.lit("param").alias("kind"), i.alias("position"), p["name"].alias("param"), p["type"].alias("type"))), F.when(F.col("return_type").isNotNull(), F.array(F.struct(F.lit("return").alias("kind"), F.size("params").alias("position"), none.alias("param"), F.col("return_type").alias("type")))).otherwise(F.array().cast("array<struct<kind:string,position:int,param:string,type:string>>")))
    flat = t.select("name", "symbol_type", "path", F.col("line_start").alias("line"), F.inline(rows))
    return resolve_types(flat, symbols)


def classes(symbols: DataFrame) -> DataFrame:
    """Classes and enums; interfaces have no schema."""
    return symbols.filter(F.col("symbol_type").isin("class", "enum"))


def total_fields(schemas: DataFrame) -> DataFrame:
    return schemas.agg(F.coalesce(F.sum(F.size("fields")), F.lit(0)).cast("long").alias("fields"))


def schema_of(symbols: DataFrame, fields: DataFrame, wanted: str, fuzzy: bool = False) -> DataFrame:
    """(name, symbol_type, path, line, language, fields[]) of classes and enums."""
    own = classes(symbols).filter(name_matches(F.col("name"), wanted, fuzzy))
    listed = fields.groupBy("path", F.col("symbol_ordinal").alias("ordinal")).agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal").alias("position"), F.col("name").alias("field"), F.col("type"), F.col("optional"), F.col("default_value")))).alias("fields"))
    out = own.join(listed, ["path", "ordinal"], "left")
    none = F.array().cast("array<struct<position:int,field:string,type:string,optional:boolean,default_value:string>>")
    return out.select("name", "symbol_type", "path", F.col("line_start").alias("line"), X.language(F.col("path")).alias("language"), F.coalesce("fields", none).alias("fields"))
