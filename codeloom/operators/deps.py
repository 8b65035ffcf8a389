"""Imports, reverse imports and uses of a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.relations import bucket_of, bucketed


def imports_of(imports: DataFrame, path: str) -> DataFrame:
    return imports.filter(F.col("path") == path).select("import_name", "from_module", "ordinal").orderBy("ordinal")


def imported_by(imports: DataFrame, path: str) -> DataFrame:
    """Files with an import that holds the target's file name with its extension; one row a file."""
    return imports.filter(F.col("import_name").contains(path.rsplit("/", 1)[-1])).select("path").distinct()


def uses_of(lines: DataFrame, symbols: DataFrame, name: str) -> DataFrame:
    """Lines that hold the name outside its definitions in the same file; none if it isn't defined."""
    own = symbols.filter(F.col("name") == name).select(F.col("path").alias("dp"), "line_start", "line_end")
    defined = own.limit(1).select(F.lit(1).alias("one"))
    spans = bucketed(own, "line_start", "line_end", "sb")
    hits = lines.filter(F.col("text").contains(name))
    away = hits.join(spans, (F.col("path") == F.col("dp")) & (bucket_of("line") == F.col("sb")) & F.col("line").between(F.col("line_start"), F.col("line_end")), "left_anti")
    return away.crossJoin(F.broadcast(defined)).drop("one")  # one row or none
