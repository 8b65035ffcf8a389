"""Differences between two states of the symbols, snapshots included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = {"added": 0, "deleted": 1, "modified": 2, "signature_changed": 3}
SHORT = {"added": "+", "deleted": "-", "modified": "~", "signature_changed": "!"}


def _span(prefix: str) -> Column:
    given = F.col(f"{prefix}_start").isNotNull()
    return F.when(given, F.struct(F.col(f"{prefix}_start").alias("start"), F.col(f"{prefix}_end").alias("end")))


def compare_symbols(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("path", "name", "symbol_type")) -> DataFrame:
    """(change_type, keys, old_lines, new_lines, old_signature, new_signature).

    New rows meet the *last* old row of their key (duplicates in the new state keep their own
    rows); old keys that the new state lacks are deleted, duplicates included. A changed
    signature wins over moved lines; equal spans and signatures are no change.
    """
    rest = F.struct("ordinal", F.col("line_start").alias("old_start"), F.col("line_end").alias("old_end"), F.col("signature").alias("old_signature"))
    last = old.groupBy(*keys).agg(F.max(rest).alias("o")).select(*keys, F.lit(True).alias("was"), "o.old_start", "o.old_end", "o.old_signature")
    met = new.select(*keys, F.col("line_start").alias("new_start"), F.col("line_end").alias("new_end"), F.col("signature").alias("new_signature")).join(last, list(keys), "left")
    same = F.col("new_signature").eqNullSafe(F.col("old_signature"))
    moved = (F.col("new_start") != F.col("old_start")) | (F.col("new_end") != F.col("old_end"))
    kind = F.when(F.col("was").isNull(), "added").when(~same, "signature_changed").when(moved, "modified")
    changed = met.withColumn("change_type", kind).filter(F.col("change_type").isNotNull())
    gone = old.select(*keys, F.col("line_start").alias("old_start"), F.col("line_end").alias("old_end"), F.col("signature").alias("old_signature")).join(new.select(*keys).distinct(), list(keys), "left_anti")
    none = lambda k: F.lit(None).cast(k)
    gone = gone.withColumns({"change_type": F.lit("deleted"), "new_start": none("int"), "new_end": none("int"), "new_signature": none("string")})
    rows = changed.select(*keys, "change_type", "old_start", "old_end", "new_start", "new_end", "old_signature", "new_signature").unionByName(gone)
    return rows.select("change_type", *keys, _span("old").alias("old_lines"), _span("new").alias("new_lines"), "old_signature", "new_signature")


def diff(old: DataFrame, new: DataFrame, full: bool = False) -> DataFrame:
    out = compare_symbols(old, new)
    return out if full else out.filter(F.col("name") != "anonymous")


def breaking(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("change_type").isin("deleted", "signature_changed"))


def by_type(changes: DataFrame) -> DataFrame:
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("changes"), F.count_distinct("path").alias("files"))
