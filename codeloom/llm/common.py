"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import cut

#: A side is broadcast only up to this many bytes, counted, not estimated; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df_or_names, *bases: str) -> list[str]:
    """Column names derived from ``bases`` that clash with no column (case-insensitively)."""
    names = df_or_names.columns if isinstance(df_or_names, DataFrame) else df_or_names
    taken, out = {c.lower() for c in names}, []
    for base in bases:
        name, k = f"_{base}", 0
        while name.lower() in taken:
            k += 1
            name = f"_{base}{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def ref(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return orderable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(orderable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.NullType))


def counted_bytes(df: DataFrame) -> int:
    """Bytes of the rows of ``df``: 16 a column and row, and the length of every string and binary value, of any nesting."""
    size: Column = F.lit(16 * max(1, len(df.columns)))
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(ref(f.name)), F.lit(0))
        elif isinstance(f.dataType, (T.ArrayType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(F.struct(ref(f.name)))), F.lit(0))
    return int(df.agg(F.sum(size.cast("long"))).first()[0] or 0)


def small_side(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its counted bytes are within the limit, else for a merge join."""
    return F.broadcast(df) if counted_bytes(df) <= (BROADCAST_BYTES if limit is None else limit) else df.hint("merge")


def join_checked(big: DataFrame, small: DataFrame, on: str | list[str] | Column, how: str, limit: int | None = None) -> DataFrame:
    """Join with a side that is small only if its counted bytes say so.

    ``small`` must be cheap to read again (checkpointed, or made of rows of the driver). Up to ``limit``
    bytes it is broadcast; beyond, both sides are shuffled on the key. The rows are the same either way.
    """
    return big.join(small_side(small, limit), on, how)


def words(text: Column) -> Column:
    """Array of the runs of characters other than white space; empty for null."""
    return F.coalesce(F.filter(F.split(text, r"\s+"), lambda w: w != ""), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """Number of runs of characters other than white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


__all__ = ["BROADCAST_BYTES", "counted_bytes", "cut", "fresh", "join_checked", "small_side", "n_words", "orderable", "ref", "table", "words"]
