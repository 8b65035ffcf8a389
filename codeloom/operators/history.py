"""When a symbol last changed, and its versions, over the commits of its file.

``states``: (path, seq, ..., present, signature, line_start, line_end), seq 0 the newest commit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COMMITS = 100


def symbol_states(commits: DataFrame, symbols_at: DataFrame, name: str) -> DataFrame:
    """One row a commit: the first symbol of that name in its file at that commit, if any.

    ``symbols_at``: symbols with commit hash.
    """
    first = symbols_at.filter(F.col("name") == name).groupBy("path", "hash").agg(F.min(F.struct("ordinal", "symbol_type", "signature", "line_start", "line_end")).alias("s"))
    at = commits.join(first, ["path", "hash"], "left")
    return at.select(*commits.columns, F.col("s").isNotNull().alias("present"), "s.symbol_type", "s.signature", "s.line_start", "s.line_end")


def blame(states: DataFrame, limit: int = COMMITS) -> DataFrame:
    """A row for each path: the newest commit that changed the symbol, with both signatures.

    A commit changes it if the next older one lacks it or has another signature or length. With no
    such commit among the newest ``limit``, the newest commit is named.
    """
    w = Window.partitionBy("path").orderBy("seq")
    size = F.col("line_end") - F.col("line_start")
    s = states.filter(F.col("seq") < limit).withColumn("size", size)
    for c in ("present", "signature", "size"):
        s = s.withColumn(f"older_{c}", F.lead(c).over(w))
    s = s.withColumn("last", F.lead("seq").over(w).isNull())
    differs = ~F.col("last") & F.col("present") & (~F.coalesce("older_present", F.lit(False)) | ~F.col("signature").eqNullSafe(F.col("older_signature")) | (F.col("size") != F.col("older_size")))
    rank = F.when(differs, F.col("seq")).otherwise(F.col("seq") + 1_000_000_000)
    best = s.groupBy("path").agg(F.min_by(F.struct("seq", "hash", F.when(differs, F.col("older_signature")).alias("old_signature"), F.col("signature").alias("new_signature"), "line_start", "line_end"), F.when(differs | (F.col("seq") == 0), rank)).alias("b"))
    return best.select("path", "b.*")


def history(states: DataFrame) -> DataFrame:
    """(path, version, seq, hash, existed, signature, line_start, line_end) of every change.

    Oldest first a version is recorded when the symbol appears, or its signature or length changes; when it
    vanishes, only if its last signature was not null (then the remembered length stays). Versions
    count down from the newest.
    """
    w = Window.partitionBy("path").orderBy(F.col("seq").desc())
    upto = w.rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("line_end") - F.col("line_start")
    s = states.withColumn("size", F.when(F.col("present"), size))
    # a vanished symbol with a signature is forgotten; one without keeps its remembered state
    live = F.struct(F.col("present").alias("p"), F.col("signature").alias("g"), F.col("size").alias("z"))
    s = s.withColumn("prev", F.last(F.when(F.col("present"), live), ignorenulls=True).over(upto))
    s = s.withColumn("was", F.lag("present").over(w))
    forgot = (~F.coalesce("was", F.lit(True))) & F.col("prev.g").isNotNull()
    first = F.col("prev").isNull() | forgot
    shown = F.col("present") & (first | ~F.col("signature").eqNullSafe(F.col("prev.g")) | (F.col("size") != F.col("prev.z")))
    gone = ~F.col("present") & F.coalesce("was", F.lit(False)) & F.col("prev.g").isNotNull()
    kept = s.filter(shown | gone)
    v = Window.partitionBy("path").orderBy("seq")
    n = Window.partitionBy("path")
    version = F.count(F.lit(1)).over(n) - F.row_number().over(v) + 1
    return kept.select("path", version.cast("int").alias("version"), "seq", "hash", F.col("present").alias("existed"), "signature", "line_start", "line_end")
