"""Keeping an index: manifest validation, incremental merge, snapshots, consistency."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FULL_AT_LEAST = 100
SNAPSHOT = ("name", "symbol_type", "signature", "path", "line_start", "line_end")


def cache_key(root: str, extensions: list[str]) -> str:
    return hashlib.sha256(":".join([root, *extensions]).encode()).hexdigest()[:16]


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, kind): added, deleted or modified of manifests (path, hash, size, mtime).

    A file with other size or time but the same hash is no change.
    """
    o = old.select("path", F.col("hash").alias("oh"), F.col("size").alias("os"), F.col("mtime").alias("ot"))
    n = new.select("path", F.col("hash").alias("nh"), F.col("size").alias("ns"), F.col("mtime").alias("nt"))
    both = o.join(n, "path", "full_outer")
    touched = (F.col("os") != F.col("ns")) | ~F.col("ot").eqNullSafe(F.col("nt"))
    kind = F.when(F.col("oh").isNull(), "added").when(F.col("nh").isNull(), "deleted").when(touched & (F.col("oh") != F.col("nh")), "modified")
    return both.select("path", kind.alias("kind")).filter(F.col("kind").isNotNull())


def touched(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new(path, size, mtime)`` with state: new, touched (other size or time) or same; only the first two need hashing."""
    o = old.select("path", F.col("size").alias("os"), F.col("mtime").alias("ot"), F.lit(True).alias("was"))
    other = (F.col("size") != F.col("os")) | ~F.col("mtime").eqNullSafe(F.col("ot"))
    state = F.when(F.col("was").isNull(), "new").when(other, "touched").otherwise("same")
    return new.join(o, "path", "left").withColumn("state", state).drop("os", "ot", "was")


def counts(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(files, symbols) of an index, as its manifest states them."""
    return files.agg(F.count(F.lit(1)).alias("files")).crossJoin(symbols.agg(F.count(F.lit(1)).alias("symbols")))  # one row each


def needs_full_rebuild(changed: int, files: int) -> bool:
    """More than a tenth of the files (of 1000 at least), or more than 100."""
    return changed > max(files, 1000) // 10 or changed > FULL_AT_LEAST


def merge(old: DataFrame, fresh: DataFrame, changes: DataFrame) -> DataFrame:
    """Rows of unchanged files kept, those of changed files replaced by ``fresh``."""
    return old.join(changes.select("path").distinct(), "path", "left_anti").select(*old.columns).unionByName(fresh.select(*old.columns))


def inconsistent(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Paths in only one of the two, or without a hash; a written index must have none."""
    only = manifest.select("path").join(files.select("path"), "path", "left_anti").unionByName(files.select("path").join(manifest.select("path"), "path", "left_anti"))
    return only.unionByName(manifest.filter(F.coalesce("hash", F.lit("")) == "").select("path")).distinct()


#: Layout of a saved index; one of another version isn't loaded.
VERSION = 2


def _generations(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete generations: those whose manifest, written last, is there."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(folder)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(base)] if fs.exists(base) else []
    own = [int(n.rsplit("-", 1)[1]) for n in names if n.startswith(f"v{VERSION}-") and n.rsplit("-", 1)[1].isdigit()]
    return sorted(n for n in own if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/v{VERSION}-{n}/manifest/_SUCCESS")))


def save_index(tables: dict[str, DataFrame], folder: str, manifest: DataFrame) -> None:
    """A new generation beside the last one, which may be what ``tables`` read; the one before that is dropped."""
    spark = manifest.sparkSession
    done = _generations(spark, folder)
    to = f"{folder}/v{VERSION}-{done[-1] + 1 if done else 0}"
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{to}/{name}")
    odd = inconsistent(manifest, spark.read.parquet(f"{to}/files")).limit(5).collect()
    if odd:
        raise ValueError(f"manifest and files differ: {', '.join(r['path'] for r in odd)}")
    manifest.write.mode("overwrite").parquet(f"{to}/manifest")
    jvm = spark.sparkContext._jvm
    for n in done[:-1]:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/v{VERSION}-{n}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def load_index(spark: SparkSession, folder: str, names: tuple[str, ...] = ("files", "symbols", "imports", "calls", "fields")) -> dict[str, DataFrame]:
    done = _generations(spark, folder)
    if not done:
        raise ValueError(f"no index in {folder}")
    return {n: spark.read.parquet(f"{folder}/v{VERSION}-{done[-1]}/{n}") for n in names}


def load_manifest(spark: SparkSession, folder: str) -> DataFrame | None:
    """(path, size, mtime, hash) of the saved index; None where there is none of this version."""
    return load_index(spark, folder, ("manifest",))["manifest"] if _generations(spark, folder) else None


def save_snapshot(symbols: DataFrame, folder: str, name: str = "unnamed", commit: str | None = None, files: DataFrame | None = None) -> None:
    """One partition a name, replaced alone; symbols without a name are left out. Beside it, the commit and the numbers of files and symbols."""
    rows = symbols.filter(F.col("name") != "").select(*SNAPSHOT).withColumn("snapshot", F.lit(name))
    write = lambda df, to: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot").parquet(to)
    write(rows, f"{folder}/symbols")
    n = (files if files is not None else symbols).agg(F.count_distinct("path").alias("files"))
    about = n.crossJoin(rows.agg(F.count(F.lit(1)).alias("symbols")))  # one row each
    write(about.select(F.lit(commit).cast("string").alias("commit"), "files", "symbols", F.lit(name).alias("snapshot")), f"{folder}/about")


def load_snapshot(spark: SparkSession, folder: str, name: str) -> DataFrame:
    if list_snapshots(spark, folder).filter(F.col("snapshot") == name).isEmpty():
        raise ValueError(f"no snapshot {name}")
    rows = spark.read.parquet(f"{folder}/symbols").filter(F.col("snapshot").cast("string") == name)
    return rows.withColumn("ordinal", F.col("line_start"))


def list_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(snapshot, commit, files, symbols), by name; no rows before the first is saved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/about")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/about/snapshot=*"))
    if not found:  # no folder, or all deleted
        return spark.createDataFrame([], "snapshot string, commit string, files long, symbols long")
    return spark.read.parquet(f"{folder}/about").select(F.col("snapshot").cast("string").alias("snapshot"), "commit", "files", "symbols").orderBy("snapshot")


def delete_snapshot(spark: SparkSession, folder: str, name: str) -> bool:
    jvm = spark.sparkContext._jvm
    gone = False
    for part in ("symbols", "about"):
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}/snapshot={name}")
        gone |= path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return gone
