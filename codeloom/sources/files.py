"""Source trees as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators.relations import with_facts

IGNORED = (".codeloom", ".git", "__pycache__", "build", "dist", "node_modules", "target")
EXTENSIONS = ("py", "js", "ts", "jsx", "tsx", "rs", "java", "go", "c", "h", "md")


def scoped(rows: DataFrame, extensions: tuple[str, ...] = EXTENSIONS, ignored: tuple[str, ...] = IGNORED, prefix: str = "") -> DataFrame:
    """The rows whose path is under ``prefix``, in no ignored folder, and of one of the extensions (none given: of all)."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    out = rows.filter(F.col("path").startswith(prefix) & ~F.arrays_overlap(folders, F.array(*map(F.lit, ignored))))
    return out.filter(F.regexp_extract("path", r"\.([^./]+)$", 1).isin(*extensions)) if extensions else out


def scan_tree(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """files under ``root``, read by the executors: path (relative), language, size, hash, content.

    Folders are pruned by exact name, then extensions (none given: all), then files of unknown
    language and files that aren't UTF-8.
    """
    return _texts(_listed(spark, root, extensions, ignored))


def _listed(spark: SparkSession, root: str, extensions: tuple[str, ...], ignored: tuple[str, ...], paths: list[str] | None = None) -> DataFrame:
    """The files of a tree as the scan gives them, paths relative. A column that isn't used is not read: without
    ``content`` this lists only. Files of one extension alone are listed as such; ``paths`` names the files to read."""
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    read = spark.read.format("binaryFile")
    if paths is None:
        read = read.option("recursiveFileLookup", "true")
        read = read.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}") if extensions else read
    raw = read.load(root if paths is None else [full + p for p in paths])
    return scoped(raw.withColumn("path", F.substring(F.col("path"), len(full) + 1, 1 << 30)), extensions, ignored)


def _texts(raw: DataFrame) -> DataFrame:
    text = raw.filter(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("content"))
    return with_facts(text).filter(F.col("language") != "unknown")


def read_files(spark: SparkSession, root: str, paths: list[str], extensions: tuple[str, ...] = EXTENSIONS, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """The same for some files, named by their relative paths; no other file is read."""
    return _texts(_listed(spark, root, extensions, ignored, paths))


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """(path, size, mtime) of the files that a scan would look at; no content is read."""
    raw = _listed(spark, root, extensions, ignored).filter(X.language(F.col("path")) != "unknown")
    return raw.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def indexable(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(files): how many files a scan would take."""
    return scoped(files.select("path"), extensions).agg(F.count(F.lit(1)).alias("files"))
