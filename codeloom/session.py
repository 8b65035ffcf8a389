"""Session and shared-folder helpers used by every part of the library."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only up to this many bytes, counted, not estimated.
BROADCAST_BYTES = 64 << 20


def build_session(app: str = "codeloom", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution and UTC; ``master`` only for local use."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in {**base, **(conf or {})}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (tests on one
    machine) a local folder is made.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="codeloom-checkpoint-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once into the shared folder; survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame) -> bool:
    """Whether the rows of ``df``, which must be flat and cheap to read again, may be broadcast."""
    size = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind == "string":
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
    return int(df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES


def side(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it is small; else joins with it shuffle."""
    return F.broadcast(df) if small(df) else df
