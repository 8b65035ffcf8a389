"""Corpus pipeline: quality rules, exact dedup, near-dedup, source mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a
DataFrame that is written as Parquet and read again as the next stage's docs. All but the last
return the columns of documents; the last returns the runs of tokens of each packed window.

Defined results: null and empty texts go at the first stage; of repeated rows and of copies one stays
(2), of near copies the least id (3), ties and null ids as those operators' docstrings say; an empty
table gives no rows; extra columns pass through the first four stages under any name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm.exact_dedup import exact_dedup
from codeloom.llm.mixing import mix_sources
from codeloom.llm.packing import pack
from codeloom.llm.quality import quality_filter
from codeloom.llm.simhash import near_dedup
from codeloom.session import ensure_checkpoint_dir


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_filter(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("mixing", mixing),
    ("packing", packing),
]

#: SimHash, balanced sampling and their order-dependent results can't be written in SQL; the tests
#: hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    shared = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{k}")
        docs = spark.read.parquet(f"{shared}/{k}")
    return docs
