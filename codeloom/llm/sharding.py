"""Sharding: global byte-size prefix sums from per-partition totals, cut at equal targets.

The rows are range-partitioned by id (only id, size and a tie-break hash move, never the text),
sorted inside the partitions and written once to the shared folder, so every later step sees the
same partitions even if an executor is lost. A driver-side prefix sum over one total a partition
gives each partition its offset; a running sum inside the partition gives each row its first byte.
Shard = first byte div target, so shards are contiguous runs of the id order and their sizes differ
from the target by less than one document.

Defined results: a null text has 0 bytes; null ids sort first; rows of one id are ordered by size,
then by content hash; rows equal in all three are interchangeable. A row that starts exactly at a
cut opens the next shard; rows of 0 bytes at the very end stay in the last shard. An empty table
gives no rows. A text larger than the target leaves the shards that it covers empty.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import cut, join_checked, ref

#: A shard holds at most about this many bytes ...
SHARD_BYTES = 256 << 20
#: ... and there is at least one shard for each of so many readers.
READERS = 64


def assign_shards(docs: DataFrame, shard_bytes: int = SHARD_BYTES, readers: int = READERS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, first_byte, shard_id) of every row."""
    narrow = docs.select(ref(key).alias("k"), F.coalesce(F.octet_length(ref(text)), F.lit(0)).cast("long").alias("b"), F.xxhash64(ref(text)).alias("h"))
    # written first, as the sampling of the ranges would read the texts a second time
    parts = cut(cut(narrow).repartitionByRange("k", "b", "h").sortWithinPartitions("k", "b", "h").withColumn("p", F.spark_partition_id()))
    totals = sorted((r["p"], r["s"]) for r in parts.groupBy("p").agg(F.sum("b").alias("s")).collect())
    ends = list(accumulate(s for _, s in totals))
    total = ends[-1] if ends else 0
    shards = max(readers, -(-total // shard_bytes))
    target = max(1, -(-total // shards))
    offsets = docs.sparkSession.createDataFrame([(p, e - s) for (p, s), e in zip(totals, ends, strict=True)], "p int, at long")  # a row a partition
    running = F.sum("b").over(Window.partitionBy("p").orderBy("k", "b", "h").rowsBetween(Window.unboundedPreceding, 0))
    placed = join_checked(parts.withColumn("own", running), offsets, "p", "inner").withColumn("first_byte", F.col("at") + F.col("own") - F.col("b"))
    last = F.lit(max(0, (total - 1) // target))
    return placed.select(F.col("k").alias(key), F.col("b").alias("n_bytes"), "first_byte", F.least(F.expr(f"first_byte div {target}"), last).alias("shard_id"))


ORACLE = f"""
with d as (select doc_id, coalesce(strlen(text), 0)::bigint as n_bytes from documents),
t as (select coalesce(sum(n_bytes), 0)::bigint as total, greatest({READERS}, (coalesce(sum(n_bytes), 0)::bigint + {SHARD_BYTES - 1}) // {SHARD_BYTES})::bigint as shards from d),
u as (select total, greatest(1, (total + shards - 1) // shards)::bigint as target from t),
p as (select doc_id, n_bytes, (sum(n_bytes) over (order by doc_id nulls first, n_bytes rows unbounded preceding) - n_bytes)::bigint as first_byte from d)
select doc_id, n_bytes, first_byte, least(first_byte // target, greatest(0, (total - 1) // target))::bigint as shard_id from p, u
"""
