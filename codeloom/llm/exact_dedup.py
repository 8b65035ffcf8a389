"""Exact dedup: group by a 128-bit content hash, keep the smallest stable id, compare bytes.

1. One narrow aggregate counts the rows of every 128-bit hash; only 16 bytes and a count a row are
   shuffled, combined on the map side, so a text copied a million times adds one row a task.
2. Rows whose hash occurs once pass through without moving.
3. Rows of the other hashes are grouped by hash *and text*: bytes decide, so two texts that collide
   stay apart. The aggregate keeps the least row by id and combines on the map side too, so a hot
   group never gathers in one task.

Defined results: a null text equals nothing, so such rows all stay; empty texts equal each other;
a null id comes after all others; among rows of one text and one id, repeated rows included, one
row stays, the least by the remaining columns. An empty table stays empty. Extra columns pass
through under any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, fresh, join_checked, orderable, ref


def content_hash(text: Column) -> Column:
    """128 bits of the UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", hasher=content_hash) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    h, n, row = fresh(docs, "hash", "n", "row")
    spark_cols = docs.columns
    hashed = docs.withColumn(h, hasher(ref(text)))
    repeated = cut(hashed.filter(ref(text).isNotNull()).groupBy(h).agg(F.count(F.lit(1)).alias(n)).filter(F.col(n) > 1).select(h))
    single = join_checked(hashed, repeated, h, "left_anti").select(*map(ref, spark_cols))
    many = join_checked(hashed.filter(ref(text).isNotNull()), repeated, h, "left_semi")
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    others = [c for c in spark_cols if c not in (text, key)]
    parts = [ref(key).isNull(), ref(key), *(ref(c) for c in others if orderable(kinds[c]))]
    keys = F.struct(*(p.alias(f"o{i}") for i, p in enumerate(parts)))
    held = F.struct(*(ref(c).alias(f"c{i}") for i, c in enumerate(spark_cols) if c != text))
    pick = F.min(F.struct(keys.alias("k"), held.alias("v"))) if all(orderable(kinds[c]) for c in spark_cols) else F.struct(F.min_by(held, keys).alias("v"))
    best = many.groupBy(h, ref(text).alias("t")).agg(pick.alias(row))
    at = {c: i for i, c in enumerate(spark_cols)}
    winners = best.select(*((F.col("t") if c == text else F.col(f"`{row}`.v.c{at[c]}")).alias(c) for c in spark_cols))
    return single.unionByName(winners)


ORACLE = """
select doc_id, text, lang, source, n_chars from documents where text is null
union all
select doc_id, text, lang, source, n_chars from (
  select *, row_number() over (partition by text order by doc_id nulls last, lang, source, n_chars) as rn
  from documents where text is not null) where rn = 1
"""
