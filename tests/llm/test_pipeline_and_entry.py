from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from codeloom.llm import mixing, quality
from codeloom.llm import simhash as S

SF = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "mixing", "packing"]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = quality.quality_filter(docs).orderBy("doc_id").collect()
    first = {}
    for r in rows:
        first.setdefault(r.text, r)
    rows = sorted(first.values(), key=lambda r: r.doc_id)
    prints = S.fingerprints(pa.array([r.text for r in rows])).to_pylist()
    fp = S._matrix(pa.array(prints))
    label = np.arange(len(fp))
    for i in range(len(fp)):
        d = np.bitwise_count(fp[i] ^ fp).sum(1)
        near = np.flatnonzero(d <= S.DISTANCE)
        S._merge(label, np.full(len(near), i), near)
    kept = [r for i, r in enumerate(rows) if label[i] == i]
    stages = {}
    now = docs
    for name, f in corpus_pipeline.STAGES[:4]:
        now = f(spark, now, SF).persist()
        stages[name] = now
        assert now.columns == docs.columns
    assert [r.doc_id for r in stages["simhash near-dedup"].select("doc_id").orderBy("doc_id").collect()] == [r.doc_id for r in kept]
    tokens = Counter()
    for r in kept:
        tokens[r.source] += len(r.text.split())
    pi = mixing.targets(dict(tokens))
    count = Counter(r.source for r in kept)
    mixed = stages["mixing"].collect()
    got = Counter(r.source for r in mixed)
    assert all(abs(got[s] - pi[s] * count[s]) <= 2 for s in count)
    out = corpus_pipeline.run(spark, SF)
    sums = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()}
    assert sums == {r.doc_id: len(r.text.split()) for r in mixed}
    full = out.groupBy("window_id").agg(F.sum("n_tokens").alias("n")).orderBy("window_id").collect()
    assert all(r.n == 4096 for r in full[:-1])


def test_queries_run_and_return_rows(spark):
    for name, q in entry.queries().items():
        if name.startswith("op"):
            assert q(spark, SF).count() > 0, name


def test_pipeline_on_nulls_empty_texts_ties_and_clashing_names(spark, edge, nothing, tmp_path):
    """Each stage keeps the columns; what goes are rejects, copies, near copies and what mixing leaves out."""
    now, before = edge, None
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, now, "").write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        rows = [(r.doc_id, r.text) for r in now.collect()] if k < 4 else None
        if k < 4:
            assert now.columns == edge.columns and (before is None or not Counter(rows) - before), name
            before = Counter(rows)
        if name == "quality rules":
            assert all(t and t.strip() for _, t in rows)
        if name == "exact dedup":
            assert len({t for _, t in rows}) == len(rows)
    assert {(r.doc_id, r.n) for r in now.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).collect()} <= {(i, n) for i in {i for i, _ in before} for n in {sum(len(t.split()) for j, t in before if j == i)}}
    for name, table in (("edge", edge), ("nothing", nothing)):
        table.write.parquet(f"{tmp_path}/{name}/documents.parquet")
    assert Counter(corpus_pipeline.run(spark, f"{tmp_path}/edge").collect()) == Counter(now.collect())
    assert corpus_pipeline.run(spark, f"{tmp_path}/nothing").count() == 0
