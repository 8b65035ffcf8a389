import hashlib
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from codeloom.llm import exact_dedup, quality, sharding

SF = "/root/testdata/sf0.001"


def test_quality_keeps_prose_and_rejects_junk(spark):
    prose = "The house of the river is on a hill, and it was seen from the road by many. " * 3
    junk = {"pipes": "abc | def | ghi | jkl | " * 20, "symbols": "word### other%%% " * 20, "shout": "LOUD!! WORDS!! HERE!! " * 20, "repeat": "same " * 200, "lines": "one line here\n" * 40, "blank": "  \n", "empty": "", "stop": "zq xw vk pj " * 20}
    rows = [("prose", prose), ("short", "Of course."), ("null", None), *junk.items()]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.doc_id for r in quality.quality_filter(df).collect()} == {"prose", "short"}
    assert {r.doc_id for r in quality.quality_report(df).collect()} == {"prose", "short"}


def test_quality_of_scripts_without_spaces_and_of_few_words(spark):
    chinese = "在这个城市里有很多人，他们的生活是很简单的。我不知道这是不是真的，但是他一直在说。" * 4
    japanese = "この町には多くの人がいて、その生活はとても簡単でした。私はそれが本当かどうか知りません。" * 4
    rows = [("zh", chinese), ("ja", japanese), ("mixed", chinese + " and the rest of it is in English, as it was. " * 3), *((f"w{n}", " ".join(f"zq{i}" for i in range(n))) for n in (5, 29, 30, 31, 60))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {r.doc_id for r in quality.quality_filter(df).collect()} == {"zh", "ja", "mixed", "w5", "w29", "w30"}
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = {tuple(r) for r in con.execute(quality.ORACLE).fetchall()}
    assert {tuple(r) for r in quality.quality_report(df).collect()} == want
    thai = [r for r in quality.RULES if r.metric != "stop_shortfall"]
    assert quality.quality_filter(spark.createDataFrame([("th", "ประเทศไทยเป็นประเทศที่ตั้งอยู่ในเอเชียตะวันออกเฉียงใต้")], df.schema), tuple(thai)).count() == 1


def test_quality_edges(edge, nothing):
    out = quality.quality_filter(edge)
    assert out.columns == edge.columns
    ids = Counter(r.doc_id for r in out.collect())
    assert ids[2] == 2 and not ids[4] and not ids[5] and not ids[7]
    assert quality.quality_filter(nothing).count() == 0 and quality.quality_report(nothing).count() == 0


def test_quality_plan_has_no_exchange_or_python(edge):
    plan = quality.quality_filter(edge.sparkSession.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def brute_dedup(rows):
    best = {}
    out = []
    for r in rows:
        if r.text is None:
            out.append(r)
            continue
        k = (r.doc_id is None, r.doc_id or 0)
        if r.text not in best or k < best[r.text][0]:
            best[r.text] = (k, r)
    return Counter((r.doc_id, r.text) for r in [*out, *(b for _, b in best.values())])


def test_exact_dedup_edges(edge, nothing):
    out = exact_dedup.exact_dedup(edge)
    assert out.columns == edge.columns
    assert Counter((r.doc_id, r.text) for r in out.collect()) == brute_dedup(edge.collect())
    assert exact_dedup.exact_dedup(nothing).count() == 0


def test_exact_dedup_survives_hash_collisions(edge):
    out = exact_dedup.exact_dedup(edge, hasher=lambda t: F.unhex(F.substring(F.md5(t.cast("binary")), 1, 1)))
    assert Counter((r.doc_id, r.text) for r in out.collect()) == brute_dedup(edge.collect())


def test_exact_dedup_shuffles_when_the_side_is_large(edge, monkeypatch):
    monkeypatch.setattr(exact_dedup, "join_checked", lambda a, b, on, how: __import__("codeloom.llm.common", fromlist=["x"]).join_checked(a, b, on, how, limit=-1))
    out = exact_dedup.exact_dedup(edge)
    assert Counter((r.doc_id, r.text) for r in out.collect()) == brute_dedup(edge.collect())


def test_exact_dedup_with_a_map_column(edge):
    df = edge.withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    assert exact_dedup.exact_dedup(df).count() == exact_dedup.exact_dedup(edge).count()


def test_sharding_edges(edge, nothing):
    for readers in (1, 4, 100):
        got = sorted(sharding.assign_shards(edge, readers=readers).collect(), key=lambda r: (r.first_byte, r.n_bytes))
        total = sum(len((r.text or "").encode()) for r in edge.collect())
        target = max(1, -(-total // readers))
        at = 0
        for r in got:
            assert r.first_byte == at
            at += r.n_bytes
        assert at == total and [r.shard_id for r in got] == sorted(r.shard_id for r in got)
        assert all(r.shard_id == min(r.first_byte // target, (total - 1) // target) for r in got)
    assert sharding.assign_shards(nothing).count() == 0


def test_sharding_balances(documents):
    got = sharding.assign_shards(documents, readers=8).groupBy("shard_id").agg(F.sum("n_bytes").alias("b"), F.max("n_bytes").alias("m")).collect()
    total, largest = sum(r.b for r in got), max(r.m for r in got)
    assert len(got) == 8 and all(abs(r.b - total / 8) <= 2 * largest for r in got)


def test_content_hash_is_md5(spark):
    assert bytes(spark.range(1).select(exact_dedup.content_hash(F.lit("é")).alias("h")).first().h) == hashlib.md5("é".encode()).digest()


def test_oracles(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for df, sql in ((quality.quality_report(docs), quality.ORACLE), (exact_dedup.exact_dedup(docs), exact_dedup.ORACLE), (sharding.assign_shards(docs), sharding.ORACLE)):
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert Counter(cur.fetchall()) == Counter(tuple(r[c] for c in names) for r in df.collect())
