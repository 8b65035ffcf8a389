from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codeloom.llm import mixing, packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(0.01, 0.99), st.integers(0, 500)), min_size=0, max_size=60), st.integers(0, 9))
def test_flight_keeps_both_totals(units, seed):
    pi = np.array([p for p, _ in units])
    m, t = np.ones(len(units)), np.array([float(x) for _, x in units])
    out = mixing.flight(pi, m, t, np.random.default_rng(seed))
    assert ((out > -1e-6) & (out < 1 + 1e-6)).all()
    assert abs(out.sum() - pi.sum()) < 1e-4 and abs((out * t).sum() - (pi * t).sum()) < 0.05
    assert ((out > 1e-6) & (out < 1 - 1e-6)).sum() <= 2


def test_flight_keeps_inclusion_probabilities():
    pi, t = np.array([0.3, 0.6, 0.5, 0.2, 0.8, 0.4]), np.array([5.0, 9, 2, 7, 1, 3])
    mean = np.zeros(6)
    for s in range(4000):
        rng = np.random.default_rng(s)
        mean += mixing.landing(np.zeros(6), np.ones(6), t, mixing.flight(pi, np.ones(6), t, rng), rng)
    assert np.abs(mean / 4000 - pi).max() < 0.035


def test_targets_fill_like_water():
    p = mixing.targets({"a": 1000, "b": 100, "c": 100}, weights={"a": 1, "b": 1, "c": 1}, budget=0.5)
    assert p["b"] == p["c"] == 1.0 and abs(p["a"] - 0.4) < 1e-12
    assert mixing.targets({"a": 10, "z": 0}, weights={"a": 1})["z"] == 0.0
    assert mixing.targets({}) == {} and mixing.targets({None: 10}, budget=1.0) == {None: 1.0}


@pytest.mark.parametrize("group", [50_000, 15])
def test_mix_holds_targets(documents, group):
    n = F.regexp_count("text", F.lit(r"\S+"))
    big = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 1000).withColumn("text", F.concat("text", F.lit(" x")))).withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b"))
    rows = big.groupBy("source").agg(F.sum(n).alias("t"), F.count(F.lit(1)).alias("c"), F.max(n).alias("x")).collect()
    pi = mixing.targets({r.source: r.t for r in rows}, budget=0.6)
    got = {r.source: r for r in mixing.mix_sources(big, budget=0.6, group=group).groupBy("source").agg(F.sum(n).alias("t"), F.count(F.lit(1)).alias("c")).collect()}
    for r in rows:
        assert abs(got[r.source].c - pi[r.source] * r.c) <= 2
        assert abs(got[r.source].t - pi[r.source] * r.t) <= 2 * r.x
    assert abs(sum(g.t for g in got.values()) - 0.6 * sum(r.t for r in rows)) <= 2 * max(r.x for r in rows)


def test_mix_edges(edge, nothing):
    out = mixing.mix_sources(edge)
    assert out.columns == edge.columns
    rows = Counter((r.doc_id, r.text, r.source, r.lang) for r in edge.collect())
    kept = Counter((r.doc_id, r.text, r.source, r.lang) for r in out.collect())
    assert all(kept[k] <= rows[k] for k in kept)
    assert kept[2, next(k[1] for k in rows if k[0] == 2), "a", "en"] in (0, 2)  # repeated rows share a decision
    again = Counter((r.doc_id, r.text, r.source, r.lang) for r in mixing.mix_sources(edge.repartition(2)).collect())
    assert again == kept
    assert mixing.mix_sources(nothing).count() == 0
    assert {r.source for r in mixing.mix_sources(edge, weights={"c": 1.0}, budget=1.0).collect()} == {"c"}


def brute_round_robin(totals, weights, window):
    """Deficit round-robin, a window and a token at a time, with exact deficits."""
    left, windows = list(totals), []
    phase, k = None, 0
    while True:
        active = tuple(i for i, n in enumerate(left) if n > 0 and weights[i] > 0)
        if not active:
            return windows
        if active != phase:
            phase, k, whole, run, bounds = active, 0, sum(weights[i] for i in active), 0.0, {}
            for i in active:
                low = min(packing.UNIT, int(run / whole * packing.UNIT))
                run += weights[i]
                bounds[i] = (low, packing.UNIT if i == active[-1] else min(packing.UNIT, int(run / whole * packing.UNIT)))
        due = lambda i, k: int(Fraction(k * window * bounds[i][1], packing.UNIT)) - int(Fraction(k * window * bounds[i][0], packing.UNIT))  # noqa: B023, E731
        own = {i: due(i, k + 1) - due(i, k) for i in active}
        if any(own[i] > left[i] for i in active):
            own = {i: min(left[i], own[i]) for i in active}
            short = window - sum(own.values())
            while short > 0 and any(left[i] > own[i] for i in active):
                able = [i for i in active if left[i] > own[i]]
                share, part = short, sum(weights[i] for i in able)
                for i in able:
                    more = min(left[i] - own[i], short, max(1, int(share * weights[i] / part)))
                    own[i], short = own[i] + more, short - more
            phase = None
        k += 1
        for i in active:
            left[i] -= own[i]
        if any(left[i] == 0 for i in active):
            phase = None
        windows.append({i: n for i, n in own.items() if n})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 400), st.floats(0, 5)), min_size=1, max_size=5), st.integers(1, 40))
def test_phases_serve_what_round_robin_serves(sources, window):
    totals, weights = [n for n, _ in sources], [w for _, w in sources]
    got = defaultdict(dict)
    for i, first, k, q0, q1, low, high, pos in packing.phases(totals, weights, window):
        for j in range(k):
            n = packing.served(j + 1, window, low, high) - packing.served(j, window, low, high) if pos < 0 else q1 - q0
            if n:
                got[first + j][i] = got[first + j].get(i, 0) + n
    mine = [got[j] for j in sorted(got)]
    assert sorted(got) == list(range(len(got)))
    served = Counter()
    for w in mine:
        served.update(w)
    assert served == Counter({i: n for i, n in enumerate(totals) if n and weights[i] > 0})
    assert all(sum(w.values()) == window for w in mine[:-1])
    brute = brute_round_robin(totals, weights, window)
    assert len(brute) == len(mine)
    active = [i for i in range(len(totals)) if totals[i] and weights[i] > 0]
    if active:  # as long as no source runs dry, each window equals the simulated one
        dry = next((j for j, w in enumerate(brute) if any(sum(x.get(i, 0) for x in brute[: j + 1]) == totals[i] for i in active)), len(brute))
        assert mine[:dry] == brute[:dry]


def _packed(rows, tokens):
    """Tokens of every window rebuilt from the runs."""
    out = defaultdict(dict)
    for r in rows:
        for x in range(r.n_tokens):
            assert r.position + x not in out[r.window_id]
            out[r.window_id][r.position + x] = (r.source, r.doc_id, r.doc_start + x)
    return out


@pytest.mark.parametrize("weights", [None, {"a": 3.0, "b": 1.0, "c": 1.0, None: 0.5}])
def test_pack_round_trip(edge, weights):
    df = edge.filter((F.col("doc_id").isNull()) | (F.col("doc_id") != 8))
    words = {}
    for r in df.collect():
        n = len((r.text or "").split())
        if n:
            words[r.source, r.doc_id] = words.get((r.source, r.doc_id), 0) + n
    window = 64
    got = packing.pack(df, weights, window).collect()
    out = _packed(got, words)
    assert sorted(out) == list(range(len(out)))
    assert all(sorted(w) == list(range(window)) for k, w in out.items() if k < len(out) - 1)
    seen = Counter()
    for r in got:
        seen[r.source, r.doc_id] += r.n_tokens
    assert seen == Counter(words)


def test_windows_hold_the_target_mixture(documents):
    w = {f"src{i}": float(i + 1) for i in range(20)}
    got = packing.pack(documents, w, 500).groupBy("window_id", "source").agg(F.sum("n_tokens").alias("n")).filter("window_id < 5").collect()
    n = {(r.window_id, r.source): r.n for r in got}
    for s in w:  # what is carried is less than a token, however many windows have been filled
        for k in range(1, 6):
            assert abs(sum(n.get((j, s), 0) for j in range(k)) - k * 500 * w[s] / 210) < 1
    assert len({r.source for r in got}) == 20


def test_pack_edges(edge, nothing):
    assert packing.pack(nothing).count() == 0
    ids = {r.doc_id for r in packing.pack(edge).collect()}
    assert not ids & {4, 5, 6, 7} and None in ids and 8 in ids


def cube(pi, constraints, rng):
    """The flight phase as its definition has it: a null vector of the constraints of the first fractional units by SVD."""
    pi, k = pi.astype(float).copy(), len(constraints) + 1
    order = [i for i in range(len(pi)) if 1e-9 < pi[i] < 1 - 1e-9]
    draws = iter(rng.random(len(order) + 8))
    while True:
        some = [i for i in order if 1e-9 < pi[i] < 1 - 1e-9][:k]
        if len(some) < k:
            return pi
        a = np.array([[c[i] for i in some] for c in constraints], float)
        u = np.linalg.svd(a)[2][-1]
        if k == 3 and np.linalg.matrix_rank(a) < 2:
            u = np.array([a[0, 1], -a[0, 0], 0.0])
        lead = np.cross(a[0], a[1]) if k == 3 and np.linalg.matrix_rank(a) == 2 else np.array([a[0, 1], -a[0, 0], 0.0][:k])
        u = u * np.sign(u @ lead)
        up = min((1 - pi[i]) / c if c > 0 else pi[i] / -c for i, c in zip(some, u, strict=True) if abs(c) > 1e-12)
        down = min(pi[i] / c if c > 0 else (1 - pi[i]) / -c for i, c in zip(some, u, strict=True) if abs(c) > 1e-12)
        pi[some] += (up if next(draws) * (up + down) < down else -down) * u
        pi[some] = [round(p) if p < 1e-9 or p > 1 - 1e-9 else p for p in pi[some]]


@pytest.mark.parametrize("cut_at", [None, "a"])
def test_mix_against_brute_force(spark, documents, cut_at):
    """The same rows as the cube method run in one place, from its definition."""
    docs = documents.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "a").when(F.col("doc_id") % 3 == 1, "b")) if cut_at else documents
    units = docs.select("source", F.col("doc_id").cast("string").alias("k"), F.xxhash64("text").alias("h"), F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).alias("n")).groupBy("source", "k", "h").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t")).collect()
    tokens = Counter()
    for u in units:
        tokens[u.source] += u.t
    names = sorted(tokens, key=lambda s: (s is None, s))
    pi = mixing.targets(dict(tokens))
    rows = [(names.index(u.source), u.k, u.h, u.m, u.t) for u in units]
    keyed = spark.createDataFrame(rows, "s long, k string, h long, m long, t long").select("*", *(F.xxhash64(F.lit(mixing.SEED + i), "s", "k", "h").alias(f"r{i}") for i in (0, 1))).collect()
    chance = {}
    for s in range(len(names)):
        own = sorted((u for u in keyed if u.s == s), key=lambda u: (u.r0, u.h))
        p = np.full(len(own), pi[names[s]])
        if 0 < pi[names[s]] < 1:
            p = cube(p, [[u.m for u in own], [u.t for u in own]], np.random.default_rng([mixing.SEED, own[0].r0 & (2**63 - 1), len(own)]))
        chance |= {(u.s, u.k, u.h): x for u, x in zip(own, p, strict=True)}
    left = sorted((u for u in keyed if 1e-9 < chance[u.s, u.k, u.h] < 1 - 1e-9), key=lambda u: (u.r1, u.h))
    if left:
        rng = np.random.default_rng([mixing.SEED + 2, left[0].r1 & (2**63 - 1), len(left)])
        p, m, t = (np.array([f(u) for u in left], float) for f in (lambda u: chance[u.s, u.k, u.h], lambda u: u.m, lambda u: u.t))
        for s in sorted({u.s for u in left}):
            at = [i for i, u in enumerate(left) if u.s == s]
            p[at] = cube(p[at], [m[at]], rng)
        p = cube(cube(p, [m, t], rng), [m], rng)
        last = (p > 1e-9) & (p < 1 - 1e-9)
        p[last] = rng.random(last.sum()) < p[last]
        chance |= {(u.s, u.k, u.h): x for u, x in zip(left, p, strict=True)}
    want = sorted(u.k for u in keyed if chance[u.s, u.k, u.h] > 0.5)
    assert sorted(str(r.doc_id) for r in mixing.mix_sources(docs).select("doc_id").collect()) == want


def test_packing_by_tempered_shares(documents):
    """Every window but those after a source has run dry holds the target proportions to a token a source."""
    totals = {r.source: r.n for r in documents.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    whole = sum(n**packing.ALPHA for n in totals.values())
    out = packing.pack(documents, window=256, alpha=packing.ALPHA).groupBy("window_id", "source").agg(F.sum("n_tokens").alias("n")).collect()
    served = Counter()
    for r in out:
        served[r.source] += r.n
    assert dict(served) == totals
    first_dry = min(max(r.window_id for r in out if r.source == s) for s in totals)
    for r in out:
        if r.window_id < first_dry:
            assert abs(r.n - 256 * totals[r.source] ** packing.ALPHA / whole) <= 2
