import random

import numpy as np
import pyarrow as pa

from codeloom.llm import simhash as S


def _prints(n, seed=1):
    return np.random.default_rng(seed).integers(0, 2**64, (n, 4), dtype=np.uint64)


def _flip(fp, bits, rng):
    x = np.unpackbits(fp.view(np.uint8), bitorder="little")
    x[rng.choice(256, bits, replace=False)] ^= 1
    return np.packbits(x, bitorder="little").view(np.uint64)


def _brute(fp, distance=S.DISTANCE):
    pairs = []
    for i in range(len(fp)):
        d = sum(np.bitwise_count(fp[i, w] ^ fp[i + 1 :, w]).astype(int) for w in range(4))
        pairs += [(i, i + 1 + int(j)) for j in np.flatnonzero(d <= distance)]
    return pairs


def _groups(n, pairs):
    label = np.arange(n)
    if pairs:
        u, v = np.array(pairs).T
        S._merge(label, u, v)
    return label


def test_fingerprint_tells_near_from_far():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(3000)]
    a = [rng.choice(words) for _ in range(300)]
    b = list(a)
    for i in rng.sample(range(300), 12):
        b[i] = rng.choice(words)
    c = [rng.choice(words) for _ in range(300)]
    f = S._matrix(S.fingerprints(pa.array([" ".join(a), " ".join(b).upper() + ".", " ".join(c)])))
    d = lambda i, j: int(np.bitwise_count(f[i] ^ f[j]).sum())
    assert d(0, 1) <= S.DISTANCE < 90 < d(0, 2)


def test_fingerprint_edges_and_blocks():
    texts = [None, "", " .,! ", "one", "one", "two words", "Two, words!", "x " * 100_000, "é è"]
    f = S.fingerprints(pa.array(texts, pa.string())).to_pylist()
    assert f[:3] == [None] * 3 and f[3] == f[4] and f[5] == f[6] and all(f[3:])
    assert f == [S.fingerprints(pa.array([t], pa.string())).to_pylist()[0] for t in texts]


def test_filter_chances():
    rng = np.random.default_rng(0)
    fp = _prints(20_000)
    near = np.array([_flip(x, S.DISTANCE, rng) for x in fp[:4000]])
    s, mask, shift = (x[0] for x in S._filters(5, 1, -1))
    ok = np.bitwise_count((fp[:, s] ^ shift) & mask) <= S.WEIGHT
    assert abs(ok.mean() - S.pass_rate()) < 0.005
    both = [np.bitwise_count((near[ok[:4000], s] ^ shift) & mask) <= S.WEIGHT]
    assert abs(both[0].mean() - S.pass_together(S.DISTANCE / 256)) < 0.12


def test_recall_against_brute_force():
    rng = np.random.default_rng(4)
    base = _prints(2500, 2)
    near = [_flip(base[i], int(rng.integers(1, 65)), rng) for i in range(700)]
    fp = np.unique(np.concatenate([base, near]), axis=0)
    want = _brute(fp)
    assert len(want) >= 700
    for leaf in (4096, 50):  # one level, and deeper recursion
        plan = S.search_plan(len(fp), leaf=leaf)
        assert plan["levels"] == (1 if leaf == 4096 else 2)
        found, label = set(), np.arange(len(fp))
        for path, strip, rows in S._descend(fp, np.arange(len(fp)), 0, -1, plan, 0, plan["before"]):
            u, v = S.list_edges(rows, fp[rows], path, strip, plan)
            found |= set(zip(u.tolist(), v.tolist(), strict=True))
            S._merge(label, u, v)
        truth = _groups(len(fp), want)
        met = sum(label[i] == label[j] for i, j in want) / len(want)
        assert met >= 0.9
        assert all(truth[u] == truth[v] for u, v in found)  # nothing far is joined


def test_plan_grows_with_the_rows():
    plans = {n: S.search_plan(n) for n in (1000, 10**5, 10**6, 10**7, 10**8, 10**9, 10**10, 10**11)}
    assert plans[1000]["levels"] == 1 and plans[10**10]["levels"] > plans[10**6]["levels"] > 1
    for n, p in plans.items():
        assert S.LEAF >= n * np.prod([S.pass_rate(*f) for f in p["kinds"]])
        assert S.LIST >= n * np.prod([S.pass_rate(*f) for f in p["kinds"][: p["before"]]])
        assert p["copies"] <= 18 * max(1, n / 2e7) ** 0.55  # far less than in proportion to the rows


def test_expected_recall_at_the_furthest_distance_is_the_target_at_every_size():
    for n in (10**3, 10**6, 10**9, 10**11):
        p = S.search_plan(n)
        met = 1.0
        for count, f in zip(reversed(p["filters"]), reversed(p["kinds"]), strict=True):
            met = 1 - np.exp(-count * S.pass_rate(*f) * S.pass_together(S.DISTANCE / S.BITS, *f) * met)
        assert met >= S.TARGET - 1e-9


def test_crowds_of_near_copies():
    """Leaves of thousands of near copies: brute force's groups, in memory and time that follow the rows."""
    import time
    import tracemalloc

    rng = np.random.default_rng(8)
    centres = _prints(4, 9)
    bits = lambda n, most: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 4, most), dtype=np.uint64), axis=2)
    crowd = lambda c, n, most: centres[c] ^ bits(n, most)
    between = np.array([_flip(_flip(centres[0], 50, rng), 10, rng) for _ in range(30)])
    fp = np.concatenate([_prints(300, 10), crowd(0, 500, 3), crowd(1, 400, 12), crowd(2, 90, 10), between])
    fp = fp[rng.permutation(len(fp))]
    want = _groups(len(fp), _brute(fp))
    for leaf in (5, 50, 300, 5000):
        label = np.arange(len(fp))
        S.join_leaf(fp, np.arange(len(fp)), label, leaf=leaf)
        assert (label == want).all(), leaf
    many = np.concatenate([crowd(0, 50_000, 4), crowd(1, 20_000, 4), _prints(1500, 11)])
    tracemalloc.start()
    began = time.process_time()
    u, v = S.list_edges(np.arange(len(many)), many, 3, 1, S.search_plan(10**6))
    assert tracemalloc.get_traced_memory()[1] < 3e8 and time.process_time() - began < 150
    tracemalloc.stop()
    label = np.arange(len(many))
    S._merge(label, u, v)
    a, b = (np.unique(x, return_counts=True) for x in (label[:50_000], label[50_000:70_000]))
    # a row that this list's filters part from its crowd meets it in another list
    assert a[1].max() > 49_000 and b[1].max() > 19_600 and not set(a[0]) & set(b[0]) and len(set(label[70_000:])) == 1500


def test_near_dedup_edges(edge, nothing):
    out = S.near_dedup(edge)
    assert out.columns == edge.columns
    got = [(r.doc_id, (r.text or "")[:20]) for r in out.collect()]
    ids = [i for i, _ in got]
    assert ids.count(1) == 1 and 2 not in ids  # one of the copies, the least id
    assert ids.count(10) == 1 and 11 not in ids  # a near copy goes
    assert ids.count(4) == 2 and 5 in ids and 6 in ids and 7 in ids and 9 in ids  # no words: all stay
    assert ids.count(None) == 1 and ids.count(12) == 2 and 8 in ids and 13 in ids
    assert S.near_dedup(nothing).count() == 0


def test_near_dedup_against_brute_force(documents):
    rows = documents.select("doc_id", "text").collect()
    fp = S.fingerprints(pa.array([r.text for r in rows]))
    m = S._matrix(pa.array([f for f in fp.to_pylist() if f]))
    ids = np.array([r.doc_id for r, f in zip(rows, fp.to_pylist(), strict=True) if f])
    label = _groups(len(m), _brute(m))
    least = {}
    for i, g in zip(ids.tolist(), label.tolist(), strict=True):
        least[g] = min(i, least.get(g, i))
    want = set(least.values()) | {r.doc_id for r, f in zip(rows, fp.to_pylist(), strict=True) if not f}
    got = {r.doc_id for r in S.near_dedup(documents).select("doc_id").collect()}
    assert want <= got and len(got - want) <= 0.1 * (len(rows) - len(want))


def test_components(spark):
    from codeloom.llm.components import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == got[101] == got[100] == 100
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
