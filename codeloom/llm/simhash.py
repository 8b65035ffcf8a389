"""SimHash near-dedup: 256-bit fingerprints, near pairs by the May-Ozerov recursion.

Fingerprint: the sign of the sum, over the set of adjacent word pairs of the whole text, of random
+-1 vectors (one extra feature, a hash of the set, makes the number odd, so that no bit ties). Two
texts are near if their fingerprints differ in at most ``DISTANCE`` of 256 bits, an angle whose
cosine is about 0.7.

Search (all rows are queries): equal fingerprints are grouped first. A node of the recursion is a list of
fingerprints; each of its children picks a random set of ``SAMPLE`` coordinates in one strip and a
random shift, and keeps the fingerprints whose shifted partial weight there is at most ``WEIGHT``.
Near fingerprints keep together far more often than others. Children are small by a factor 1/q and
are filtered again on other strips until ``LEAF`` fingerprints remain, which are compared by brute
force. How many lists are opened at the top follows from the filter's exact probabilities, so that
a pair at ``DISTANCE`` bits, the furthest, is met with the target recall; nearer pairs are met more often.
The first levels run where the rows are; one shuffle brings each list together; the rest runs inside a
task. Copies a row grow as about the number of fingerprints to the power 0.4 (15 for 10^5, 17 for 10^7,
85 for 10^9); of the filters in ``FILTERS`` the plan takes at the top the one with the fewest.
No list, leaf or group has a cap. Near copies pass the same filters, so thousands of them can meet in a
leaf: what is already one group there isn't compared again, and two large groups are compared
only where the distances from their centres allow a near pair, which loses none.

Groups are the connected components of near pairs; the row with the least id of each stays.

Defined results: null texts and texts without words have no fingerprint and stay; a null id comes
after all others; of rows equal in id and text one stays; ties are broken by the text's hash. An
empty table stays empty. Extra columns pass through under any name.
"""

from __future__ import annotations

from math import ceil, comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, fresh, join_checked, ref
from codeloom.llm.components import components
from codeloom.llm.vector_text import blocks, mix, word_hashes

BITS = 256
DISTANCE = 64
#: Recall of pairs at DISTANCE bits.
TARGET = 0.92
SAMPLE = 8
WEIGHT = 1
#: (coordinates, largest partial weight) of the filters to choose from at the top; below, it is SAMPLE and WEIGHT.
FILTERS = ((SAMPLE, WEIGHT), (12, 2), (14, 2), (16, 2), (18, 2), (20, 3))
LEAF = 1024
#: A list is brought to one task when it is expected to hold at most so many fingerprints (of about 100 bytes).
LIST = 1 << 20
#: Expected children that a fingerprint enters at each inner level.
INNER = 6.0
_LANES = (((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.uint64) << (8 * np.arange(8, dtype=np.uint64))[None, :]).sum(1, dtype=np.uint64)


def fingerprints(texts: pa.Array) -> pa.Array:
    """32 bytes for each text, null without words."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    has = np.zeros(len(texts), bool)
    for first, data, off in blocks(texts):
        h, bound = word_hashes(data, off)
        n = np.diff(bound)
        if not len(h):
            continue
        doc = np.repeat(np.arange(len(n)), n)
        pair = h.copy()
        pair[:-1] = mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])
        lone = bound[1:][n == 1] - 1
        pair[lone] = mix(h[lone])
        keep = np.ones(len(h), bool)
        keep[bound[1:][n > 1] - 1] = False  # a text's last word opens no pair, unless it is the only one
        key = (doc[keep].astype(np.uint64) << np.uint64(40)) | (pair[keep] >> np.uint64(24))
        key.sort()
        key = key[np.r_[True, key[1:] != key[:-1]]]
        doc, feature = (key >> np.uint64(40)).astype(np.int64), mix(key & np.uint64((1 << 40) - 1))
        at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
        m = np.diff(np.r_[at, len(doc)])
        whole = mix(np.add.reduceat(feature, at), 7)
        even = m % 2 == 0
        feature = np.insert(feature, (at + m)[even], whole[even])
        m = m + even
        at = np.r_[0, np.cumsum(m)[:-1]]
        owner = doc[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])]
        per = -(-m // 255)  # lanes of 8 bits hold sums of at most 255 features
        rank = np.arange(per.sum()) - np.repeat(np.r_[0, np.cumsum(per)[:-1]], per)
        cut_at = np.repeat(at, per) + 255 * rank
        part = np.empty((len(cut_at), BITS), np.int64)
        for w in range(BITS // 64):
            octets = mix(feature, 11 + w).view(np.uint8).reshape(-1, 8)
            for b in range(8):
                lanes = np.add.reduceat(_LANES[octets[:, b]], cut_at)
                part[:, w * 64 + b * 8 : w * 64 + b * 8 + 8] = lanes.view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(part, np.r_[0, np.cumsum(per)[:-1]], axis=0)
        out[first + owner] = np.packbits(2 * total > m[:, None], axis=1, bitorder="little")
        has[first + owner] = True
    return pa.array([x.tobytes() if k else None for x, k in zip(out, has, strict=True)], pa.binary())


def pass_rate(sample: int = SAMPLE, weight: int = WEIGHT) -> float:
    return sum(comb(sample, i) for i in range(weight + 1)) / 2**sample


def pass_together(delta: float, sample: int = SAMPLE, weight: int = WEIGHT) -> float:
    """Chance that a fingerprint which passes a filter is joined by one that differs in ``delta``."""
    b = lambda n, k: comb(n, k) * delta**k * (1 - delta) ** (n - k)
    both = sum(comb(sample, i) / 2**sample * b(i, d1) * b(sample - i, d0) for i in range(weight + 1) for d1 in range(i + 1) for d0 in range(min(sample - i, weight - i + d1) + 1))
    return both / pass_rate(sample, weight)


def _plan(n: int, target: float, distance: int, leaf: int, most: int, top: tuple[int, int]) -> dict:
    q, c = zip(*((pass_rate(*f), pass_together(distance / BITS, *f)) for f in (top, (SAMPLE, WEIGHT))), strict=True)
    deep = lambda size: 1 + max(0, ceil(log(max(n, 1) * q[0] / size) / log(1 / q[1])))
    levels, before = deep(leaf), deep(most)
    met = 1.0
    for _ in range(levels - 1):
        met = 1 - np.exp(-INNER * c[1] * met)
    outer = -log(1 - target) / (c[0] * met)
    return {"kinds": [top, *[(SAMPLE, WEIGHT)] * (levels - 1)], "levels": levels, "before": before, "filters": [ceil(outer / q[0]), *[ceil(INNER / q[1])] * (levels - 1)], "copies": float(outer * INNER ** (before - 1))}


def search_plan(n: int, target: float = TARGET, distance: int = DISTANCE, leaf: int = LEAF, most: int = LIST) -> dict:
    """The filters of each level, levels in all and before the shuffle, and copies of a row shuffled, for ``n`` fingerprints."""
    return min((_plan(n, target, distance, leaf, most, f) for f in FILTERS), key=lambda p: (p["copies"], p["levels"], p["filters"][0]))


def _filters(path: int, count: int, strip: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strip, mask and shift of each child of the node ``path``."""
    rng = np.random.default_rng([path, 77])
    picks = np.argsort(rng.random((count, 64)), axis=1)[:, :sample].astype(np.uint64)
    masks = np.bitwise_or.reduce(np.uint64(1) << picks, axis=1)
    words = BITS // 64
    strips = np.arange(count) % words if strip < 0 else (strip + 1 + np.arange(count) % (words - 1)) % words
    return strips, masks, rng.integers(0, 2**64, count, dtype=np.uint64)


def _child(path: int, j: int) -> int:
    return int(mix(np.array([path], np.uint64) * np.uint64(1_000_003) + np.uint64(j + 1))[0] >> np.uint64(1))


def _descend(fp: np.ndarray, rows: np.ndarray, path: int, strip: int, plan: dict, depth: int, stop: int):
    """(path, strip, rows) of every list at depth ``stop`` below this node that has any rows."""
    if depth == stop:
        yield path, strip, rows
        return
    for j, (s, mask, shift) in enumerate(zip(*_filters(path, plan["filters"][depth], strip, plan["kinds"][depth][0]), strict=True)):
        own = rows[np.bitwise_count((fp[rows, s] ^ shift) & mask) <= plan["kinds"][depth][1]]
        if len(own):
            yield from _descend(fp, own, _child(path, j), int(s), plan, depth + 1, stop)


def _near(x: np.ndarray, y: np.ndarray, distance: int):
    """(i, j) with x[i] and y[j] within ``distance``, by brute force in tiles."""
    for a in range(0, len(x), 256):
        for b in range(0, len(y), 8192):
            u, v = x[a : a + 256], y[b : b + 8192]
            d = np.bitwise_count(u[:, None, 0] ^ v[None, :, 0])
            for w in range(1, BITS // 64 - 1):
                d += np.bitwise_count(u[:, None, w] ^ v[None, :, w])
            i, j = np.nonzero(d <= distance)
            ok = d[i, j].astype(np.int64) + np.bitwise_count(u[i, -1] ^ v[j, -1]) <= distance
            yield i[ok] + a, j[ok] + b


def near_in(fp: np.ndarray, distance: int = DISTANCE) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of a leaf within ``distance``, by brute force."""
    out = []
    for a in range(0, len(fp), 256):
        for i, j in _near(fp[a : a + 256], fp[a:], distance):
            later = j > i
            out.append((i[later] + a, j[later] + a))
    return out


def _from(fp: np.ndarray, one: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp ^ one).sum(1).astype(np.int64)


def join_leaf(fp: np.ndarray, rows: np.ndarray, label: np.ndarray, distance: int = DISTANCE, leaf: int = LEAF) -> None:
    """Join in ``label`` the groups that the near pairs of ``rows`` form; no pair inside a large group is looked at again.

    Rows of groups of more than ``leaf`` rows are crowds. The others are compared with all of them and
    with the crowds, a block at a time, after which the crowds that grew are set aside. A row x and
    a crowd with centre p can have a near pair only with members y of d(y, p) >= d(x, p) - distance.
    """
    crowds: dict[int, list] = {}
    loose = rows

    def set_aside() -> None:
        nonlocal loose
        if len(loose) <= leaf:
            return
        at, inverse, size = np.unique(label[loose], return_inverse=True, return_counts=True)
        big = size > leaf
        if not big.any():
            return
        for g in np.flatnonzero(big):
            own = loose[inverse == g]
            d = _from(fp[own], fp[own[0]])
            order = np.argsort(-d, kind="stable")
            crowds[len(crowds)] = [own[order], d[order], own[0]]
        loose = loose[~big[inverse]]

    def meet(some: np.ndarray, crowd: list) -> None:
        members, far, centre = crowd
        d = _from(fp[some], fp[centre])
        order = np.argsort(d, kind="stable")
        some, d = some[order], d[order]
        for a in range(0, len(some), 256):
            part = some[a : a + 256]
            reach = int(np.searchsorted(-far, distance - int(d[a]), side="right"))
            for b in range(0, reach, 8192):
                for i, j in _near(fp[part], fp[members[b : min(reach, b + 8192)]], distance):
                    _merge(label, part[i], members[b + j])

    set_aside()
    while len(loose):
        some = loose[:256]
        for i, j in _near(fp[some], fp[loose], distance):
            _merge(label, some[i], loose[j])
        for crowd in list(crowds.values()):
            meet(some, crowd)
        set_aside() if len(crowds) or len(loose) > 2 * leaf else None
        # rows of the block that were set aside in a crowd are compared as its members
        loose = loose[np.isin(loose, some, invert=True)]
    crowd_list = list(crowds.values())
    for k, one in enumerate(crowd_list):
        for other in crowd_list[:k]:
            if label[one[2]] != label[other[2]]:
                meet(*((one[0], other) if len(one[0]) < len(other[0]) else (other[0], one)))


def _merge(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Let ``label`` hold the least member of each group when the pairs are joined too."""
    while True:
        a, b = label[u], label[v]
        differ = a != b
        if not differ.any():
            return
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def list_edges(ids: np.ndarray, fp: np.ndarray, path: int, strip: int, plan: dict, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (least id, member) of the groups that near pairs found in this list form."""
    order = np.argsort(ids, kind="stable")
    ids, fp = ids[order], np.ascontiguousarray(fp[order])
    label = np.arange(len(ids))
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for _, _, rows in _descend(fp, np.arange(len(ids)), path, strip, plan, plan["before"], plan["levels"]):
        if len(rows) > 2 * LEAF:
            join_leaf(fp, rows, label, distance)
            continue
        for i, j in near_in(fp[rows], distance):
            if len(i):
                held.append((rows[i], rows[j]))
                size += len(i)
        if size > 1 << 20:
            _merge(label, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
            held, size = [], 0
    if held:
        _merge(label, np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
    member = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[member]], ids[member]


def _matrix(fps) -> np.ndarray:
    return np.frombuffer(b"".join(fps.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def near_edges(nodes: DataFrame, n: int, distance: int = DISTANCE, target: float = TARGET) -> DataFrame:
    """(u, v) edges whose components are the groups of near fingerprints of ``nodes(node, fp)``."""
    plan = search_plan(n, target, distance)

    def lists(batches):
        for batch in batches:
            fp, ids = _matrix(batch.column("fp")), batch.column("node")
            held: list[tuple[int, int, np.ndarray]] = []
            size = 0

            def rows_of(held):
                take = pa.array(np.concatenate([r for _, _, r in held]))
                n = [len(r) for _, _, r in held]
                return pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([p for p, _, _ in held], np.int64), n)), pa.array(np.repeat(np.array([s for _, s, _ in held], np.int32), n)), ids.take(take), batch.column("fp").take(take)], names=["path", "strip", "node", "fp"])  # noqa: B023

            for found in _descend(fp, np.arange(len(fp)), 0, -1, plan, 0, plan["before"]):
                held.append(found)
                size += len(found[2])
                if size > 1 << 15:
                    yield rows_of(held)
                    held, size = [], 0
            if held:
                yield rows_of(held)

    def find(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        u, v = list_edges(t.column("node").to_numpy(), _matrix(t.column("fp")), t.column("path")[0].as_py(), t.column("strip")[0].as_py(), plan, distance)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    spread = nodes.select("node", "fp").mapInArrow(lists, "path long, strip int, node long, fp binary")
    return spread.groupBy("path").applyInArrow(find, "u long, v long")


def near_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE, target: float = TARGET) -> DataFrame:
    """The rows that stay, with the columns of ``docs``."""
    removed, several = near_rows(docs, text, key, distance, target)
    k, h, k2, h2 = fresh(docs, "key", "hash", "key_of", "hash_of")
    marked = docs.withColumn(k, ref(key)).withColumn(h, F.xxhash64(ref(text)))
    gone, more = (x.select(F.col("k").alias(k2), F.col("h").alias(h2)) for x in (removed, several))
    on = F.col(k).eqNullSafe(F.col(k2)) & (F.col(h) == F.col(h2))
    out = join_checked(marked, gone.unionByName(more), on, "left_anti")
    if more.count():
        once = join_checked(marked, more, on, "left_semi").dropDuplicates([k, h])
        out = out.unionByName(once)
    return out.select(*map(ref, docs.columns))


def near_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", distance: int = DISTANCE, target: float = TARGET) -> tuple[DataFrame, DataFrame]:
    """(k, h) of the rows to remove, and of the rows to keep once though they occur several times."""
    sign = F.arrow_udf(fingerprints, "binary")
    rows = cut(docs.select(ref(key).alias("k"), F.xxhash64(ref(text)).alias("h"), sign(ref(text)).alias("fp")).filter(F.col("fp").isNotNull()))
    # the least row of each fingerprint, then of each group: sums that combine where the rows are
    least = F.min(F.struct(F.col("k").isNull().alias("none"), F.col("k").alias("fk"), F.col("h").alias("fh")))
    nodes = cut(rows.groupBy("fp").agg(least.alias("least"), F.count(F.lit(1)).alias("n")).withColumn("node", F.monotonically_increasing_id()))
    group = cut(components(near_edges(nodes, nodes.count(), distance, target).distinct()))
    placed = join_checked(nodes, group, "node", "left").filter("root is not null or n > 1").select("fp", "least", F.coalesce("root", "node").alias("root"))
    stays = placed.groupBy("root").agg(F.min("least").alias("stays"))
    several = cut(placed.join(stays, "root").select("fp", "stays.fk", "stays.fh"))
    same = F.col("k").eqNullSafe(F.col("fk")) & (F.col("h") == F.col("fh"))
    met = cut(join_checked(rows, several, "fp", "inner").groupBy("k", "h", same.alias("same")).agg(F.count(F.lit(1)).alias("n")))
    return met.filter("not same").select("k", "h"), met.filter("same and n > 1").select("k", "h")
