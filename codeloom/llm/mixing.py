"""Mixing sources to target weights by balanced sampling with the cube method.

Targets: every source has a weight (given, or its share of tokens to the power ``ALPHA``); a budget
of tokens is divided by the weights, and what a source lacks goes to the others (water-filling).
A document's inclusion probability is its source's target over its source's tokens.

Flight: inside a group the fractional probabilities move along a random-signed vector of the null
space of the two constraints (documents, tokens) of three units until one of them reaches 0 or 1, which
the next unit then replaces; so both totals stay exact and at most two units stay fractional. Groups
are buckets of one source, of about ``GROUP`` units, flown in parallel; what they leave over is
flown again source by source, in as many rounds as needed. Landing: the at most two units left in
each source form one small problem, which keeps the documents of each source, then the overall
totals, and drops the token constraint only for the last units.

Only (source, id, text hash, token count) moves; the decisions are joined back to the rows.

Defined results: rows equal in source, id and text are one unit and share its decision. Null and
empty texts have 0 tokens; they take part with their documents' count. A source of 0 tokens is kept
whole. A null source is a source of its own; with given weights a source that has none is dropped.
An empty table stays empty. Extra columns pass through under any name. The result depends on the
rows and the seed only, not on their order or partitions.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import cut, fresh, join_checked, n_words, ref

ALPHA = 0.7
BUDGET = 0.8
GROUP = 50_000
SEED = 17
_EPS = 1e-9


def targets(tokens: dict, weights: dict | None = None, alpha: float = ALPHA, budget: float = BUDGET) -> dict:
    """Inclusion probability by source. ``tokens``: source to token total."""
    total = sum(tokens.values())
    w = {s: float(weights.get(s, 0)) if weights is not None else t**alpha for s, t in tokens.items()}
    left, open_, out = budget * total, {s for s, t in tokens.items() if w[s] > 0 and t > 0}, {}
    while open_:
        each = left / sum(w[s] for s in open_)
        full = {s for s in open_ if each * w[s] >= tokens[s]}
        if not full:
            break
        out |= dict.fromkeys(full, 1.0)
        left -= sum(tokens[s] for s in full)
        open_ -= full
    out |= {s: max(0.0, left) * w[s] / sum(w[x] for x in open_) / tokens[s] for s in open_}
    keep_empty = lambda s: 1.0 if weights is None or w[s] > 0 else 0.0
    return {s: out.get(s, keep_empty(s) if tokens[s] == 0 else 0.0) for s in tokens}


def flight(pi: np.ndarray, a: np.ndarray, b: np.ndarray | None, rng: np.random.Generator) -> np.ndarray:
    """Move ``pi`` until at most two units (one, without ``b``) are fractional.

    The sums of pi*a and of pi*b stay as they are.
    """
    pi = pi.astype(float).copy()
    todo = np.flatnonzero((pi > _EPS) & (pi < 1 - _EPS)).tolist()
    size = 3 if b is not None else 2
    p, x = pi.tolist(), a.astype(float).tolist()
    y = b.astype(float).tolist() if b is not None else None
    window, at = todo[:size], size
    draws, d = rng.random(len(todo) + 8).tolist(), 0
    while len(window) == size:
        if y is None:
            i, j = window
            u = (x[j], -x[i])
        else:
            i, j, k = window
            u = (x[j] * y[k] - x[k] * y[j], x[k] * y[i] - x[i] * y[k], x[i] * y[j] - x[j] * y[i])
            if abs(u[0]) + abs(u[1]) + abs(u[2]) < _EPS:
                u = (x[j], -x[i], 0.0)
        up = down = float("inf")
        for c, i in zip(u, window, strict=True):
            if c > 0:
                up, down = min(up, (1 - p[i]) / c), min(down, p[i] / c)
            elif c < 0:
                up, down = min(up, p[i] / -c), min(down, (1 - p[i]) / -c)
        if d >= len(draws):
            draws, d = rng.random(len(todo) + 8).tolist(), 0
        step = up if draws[d] * (up + down) < down else -down
        d += 1
        nearest, best = None, 2.0
        for c, i in zip(u, window, strict=True):
            if c:
                p[i] += step * c
                gap = min(abs(p[i]), abs(1 - p[i]))
                if gap < best:
                    nearest, best = i, gap
        p[nearest] = float(round(p[nearest]))
        kept = []
        for i in window:
            if _EPS < p[i] < 1 - _EPS:
                kept.append(i)
            else:
                p[i] = float(round(p[i]))
        while len(kept) < size and at < len(todo):
            kept.append(todo[at])
            at += 1
        window = kept
    return np.array(p)


def landing(source: np.ndarray, m: np.ndarray, t: np.ndarray, pi: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """All of ``pi`` to 0 or 1: documents of each source, then both totals, then documents alone."""
    pi = pi.astype(float).copy()
    for s in np.unique(source):
        own = np.flatnonzero(source == s)
        pi[own] = flight(pi[own], m[own], None, rng)
    pi = flight(pi, m, t, rng)
    pi = flight(pi, m, None, rng)
    last = (pi > _EPS) & (pi < 1 - _EPS)
    pi[last] = rng.random(last.sum()) < pi[last]
    return np.round(pi)


_UNIT = "s long, k string, h long, m long, t long, pi double"


def _fly(seed: int, land: bool):
    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in ("s", "h", "m", "t", "pi", "r")}
        order = np.lexsort((col["h"], col["r"]))
        col = {c: v[order] for c, v in col.items()}
        rng = np.random.default_rng([seed, int(col["r"][0]) & (2**63 - 1), len(order)])
        pi = landing(col["s"], col["m"], col["t"], col["pi"], rng) if land else flight(col["pi"], col["m"], col["t"], rng)
        table = table.take(pa.array(order)).select(["s", "k", "h", "m", "t"])
        return table.append_column("pi", pa.array(pi))

    return run


def sample_units(units: DataFrame, chances: dict, numbered: DataFrame, seed: int = SEED, group: int = GROUP) -> DataFrame:
    """Units (s, k, h, m, t) with pi 0.0 or 1.0; ``chances``: number of a source to (pi, units)."""
    todo = cut(join_checked(units, numbered, "s", "inner").withColumn("r", F.xxhash64(F.lit(seed), "s", "k", "h")))
    fixed = [todo.filter("pi <= 0 or pi >= 1").select("s", "k", "h", "m", "t", "pi")]
    todo = todo.filter("pi > 0 and pi < 1")
    largest = max((n for p, n in chances.values() if 0 < p < 1), default=0)
    while largest > 0:
        buckets = ceil(largest / group)
        # a source of n units is split into about n / group buckets
        spread = F.expr(f"pmod(xxhash64(r), greatest(1, cast(ceil(n / {group}) as int)))")
        flown = cut(todo.withColumn("g", spread).groupBy("s", "g").applyInArrow(_fly(seed, False), _UNIT))
        fixed.append(flown.filter("pi <= 0 or pi >= 1"))
        todo = flown.filter("pi > 0 and pi < 1").withColumn("r", F.xxhash64(F.lit(seed + 1), "s", "k", "h"))
        if buckets == 1:
            break
        todo = join_checked(todo, cut(todo.groupBy("s").agg(F.count(F.lit(1)).alias("n"))), "s", "inner")
        largest = 2 * buckets
    if largest > 0:
        fixed.append(todo.withColumn("g", F.lit(0)).groupBy("g").applyInArrow(_fly(seed + 2, True), _UNIT))
    out = fixed[0]
    for x in fixed[1:]:
        out = out.unionByName(x)
    return out


def mix_sources(docs: DataFrame, weights: dict | None = None, alpha: float = ALPHA, budget: float = BUDGET, seed: int = SEED, group: int = GROUP, text: str = "text", key: str = "doc_id", source: str = "source", tokens: Column | None = None) -> DataFrame:
    """The sampled rows, with the columns of ``docs``."""
    count = n_words(ref(text)) if tokens is None else tokens.cast("long")
    narrow = docs.select(ref(source).cast("string").alias("src"), ref(key).cast("string").alias("k"), F.xxhash64(ref(text)).alias("h"), count.alias("n"))
    units = cut(narrow.groupBy("src", "k", "h").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("t")))
    found = sorted((tuple(r) for r in units.groupBy("src").agg(F.sum("t"), F.count(F.lit(1))).collect()), key=lambda r: (r[0] is None, r[0]))
    pi = targets({s: t for s, t, _ in found}, weights, alpha, budget)
    spark = docs.sparkSession
    numbered = spark.createDataFrame([(i, s, pi[s], n) for i, (s, _, n) in enumerate(found)], "s long, src string, pi double, n long")
    coded = join_checked(units, numbered.select("s", F.col("src").alias("src2")), F.col("src").eqNullSafe(F.col("src2")), "inner").select("s", "k", "h", "m", "t")
    decided = sample_units(coded, {i: (pi[s], n) for i, (s, _, n) in enumerate(found)}, numbered.select("s", "pi", "n"), seed, group)
    a, b, c, d, e, g = fresh(docs, "src", "key", "hash", "src2", "key2", "hash2")
    dropped = cut(join_checked(decided.filter("pi < 0.5"), numbered.select("s", F.col("src").alias(d)), "s", "inner").select(d, F.col("k").alias(e), F.col("h").alias(g)))
    marked = docs.withColumn(a, ref(source).cast("string")).withColumn(b, ref(key).cast("string")).withColumn(c, F.xxhash64(ref(text)))
    on = F.col(a).eqNullSafe(F.col(d)) & F.col(b).eqNullSafe(F.col(e)) & (F.col(c) == F.col(g))
    return join_checked(marked, dropped, on, "left_anti").select(*map(ref, docs.columns))
