"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Every source is a queue of its documents' tokens, ordered by id. A window of ``WINDOW`` tokens gives
each source a quantum of its weight's share; what a source is owed or has been served too much (less
than a token) is carried to the next window, so that after k windows source i has been served
floor(k W P_i) - floor(k W P_(i-1)) tokens, P being the running sum of the weights. This is what
deficit round-robin with a carried deficit serves, and it is a formula: each document finds its
windows from its queue offset alone. Offsets are prefix sums carried across partitions; only
(source, id, token count) is sorted and shuffled.

When a source runs dry its part of that window goes to the others, and the next windows divide their
tokens among the sources that are left. There are at most as many such changes as sources; the driver
works them out from one total a source.

A result row is a run of tokens of one document in one window: (window_id, position, source, key,
doc_start, n_tokens). Every window but the last is full; documents are cut where windows end.

Defined results: null and empty texts have no tokens and no rows; a null source is a queue of its
own; null ids come first in their queue; rows of one id are ordered by text hash, repeated rows
are packed as often as they occur. Sources of weight 0 are not packed. An empty table gives no rows.
Other columns are not read and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import cut, join_checked, n_words, ref

WINDOW = 4096
#: Target proportions of the registered query: token shares to this power, which lifts small sources.
ALPHA = 0.7
#: Weights are whole numbers of 1/UNIT.
UNIT = 1 << 30


def served(k: int, window: int, low: int, high: int) -> int:
    """Tokens that a source with weight from ``low`` to ``high`` has got after k windows."""
    return k * window * high // UNIT - k * window * low // UNIT


def phases(totals: list[int], weights: list[float], window: int = WINDOW) -> list[tuple]:
    """(source, first window, windows, queue start, queue end, low, high, position) rows.

    Rows of many windows follow the formula with weight bounds low and high; a row with position >= 0
    is one window's run starting there.
    """
    left, done, rows, first = list(totals), [0] * len(totals), [], 0
    while True:
        active = [i for i, n in enumerate(left) if n > 0 and weights[i] > 0]
        if not active:
            return rows
        whole, run, bounds = sum(weights[i] for i in active), 0.0, {}
        for i in active:
            low = min(UNIT, int(run / whole * UNIT))
            run += weights[i]
            bounds[i] = (low, UNIT if i == active[-1] else min(UNIT, int(run / whole * UNIT)))
        lo, hi = 0, sum(left[i] for i in active) // window + 1
        while lo < hi:  # the most windows that every active source can serve
            mid = (lo + hi + 1) // 2
            if all(served(mid, window, *bounds[i]) <= left[i] for i in active):
                lo = mid
            else:
                hi = mid - 1
        k = lo
        if k:
            for i in active:
                n = served(k, window, *bounds[i])
                if n:
                    rows.append((i, first, k, done[i], done[i] + n, *bounds[i], -1))
                    done[i], left[i] = done[i] + n, left[i] - n
            first += k
        own = {i: min(left[i], served(k + 1, window, *bounds[i]) - served(k, window, *bounds[i])) for i in active}
        short = window - sum(own.values())
        while short > 0 and any(left[i] > own[i] for i in active):
            able = [i for i in active if left[i] > own[i]]
            share, part = short, sum(weights[i] for i in able)
            for i in able:
                more = min(left[i] - own[i], short, max(1, int(share * weights[i] / part)))
                own[i], short = own[i] + more, short - more
        at = 0
        for i in active:
            if own[i]:
                rows.append((i, first, 1, done[i], done[i] + own[i], 0, 0, at))
                at, done[i], left[i] = at + own[i], done[i] + own[i], left[i] - own[i]
        first += 1


def pack(docs: DataFrame, weights: dict | None = None, window: int = WINDOW, alpha: float = 1.0, text: str = "text", key: str = "doc_id", source: str = "source", tokens: Column | None = None) -> DataFrame:
    """The runs of all windows. Without ``weights`` a source's weight is its number of tokens to the power ``alpha``."""
    spark = docs.sparkSession
    count = n_words(ref(text)) if tokens is None else tokens.cast("long")
    narrow = docs.select(ref(source).cast("string").alias("src"), ref(key).alias("k"), F.xxhash64(ref(text)).alias("h"), count.alias("n")).filter("n > 0")
    # written first, as the sampling of the ranges would count the words a second time
    parts = cut(cut(narrow).repartitionByRange("src", "k", "h").sortWithinPartitions("src", "k", "h").withColumn("p", F.spark_partition_id()))
    sums = parts.groupBy("src", "p").agg(F.sum("n").alias("n")).collect()
    found = sorted((tuple(r) for r in sums), key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    names, totals, offsets = [], [], []
    for s, p, n in found:
        if not names or names[-1] != s:
            names.append(s)
            totals.append(0)
        offsets.append((len(names) - 1, s, p, totals[-1]))
        totals[-1] += n
    w = [float(n) ** alpha for n in totals] if weights is None else [float(weights.get(s, 0)) for s in names]
    at = spark.createDataFrame(offsets, "i int, s string, p2 int, base long")
    plan = spark.createDataFrame(phases(totals, w, window), "i int, first long, k long, q0 long, q1 long, low long, high long, pos long")
    running = F.sum("n").over(Window.partitionBy("p", "src").orderBy("k", "h").rowsBetween(Window.unboundedPreceding, 0))
    placed = join_checked(parts.withColumn("own", running), at, F.col("src").eqNullSafe(F.col("s")) & (F.col("p") == F.col("p2")), "inner")
    queue = placed.select("i", "src", F.col("k").alias("id"), "n", (F.col("base") + F.col("own") - F.col("n")).alias("o"))
    met = join_checked(queue, plan, "i", "inner").filter("o < q1 and o + n > q0")
    met = met.withColumn("lo", F.expr("greatest(o, q0) - q0")).withColumn("hi", F.expr("least(o + n, q1) - q0"))
    per = F.expr(f"(high - low) * {float(window) / UNIT!r}")
    guess = lambda c, d: F.least(F.greatest(F.floor((F.col(c) + d) / per) + d, F.lit(0)), F.col("k") - 1)
    many = met.filter("pos < 0").withColumn("j", F.explode(F.sequence(guess("lo", -2), guess("hi", 2))))
    for c in ("low", "high"):  # floor(j W c / UNIT) without overflow
        for d, name in ((0, f"{c}0"), (1, f"{c}1")):
            jw = f"((j + {d}) * {window})"
            many = many.withColumn(name, F.expr(f"({jw} div {UNIT}) * {c} + (({jw} % {UNIT}) * {c}) div {UNIT}"))
    many = many.withColumn("a", F.expr("high0 - low0")).withColumn("b", F.expr("high1 - low1"))
    many = many.withColumn("x", F.greatest("lo", "a")).withColumn("y", F.least("hi", "b")).filter("x < y")
    run = many.select(F.expr("first + j").alias("window_id"), F.expr("low1 - low0 + x - a").alias("position"), "src", "id", F.expr("q0 + x - o").alias("doc_start"), F.expr("y - x").alias("n_tokens"))
    single = met.filter("pos >= 0").select(F.col("first").alias("window_id"), F.expr("pos + lo").alias("position"), "src", "id", F.expr("q0 + lo - o").alias("doc_start"), F.expr("hi - lo").alias("n_tokens"))
    return run.unionByName(single).withColumnRenamed("src", source).withColumnRenamed("id", key)
