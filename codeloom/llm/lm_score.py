"""LM scoring: stupid-backoff scores from n-gram counts of the whole corpus.

For word i with the words before it (a, b, c the last three, S over what context the text has):

    S = c(abc)/c(ab) if the trigram is in its table, else alpha * S(c | b)
    S(c | b) = c(bc)/c(b) if the bigram is in its table, else alpha * c(c)/N

The tables hold the counts over all documents; bigrams and trigrams seen fewer than ``LEAST`` times are
left out, so a text's own singletons back off. A document's score is the sum of ln S over its words.

The computation is relational: explode documents into n-grams, group them into count tables
partitioned by hash, join the counts back to the n-grams, sum by document. At hundreds of millions
of n-grams a row each costs more to move than its content, so the relations are kept in blocks: a
row holds the n-grams of about ``BLOCK_WORDS`` words in one hash partition, as a sorted column of
56-bit hashes. Grouping and joining are merges of sorted columns inside a partition.

1. Documents become blocks of word hashes (whole texts, where they are read), written once.
2. Each block's distinct n-grams of orders 1 to 3 go to their hash partitions with their counts.
3. A partition adds up the counts of each n-gram: that is its part of the count tables. It
   answers each block with the totals of the block's n-grams, in the same order.
4. Each block joins the totals to its words and sums by document.

A column is cut into at most ``FAN`` fragments. A corpus that needs more partitions gets them in levels:
the fragments of a team of blocks in one coarse partition are added up to one column, which is cut
again, and the totals come back the same way. So fragments grow with the input, not with its square:
at most 3 * FAN a block and level; levels grow with the logarithm (one to 1.4 * 10^9 words, two
to 1.5 * 10^12). What is moved is about 5 bytes a distinct n-gram of a column at each level.

With ``least`` = 1 each text's own singletons would have count 1 after a context of count 1, S = 1: the
model would praise what it has seen nowhere else. Hence 2.

Defined results: words are runs of ASCII letters and digits and of other than ASCII characters, in
lower case. Null texts and texts without words have 0 words, log_score 0 and a null mean; null and
repeated ids are kept, a row each; equal texts have equal scores. An empty table gives no rows. Only
the key and text columns are read; others may have any name.
"""

from __future__ import annotations

from math import ceil, log

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.llm.common import cut, ref
from codeloom.llm.vector_text import blocks, mix, word_hashes

ALPHA = 0.4
LEAST = 2
ORDERS = 3
BLOCK_WORDS = 2 << 20
#: N-grams that a hash partition is expected to receive.
PARTITION_GRAMS = 4 << 20
#: Fragments that a column is cut into at most.
FAN = 1024
_BITS = 56
_FRAGMENT = "part long, block long, n int, hashes binary, counts binary"
_ANSWER = "part long, block long, n int, totals binary"


def _squeeze(x: np.ndarray, kind: str) -> bytes:
    """A column of integers by byte planes."""
    x = np.ascontiguousarray(x.astype(kind))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()) if len(x) else b""


def _expand(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(raw.T).reshape(-1).view(kind)


def document_blocks(docs: DataFrame, text: str, key: str, block_words: int) -> DataFrame:
    """(block, keys, words, lengths, table, ids): word hashes of runs of documents."""
    kind = docs.schema[key].dataType

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        keys: list = []
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        total = 0

        def row():
            h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            order = np.argsort(h)
            new = np.r_[True, h[order][1:] != h[order][:-1]] if len(h) else np.zeros(0, bool)
            table = h[order][new]
            often = np.diff(np.r_[np.flatnonzero(new), len(h)])
            rank = np.argsort(-often, kind="stable")  # frequent words get small numbers
            place = np.empty(len(table), np.uint32)
            place[rank] = np.arange(len(table), dtype=np.uint32)
            ids = np.empty(len(h), np.uint32)
            ids[order] = place[np.cumsum(new) - 1] if len(h) else 0
            lengths = np.concatenate(sizes)
            return pa.RecordBatch.from_arrays([pa.array([part << 32 | number], pa.int64()), pa.array([pa.concat_arrays(keys)], pa.list_(keys[0].type)), pa.array([len(h)], pa.int64()), *(pa.array([_squeeze(x, k)], pa.binary()) for x, k in ((lengths, "<u4"), (table[rank], "<u8"), (ids, "<u4")))], names=["block", "keys", "words", "lengths", "table", "ids"])

        for batch in batches:
            for first, data, off in blocks(batch.column(1)):
                h, bound = word_hashes(data, off)
                keys.append(batch.column(0).slice(first, len(off) - 1))
                hashes.append(h >> np.uint64(64 - _BITS))
                sizes.append(np.diff(bound))
                total += len(h)
                if total >= block_words:
                    yield row()
                    keys, hashes, sizes, total, number = [], [], [], 0, number + 1
        if keys:
            yield row()

    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(kind)), T.StructField("words", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("lengths", "table", "ids"))])
    return docs.select(ref(key).alias("k"), ref(text).cast("string").alias("t")).mapInArrow(run, schema)


def _grams(table: bytes, ids: bytes, lengths: bytes):
    """Position in its text of each word, and for each order the hashes at the words that end one."""
    h = _expand(table, "<u8")[_expand(ids, "<u4")]
    n = _expand(lengths, "<u4").astype(np.int64)
    start = np.cumsum(n) - n
    pos = np.arange(len(h)) - np.repeat(start, n)
    out, now = [(np.arange(len(h)), h)], h
    for order in range(2, ORDERS + 1):
        at = np.flatnonzero(pos >= order - 1)
        grown = np.zeros(len(h), np.uint64)
        # the hash of the words before, at the word before, with this word
        grown[at] = mix(now[at - 1] * np.uint64(0xD6E8FEB86659FD93) + h[at], order) >> np.uint64(64 - _BITS)
        out.append((at, grown[at]))
        now = grown
    return pos, n, out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = np.sort(x)
    first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.r_[first, len(s)])


def _fragments(column: int, order: int, u: np.ndarray, c: np.ndarray, first: int, last: int, parts: int) -> pa.RecordBatch | None:
    """The pieces of a sorted column in hash partitions ``first`` to ``last`` - 1 of ``parts``."""
    cuts = np.array([(p << _BITS) // parts for p in range(first, last + 1)], np.uint64)
    edge = np.searchsorted(u, cuts)
    rows = np.flatnonzero(edge[1:] > edge[:-1])
    if not len(rows):
        return None
    lo, hi = edge[rows], edge[rows + 1]
    return pa.RecordBatch.from_arrays([
        pa.array(rows + first, pa.int64()), pa.array([column] * len(rows), pa.int64()), pa.array([order] * len(rows), pa.int32()),
        pa.array([_squeeze(np.diff(u[a:b], prepend=np.uint64(0)), "<u8") for a, b in zip(lo, hi, strict=True)], pa.binary()),
        pa.array([_squeeze(c[a:b], "<u8") for a, b in zip(lo, hi, strict=True)], pa.binary()),
    ], names=["part", "block", "n", "hashes", "counts"])


def levels(words: int, partition_grams: int, fan: int) -> tuple[int, int]:
    """(depth, width): ``width`` ** ``depth`` partitions, ``width`` of at most ``fan``, hold the n-grams of so many words."""
    parts, depth = max(1, ceil(ORDERS * words / partition_grams)), 1
    while fan**depth < parts:
        depth += 1
    width = max(1, int(parts ** (1 / depth)))
    while width**depth < parts:
        width += 1
    return depth, width


def teams(count: int, words: int, partition_grams: int, depth: int, width: int) -> list[int]:
    """How many teams add up their fragments at each level but the last; a team's column holds about ``partition_grams``."""
    out, grams = [], ORDERS * words / max(1, count)
    for _ in range(depth - 1):
        count = max(1, ceil(count * grams / width / partition_grams))
        grams = partition_grams
        out.append(count)
    return out


def block_grams(blocked: DataFrame, parts: int) -> DataFrame:
    """(part, block, n, hashes, counts): the distinct n-grams of each block by hash partition."""

    def run(batches):
        for batch in batches:
            block, _, _, lengths, table, ids = batch.columns
            for i in range(batch.num_rows):
                _, _, grams = _grams(table[i].as_py(), ids[i].as_py(), lengths[i].as_py())
                for order, (_, h) in enumerate(grams, 1):
                    u, c = _distinct(h)
                    if (out := _fragments(block[i].as_py(), order, u, c, 0, parts, parts)) is not None:
                        yield out

    return blocked.mapInArrow(run, _FRAGMENT)


def _added(t: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """The n-grams of some fragments, their counts added up, and the place of each fragment's n-grams there."""
    own = [np.cumsum(_expand(t.column("hashes")[int(r)].as_py(), "<u8"), dtype=np.uint64) for r in rows]
    table, _ = _distinct(np.concatenate(own))
    total = np.zeros(len(table), np.int64)
    at = []
    for r, h in zip(rows, own, strict=True):
        at.append(np.searchsorted(table, h).astype(np.int32))
        total[at[-1]] += _expand(t.column("counts")[int(r)].as_py(), "<u8").astype(np.int64)
    return table, total, at


def count_tables(grams: DataFrame) -> DataFrame:
    """(part, block, n, totals): corpus counts of the n-grams of each block, in its order."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        n = t.column("n").to_numpy()
        out: list[bytes] = [b""] * len(n)
        for order in np.unique(n):
            rows = np.flatnonzero(n == order)
            _, total, at = _added(t, rows)
            for r, a in zip(rows, at, strict=True):
                out[r] = _squeeze(total[a], "<u8")
        return t.select(["part", "block", "n"]).append_column("totals", pa.array(out, pa.binary()))

    return grams.groupBy("part").applyInArrow(run, _ANSWER)


def counted(grams: DataFrame, width: int, sizes: list[int], level: int = 1) -> DataFrame:
    """count_tables over partitions in levels: ``sizes`` holds the number of teams of each level but the last."""
    if level > len(sizes):
        return count_tables(grams)
    grams = grams.withColumn("team", F.pmod(F.xxhash64("block"), F.lit(sizes[level - 1])))
    parts = width ** (level + 1)

    def merge(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        n, part, team = t.column("n").to_numpy(), t.column("part")[0].as_py(), t.column("team")[0].as_py()
        out = []
        for order in np.unique(n):
            table, total, _ = _added(t, np.flatnonzero(n == order))
            out.append(_fragments(team, int(order), table, total, part * width, (part + 1) * width, parts))
        return pa.Table.from_batches(out)

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.combine_chunks()
        n, order, part = left.column("n").to_numpy(), right.column("n").to_numpy(), right.column("part").to_numpy()
        out: list[bytes] = [b""] * len(n)
        for k in np.unique(n):
            rows, back = np.flatnonzero(n == k), np.flatnonzero(order == k)
            total = np.concatenate([_expand(right.column("totals")[int(r)].as_py(), "<u8") for r in back[np.argsort(part[back])]])
            for r, a in zip(rows, _added(left, rows)[2], strict=True):
                out[r] = _squeeze(total[a], "<u8")
        return left.select(["part", "block", "n"]).append_column("totals", pa.array(out, pa.binary()))

    finer = counted(grams.groupBy("part", "team").applyInArrow(merge, _FRAGMENT), width, sizes, level + 1)
    up = finer.select(F.col("part"), F.expr(f"part div {width}").alias("coarse"), F.col("block").alias("team"), "n", "totals")
    return grams.groupBy("part", "team").cogroup(up.groupBy("coarse", "team")).applyInArrow(answer, _ANSWER)


def lm_scores(docs: DataFrame, alpha: float = ALPHA, least: int = LEAST, block_words: int = BLOCK_WORDS, partition_grams: int = PARTITION_GRAMS, fan: int = FAN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, log_score, mean_log_score) of every row."""
    kind = docs.schema[key].dataType
    blocked = cut(document_blocks(docs, text, key, block_words))
    words, number = blocked.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first()
    depth, width = levels(words, partition_grams, fan)
    totals = counted(block_grams(blocked, width), width, teams(number, words, partition_grams, depth, width))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for i in range(left.num_rows):
            pos, n, grams = _grams(left.column("table")[i].as_py(), left.column("ids")[i].as_py(), left.column("lengths")[i].as_py())
            counts = []
            order, part = right.column("n").to_numpy(), right.column("part").to_numpy()
            for k, (at, h) in enumerate(grams, 1):
                full = np.zeros(len(pos), np.int64)
                if len(h):
                    rows = np.flatnonzero(order == k)
                    rows = rows[np.argsort(part[rows])]
                    total = np.concatenate([_expand(right.column("totals")[int(r)].as_py(), "<u8") for r in rows]).astype(np.int64)
                    by = np.argsort(h)
                    s = h[by]
                    index = np.cumsum(np.r_[True, s[1:] != s[:-1]]) - 1
                    full[at[by]] = total[index]
                counts.append(full)
            one, two, three = counts
            with np.errstate(divide="ignore"):  # places where an order has no n-gram
                l1, l2, l3 = (np.log(c.astype(float)) for c in counts)
            la = log(alpha)
            s = np.minimum(pos, 2) * la + l1 - (log(words) if words else 0.0)
            b = np.flatnonzero((pos >= 1) & (two >= least))
            s[b] = (pos[b] >= 2) * la + l2[b] - l1[b - 1]
            t = np.flatnonzero((pos >= 2) & (three >= least))
            s[t] = l3[t] - l2[t - 1]
            sums, full = np.zeros(len(n)), n > 0
            if full.any():
                sums[full] = np.add.reduceat(s, (np.cumsum(n) - n)[full])
            mean = pa.array(np.divide(sums, n, out=np.zeros(len(n)), where=full).round(6), mask=~full)
            out.append(pa.table([left.column("keys").combine_chunks()[i].values, pa.array(n, pa.int64()), pa.array(sums.round(3)), mean], names=["k", "n_words", "log_score", "mean_log_score"]))
        return pa.concat_tables(out)

    schema = T.StructType([T.StructField("k", kind), T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType())])
    return blocked.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(score, schema).withColumnRenamed("k", key)


ORACLE = rf"""
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') as ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from d),
w as (select doc_id, i, ws[i] as c, case when i > 1 then ws[i - 1] end as b, case when i > 2 then ws[i - 2] end as a from p),
n as (select count(*)::double as n from w),
u as (select c as x, count(*)::double as k from w group by 1),
bi as (select b as x, c as y, count(*)::double as k from w where i > 1 group by 1, 2 having count(*) >= {LEAST}),
tri as (select a as x, b as y, c as z, count(*)::double as k from w where i > 2 group by 1, 2, 3 having count(*) >= {LEAST}),
s as (
  select doc_id, case when tri.k is not null then ln(tri.k) - ln(ab.k)
    when bi.k is not null then (case when i > 2 then ln({ALPHA}) else 0 end) + ln(bi.k) - ln(ub.k)
    else least(i - 1, 2) * ln({ALPHA}) + ln(uc.k) - ln(n.n) end as s
  from w cross join n
  join u uc on uc.x = w.c
  left join u ub on ub.x = w.b
  left join bi on bi.x = w.b and bi.y = w.c
  left join bi ab on ab.x = w.a and ab.y = w.b
  left join tri on tri.x = w.a and tri.y = w.b and tri.z = w.c)
select d.doc_id, len(ws)::bigint as n_words, coalesce(round(t.s, 3), 0.0) as log_score, round(t.s / len(ws), 6) as mean_log_score
from d left join (select doc_id, sum(s) as s from s group by 1) t on t.doc_id = d.doc_id
"""
