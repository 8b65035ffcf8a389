import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import lm_score as L
from codeloom.llm import wavelet as W
from codeloom.llm.vector_text import word_hashes


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=1500), st.integers(0, 5))
def test_wavelet_matrix_against_brute_force(ids, seed):
    a = np.array(ids, np.uint16)
    w = W.WaveletShard(W.build(a, 9, ["x"], np.array([len(a)])))
    assert (w.access(np.arange(len(a))) == a).all()
    for c in {*ids[:5], 299, seed}:
        where = np.flatnonzero(a == c)
        assert w.count(c) == len(where) and (w.occurrences(c) == where).all()
        for end in (0, len(a) // 2, len(a)):
            assert w.rank(c, end) == (a[:end] == c).sum()
        if len(where):
            assert w.select(c, len(where) - 1) == where[-1]
    assert w.count(5000) == 0


def test_bad_positions():
    w = W.WaveletShard(W.build(np.array([1, 2], np.uint16), 4, ["a"], np.array([2])))
    with pytest.raises(IndexError):
        w.access([2])
    with pytest.raises(IndexError):
        w.select(3, 0)
    with pytest.raises(ValueError):
        W.WaveletShard(b"other file")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sZ1. \n\té,   　"), max_size=40))
def test_encoder_is_exact(text):
    e = W.encoder(*W.default_vocabulary())
    assert e(text).tolist() == e.plain.encode_ordinary(text)


def test_shards_round_trip(edge, nothing):
    e = W.encoder(*W.default_vocabulary())
    rows = W.write_shards(edge, shard_tokens=300).collect()
    got = Counter()
    for r in rows:
        w = W.WaveletShard(r.data)
        assert r.n_tokens == w.n and r.n_docs == len(w.keys)
        for i, k in enumerate(w.keys):
            got[k, tuple(w.document(i).tolist())] += 1
    want = Counter((None if r.doc_id is None else str(r.doc_id), tuple(e(r.text).tolist())) for r in edge.collect())
    assert got == want and len(rows) > 3
    assert W.write_shards(nothing).count() == 0
    token = int(e("the of")[0])
    total = sum(r["count"] for r in W.find_token(W.write_shards(edge, shard_tokens=300), token).collect())
    assert total == sum(k[1].count(token) * n for k, n in want.items())


def test_other_patterns_are_given_to_the_tokeniser_whole():
    path, _ = W.default_vocabulary()
    for pattern in (r"[a-z]+ [a-z]+|[\s\S]", r"\S+\s?|\s+"):
        e = W.Encoder(path, pattern)
        for text in ("one two three, four.", "a  b", "x"):
            assert e(text).tolist() == e.plain.encode_ordinary(text)


def test_hashes_of_very_long_words():
    """Words that swap bytes 1,024 or 2,048 apart differ; equal ones don't."""
    base = bytearray(b"a" * 5000)
    words = [bytes(base)]
    for i in (10, 10 + 1024, 10 + 2048, 10 + 4096):
        w = bytearray(base)
        w[i] = ord("b")
        words.append(bytes(w))
    data = b" ".join([*words, words[2]])
    h, _ = word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert len(set(h.tolist())) == 5 and h[2] == h[5]


def brute_scores(texts, alpha=L.ALPHA, least=L.LEAST):
    docs = [re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    grams = [Counter(tuple(d[i : i + n]) for d in docs for i in range(len(d) - n + 1)) for n in (1, 2, 3)]
    total = sum(grams[0].values())
    out = []
    for d in docs:
        s = 0.0
        for i in range(len(d)):
            for n in range(min(i, 2), -1, -1):
                g = tuple(d[i - n : i + 1])
                c = grams[n][g]
                if n == 0:
                    s += math.log(c / total)
                elif c >= least:
                    s += math.log(c / grams[n - 1][g[:-1]])
                    break
                else:
                    s += math.log(alpha)
        out.append((len(d), s))
    return out


@pytest.mark.parametrize("block_words,partition_grams,fan", [(L.BLOCK_WORDS, L.PARTITION_GRAMS, L.FAN), (100, 500, L.FAN), (100, 6000, 6), (100, 9000, 3)])
def test_scores_against_brute_force(edge, block_words, partition_grams, fan):
    rows = [r for r in edge.collect()]
    want = Counter((r.doc_id, n, round(s, 2)) for r, (n, s) in zip(rows, brute_scores([r.text for r in rows]), strict=True))
    got = Counter((r.doc_id, r.n_words, round(r.log_score, 2)) for r in L.lm_scores(edge, block_words=block_words, partition_grams=partition_grams, fan=fan).collect())
    close = lambda a: sorted(((i is None, i or 0, n, s) for (i, n, s), c in a.items() for _ in range(c)))
    a, b = close(want), close(got)
    assert len(a) == len(b) and all(x[:3] == y[:3] and abs(x[3] - y[3]) <= 0.011 for x, y in zip(a, b, strict=True))


def test_scores_edges(edge, nothing):
    for r in L.lm_scores(edge).collect():
        assert (r.mean_log_score is None) == (r.n_words == 0) and (r.n_words or r.log_score == 0)
    assert L.lm_scores(nothing).count() == 0


def test_fragments_grow_with_the_input():
    """By computation at 1 GB to 100 TB: fragments a word and what one group gathers have a bound."""
    for gb in (1, 10, 100, 1_000, 10_000, 100_000):
        words = 160_000_000 * gb
        blocks = math.ceil(words / L.BLOCK_WORDS)
        depth, width = L.levels(words, L.PARTITION_GRAMS, L.FAN)
        sizes = L.teams(blocks, words, L.PARTITION_GRAMS, depth, width)
        assert width <= L.FAN and width**depth * L.PARTITION_GRAMS >= L.ORDERS * words and depth <= 3
        made = gathered = 0
        each = blocks  # columns in one partition of the level before
        for k, size in enumerate([*sizes, 1]):
            made += L.ORDERS * each * width**k * width
            gathered = max(gathered, each / size)
            each = size
        assert made <= 2 * depth * L.ORDERS * L.FAN * blocks and gathered <= L.FAN
