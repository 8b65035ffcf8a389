"""Token-ID output: one wavelet matrix per shard of documents.

Documents are tokenised where they are read (no shuffle) with a public byte-level BPE whose file is
a parameter. A shard closes at the first document that brings it to ``SHARD_TOKENS`` tokens; its
token ids are stored as a wavelet matrix: one bit-plane for each bit of an id, most significant
first, each level stably sorted by the bit before. A directory of ranks at every 512 bits gives
access, counting and occurrence lookup without decoding. Planes and directories are compressed one
by one, so a reader inflates only what it touches; ids and bounds of the documents are in the same
file.

Defined results: null and empty texts are documents without tokens; keys may be null or repeat and
are stored as given, as strings; a text longer than a shard makes a longer shard. An empty table gives no
shard. Only the key and text columns are read; others may have any name. A shard's id is its input
partition and its number there.
"""

from __future__ import annotations

import base64
import json
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import ref

SHARD_TOKENS = 4 << 20
MAGIC = b"CLWM0001"
_BLOCK = 8  # words of 64 bits to an entry of the rank directory
_CACHE = 400_000
_ENCODERS: dict[tuple[str, str], Encoder] = {}


def default_vocabulary() -> tuple[str, str]:
    """Path and pattern of the installed 50k byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


class _Pieces(dict):
    """Packed ids of a space and the piece after it; emptied when full, which changes time only."""

    def __init__(self, plain: tiktoken.Encoding, code: str):
        super().__init__()
        # the calls below the public ones, without their handling of lone surrogates
        self.whole, self.single, self.code = plain._core_bpe.encode_ordinary, plain._core_bpe.encode_single_piece, code

    def __missing__(self, piece: str) -> bytes:
        if type(piece) is tuple:  # a mark right after a word, without the space
            ids = array(self.code, self.single(piece[0].encode())).tobytes()
        elif piece.isalpha() and max(piece) < "\u0250":  # a run of letters is one match of the pattern
            ids = array(self.code, self.single((" " + piece).encode())).tobytes()
        elif piece.endswith((".", ",")) and piece[:-1].isalpha() and max(piece) < "\u0250":
            return self[piece[:-1]] + self[piece[-1:], None]
        else:
            ids = array(self.code, self.whole(" " + piece)).tobytes()
        if len(piece) <= 40:
            if len(self) >= _CACHE:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Exact ids of the tokeniser, a few times faster on running text.

    The pattern never crosses a single space between two other characters: the space opens the next
    token. So such texts are cut there and each piece is looked up; texts with two adjacent white
    spaces, and all texts under a pattern other than the vocabulary's own, are given to the tokeniser whole.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("shard", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = max(ranks.values()) + 1
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.code = "H" if self.kind is np.uint16 else "I"
        self.pieces = _Pieces(self.plain, self.code)
        self.whole_only = re.compile(r"\s\s" if pattern == default_vocabulary()[1] else "")

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.kind)
        if self.whole_only.search(text):
            return np.array(self.plain.encode_ordinary(text), self.kind)
        head, *rest = text.split(" ")
        first = array(self.code, self.plain.encode_ordinary(head)).tobytes()
        return np.frombuffer(first + b"".join(map(self.pieces.__getitem__, rest)), self.kind)


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def build(ids: np.ndarray, levels: int, keys: list[str | None], bounds: np.ndarray) -> bytes:
    """The file of one shard."""
    pack = zstandard.ZstdCompressor(level=3).compress
    parts = [pack(json.dumps(keys).encode()), pack(np.diff(bounds, prepend=0).astype("<u4").tobytes())]
    zeros, now = [], ids
    for level in range(levels - 1, -1, -1):
        bit = (now >> level) & 1 == 1
        packed = np.packbits(bit, bitorder="little")
        words = np.zeros(-(-len(ids) // (64 * _BLOCK)) * _BLOCK, "<u8")
        words.view(np.uint8)[: len(packed)] = packed
        ranks = np.r_[0, np.cumsum(np.bitwise_count(words).reshape(-1, _BLOCK).sum(1, dtype=np.uint64))].astype("<u8")
        parts += [pack(words.tobytes()), pack(ranks.tobytes())]
        rest = now[~bit]
        zeros.append(len(rest))
        now = np.concatenate([rest, now[bit]])
    head = json.dumps({"n": len(ids), "levels": levels, "zeros": zeros, "docs": len(keys), "parts": [len(p) for p in parts]}).encode()
    return MAGIC + struct.pack("<I", len(head)) + head + b"".join(parts)


class WaveletShard:
    """Reads a shard file. Positions count the tokens of the whole shard."""

    def __init__(self, data: bytes):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a shard file")
        (size,) = struct.unpack("<I", data[8:12])
        self.head = json.loads(bytes(data[12 : 12 + size]))
        self.n, self.levels, self.zeros = self.head["n"], self.head["levels"], self.head["zeros"]
        starts = np.r_[0, np.cumsum(self.head["parts"])] + 12 + size
        self._raw = [data[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
        self._open: dict[int, bytes] = {}

    def _part(self, k: int) -> bytes:
        if k not in self._open:
            self._open[k] = zstandard.ZstdDecompressor().decompress(bytes(self._raw[k]))
        return self._open[k]

    def _plane(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(self._part(2 + 2 * level), "<u8"), np.frombuffer(self._part(3 + 2 * level), "<u8").astype(np.int64)

    @property
    def keys(self) -> list[str | None]:
        return json.loads(self._part(0))

    @property
    def bounds(self) -> np.ndarray:
        return np.cumsum(np.frombuffer(self._part(1), "<u4").astype(np.int64))

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        words, _ = self._plane(level)
        return (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1

    def _rank1(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        words, ranks = self._plane(level)
        if not len(words):
            return np.zeros(len(at), np.int64)
        block = np.minimum(at // (64 * _BLOCK), len(ranks) - 2)
        out, inside = ranks[block], at - block * 64 * _BLOCK
        for w in range(_BLOCK):
            bits = np.clip(inside - 64 * w, 0, 64)
            mask = np.where(bits == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
            out = out + np.bitwise_count(words[block * _BLOCK + w] & mask)
        return out

    def _select(self, level: int, value: bool, k: np.ndarray) -> np.ndarray:
        """Position of the k-th (from 0) bit of ``value``."""
        words, ranks = self._plane(level)
        before = ranks if value else np.arange(len(ranks)) * 64 * _BLOCK - ranks
        block = np.searchsorted(before, k, side="right") - 1
        out = np.empty(len(k), np.int64)
        for a in range(0, len(k), 4096):
            b = block[a : a + 4096]
            bits = np.unpackbits(words.reshape(-1, _BLOCK)[b].view(np.uint8), axis=1, bitorder="little")
            run = np.cumsum(bits if value else 1 - bits, axis=1)
            out[a : a + 4096] = b * 64 * _BLOCK + (run > (k[a : a + 4096] - before[b])[:, None]).argmax(1)
        return out

    def access(self, positions) -> np.ndarray:
        """Token ids at the positions."""
        at = np.asarray(positions, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("position outside the shard")
        out = np.zeros(len(at), np.int64)
        for level in range(self.levels):
            one, ones = self._bit(level, at), self._rank1(level, at)
            out = out << 1 | one
            at = np.where(one, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        ends = np.array([start, end], np.int64)
        for level in range(self.levels):
            ones = self._rank1(level, ends)
            ends = self.zeros[level] + ones if token >> (self.levels - 1 - level) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def rank(self, token: int, end: int) -> int:
        """Occurrences of the token before position ``end``."""
        a, b = self._range(token, 0, min(end, self.n))
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def occurrences(self, token: int) -> np.ndarray:
        """All positions of the token, ascending."""
        a, b = self._range(token, 0, self.n)
        at = np.arange(a, b, dtype=np.int64)
        for level in range(self.levels - 1, -1, -1):
            one = bool(token >> (self.levels - 1 - level) & 1)
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return at

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence, from 0."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError("no such occurrence")
        at = np.array([a + k], np.int64)
        for level in range(self.levels - 1, -1, -1):
            one = bool(token >> (self.levels - 1 - level) & 1)
            at = self._select(level, one, at - self.zeros[level] if one else at)
        return int(at[0])

    def document(self, i: int) -> np.ndarray:
        ends = self.bounds
        return self.access(np.arange(ends[i - 1] if i else 0, ends[i]))


def write_shards(docs: DataFrame, path: str | None = None, pattern: str | None = None, shard_tokens: int = SHARD_TOKENS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(partition, part, n_docs, n_tokens, data) of every shard; ``data`` is the file."""
    if path is None or pattern is None:
        path, pattern = default_vocabulary()

    def shards(batches):
        encode, part = encoder(path, pattern), 0
        levels = max(1, int(encode.size - 1).bit_length())
        keys, held, size = [], [], 0
        row = lambda: pa.RecordBatch.from_pydict({"partition": pa.array([TaskContext.get().partitionId()], pa.int32()), "part": pa.array([part], pa.int32()), "n_docs": pa.array([len(keys)], pa.int64()), "n_tokens": pa.array([size], pa.int64()), "data": pa.array([build(np.concatenate(held), levels, keys, np.cumsum([len(x) for x in held]))], pa.binary())})
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                ids = encode(texts[i].as_py())
                keys.append(names[i].as_py())
                held.append(ids)
                size += len(ids)
                if size >= shard_tokens:
                    yield row()
                    keys, held, size, part = [], [], 0, part + 1
        if keys:
            yield row()

    narrow = docs.select(ref(key).cast("string").alias("k"), ref(text).cast("string").alias("t"))
    return narrow.mapInArrow(shards, "partition int, part int, n_docs long, n_tokens long, data binary")


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """(partition, part, token, count) over all shards, from the rank directories alone."""

    def look(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([WaveletShard(x).count(token) for x in b.column(2).to_pylist()], pa.int64())], names=["partition", "part", "count"])

    return shards.select("partition", "part", "data").mapInArrow(look, "partition int, part int, count long").withColumn("token", F.lit(token))
