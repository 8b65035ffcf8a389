"""Word hashes of whole Arrow batches with numpy: a few nanoseconds a byte, no loop over words.

A word is a run of ASCII letters and digits and of bytes above 127, in lower case; everything else
separates. Texts are read from the Arrow buffers in blocks of bounded bytes, so that very long texts
and full batches don't raise the memory needed beyond the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_RNG = np.random.default_rng(20240501)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[128:] = True
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _IS_WORD[_c] = True
_BYTE[~_IS_WORD] = 0
_SPAN = 1024
_POWER = np.empty(_SPAN, dtype=np.uint64)
_p = 1
for _i in range(_SPAN):
    _POWER[_i] = _p
    _p = _p * 0x9E3779B97F4A7C15 % 2**64
_STEP = np.uint64(_p)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64) of an array of uint64."""
    z = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows in lower case; null rows are empty.

    Only one run at a time is copied, so a batch needs little more memory than itself.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1]
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + most, side="right")) - 1)
        part = pc.utf8_lower(pc.fill_null(texts.slice(at, end - at).cast(pa.large_string()), ""))
        off = np.frombuffer(part.buffers()[1], dtype=np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(part.buffers()[2], dtype=np.uint8) if part.buffers()[2] is not None else np.zeros(0, np.uint8)
        yield at, data[off[0] : off[-1]], off - off[0]
        at = end


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the bounds of each text's words (len(off) entries)."""
    is_word = _IS_WORD[data]
    starts = is_word.copy()
    starts[1:] &= ~is_word[:-1]
    inner = off[:-1][off[:-1] < len(data)]
    starts[inner] = is_word[inner]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    begin = np.zeros(len(data), np.int64)
    begin[at] = at
    np.maximum.accumulate(begin, out=begin)
    pos = np.arange(len(data)) - begin
    power = _POWER[pos % _SPAN]
    if len(far := np.flatnonzero(pos >= _SPAN)):  # bytes of very long words, in scripts without spaces say
        step = pos[far] // _SPAN
        power[far] *= np.cumprod(np.full(int(step.max()), _STEP))[step - 1]
    return mix(np.add.reduceat(_BYTE[data] * power, at)), np.searchsorted(at, off)
