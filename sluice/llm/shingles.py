"""Words and shingles of many texts at once, on byte arrays.

Words are the runs of bytes other than space and tab..CR after lower-casing
A-Z; a word's hash is a sum of random 64-bit numbers for (byte, place), mixed.
Equal words have equal hashes; two different ones collide with probability
2**-64, and a shingle's hash is of the same kind over its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U) * U(2) + U(1)
_PLACE = _rng.integers(1, 1 << 63, 1024, dtype=U) * U(2) + U(1)
_BLOCK = _rng.integers(1, 1 << 63, 1024, dtype=U) * U(2) + U(1)
_BLOCK[0] = 1  # a short word's hash is the same whether or not its chunk holds a long one
_WORD = _rng.integers(1, 1 << 63, 64, dtype=U) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Texts are taken in chunks of about so many bytes.
CHUNK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(texts: pa.Array):
    """(bytes, offsets) of a string array without nulls, for chunks of about CHUNK bytes: (first, last, bytes, offsets)."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    off = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray):
    """(starts, ends, text of each word) as places in data."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[off] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1, solid


def span_hashes(data: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Hashes of consecutive spans (of lens, none empty) that make up data."""
    if not len(lens):
        return np.zeros(0, U)
    begin = np.cumsum(lens) - lens
    place = np.arange(len(data)) - np.repeat(begin, lens)
    h = _BYTE[data] * _PLACE[place & 1023]
    if int(lens.max()) > 1024:
        h *= _BLOCK[(place >> 10) & 1023]
    return mix(np.add.reduceat(h, begin) + lens.astype(U))


def word_hashes(data: np.ndarray, off: np.ndarray):
    """(hash of each word, its text's place)."""
    starts, ends, owner, solid = word_spans(data, off)
    return span_hashes(_LOWER[data[solid]], ends - starts), owner


def chunks(texts: pa.Array, k: int):
    """(word hashes, where each text's words begin, hashes of the k words from each word on), chunk by chunk."""
    for i, j, data, off in buffers(texts):
        h, owner = word_hashes(data, off)
        begin = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=j - i))])
        full = max(0, len(h) - k + 1)
        s = np.zeros(full, U)
        for d in range(k):
            s += (h[d : d + full] ^ _WORD[63]) * _WORD[d]
        yield h, begin, mix(s + U(k))


def short_shingle(h: np.ndarray) -> np.ndarray:
    """The one shingle of a text of fewer words than a shingle has."""
    x = ((h ^ _WORD[63]) * _WORD[: len(h)]).sum(dtype=U)
    return mix(np.array([x + U(len(h))], dtype=U))


def chunk_sets(h, begin, s, k: int):
    for a, b in zip(begin[:-1], begin[1:]):
        if b - a >= k:
            yield np.unique(s[a : b - k + 1])
        else:
            yield short_shingle(h[a:b]) if b > a else np.zeros(0, U)


def shingle_sets(texts: pa.Array, k: int):
    """The sorted distinct hashes of each text's k-word shingles, text by text.

    With fewer than k words the whole sequence is the one shingle; without
    words the set is empty.
    """
    for h, begin, s in chunks(texts, k):
        yield from chunk_sets(h, begin, s, k)
