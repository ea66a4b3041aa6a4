"""Word shingles of whole texts as 64-bit hashes, computed on an Arrow column's bytes with numpy.

Words are runs of bytes other than blank and 0x09-0x0D, after A-Z are lower-cased. A text's set
holds its distinct runs of ``width`` words; a shorter text has its whole sequence as one, a text
without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Text handled at once inside a worker; numpy needs about 60 times as much for it.
SLICE_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the usual two-multiply finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def _keys(n: int) -> np.ndarray:
    """An odd key for each place. They follow no rule that a sum over places could cancel, as powers of a
    base (Thue-Morse words) or multiples (a b b a and b a a b) do."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)


def _column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; nulls are empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and each text's first word (with the total at the end)."""
    solid = ~_SPACE[raw]
    if not solid.any():
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = at[:-1][at[:-1] < at[1:]]  # the first byte of a text begins a word even after another text's word
    begins[firsts] = solid[firsts]
    where = np.flatnonzero(solid)
    first = np.searchsorted(where, np.flatnonzero(begins))  # of each word, among the solid bytes
    length = np.diff(np.append(first, len(where)))
    place = np.arange(len(where)) - np.repeat(first, length)
    hashes = np.add.reduceat(_BYTE[_LOWER[raw[where]]] * _keys(int(length.max()))[place], first)
    return mix(hashes), np.searchsorted(np.flatnonzero(begins), at)


def _per_text(texts: pa.Array):
    """(first text, word hashes, word offsets) for runs of texts of about SLICE_BYTES."""
    raw, at = _column(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        words, begins = _words(raw[at[first] : at[last]], at[first : last + 1] - at[first])
        yield first, words, begins
        first = last


def _runs(words: np.ndarray, begins: np.ndarray, width: int) -> list[np.ndarray]:
    """Shingle hashes of each text, with repeats, in text order."""
    n = len(words)
    total = np.zeros(max(0, n - width + 1), np.uint64)
    factors = _keys(width)
    for i in range(width):
        total += words[i : i + len(total)] * factors[i]
    total = mix(total)
    out = []
    for a, b in zip(begins[:-1], begins[1:], strict=True):
        if b - a >= width:
            out.append(total[a : b - width + 1])
        elif b > a:
            part = words[a:b] * factors[: b - a]
            out.append(mix(part.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes as sorted signed 64-bit integers."""
    return [np.unique(run.view(np.int64)) for _, words, begins in _per_text(texts) for run in _runs(words, begins, width)]


def sequence_keys(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that identify each text's word sequence, as two signed integers."""
    keys = []
    for _, words, begins in _per_text(texts):
        count = np.diff(begins)
        place = np.arange(len(words), dtype=np.uint64) - np.repeat(begins[:-1], count).astype(np.uint64)
        pair = []
        for seed in (1, 2):
            each = mix(words + mix((place << np.uint64(2)) + np.uint64(seed)))
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)])
            pair.append(mix(sums[begins[1:]] - sums[begins[:-1]] + count.astype(np.uint64)))
        keys.append(pair)
    a, b = (np.concatenate([k[i] for k in keys]) if keys else np.zeros(0, np.uint64) for i in (0, 1))
    return a.view(np.int64), b.view(np.int64)
