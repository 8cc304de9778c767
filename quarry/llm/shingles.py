"""Word shingles of a text as 64-bit hashes, and the fast similarity sketch over them.

Plain numpy over one text at a time; Spark partitions the texts. Arithmetic is modulo 2**64.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
#: ASCII white space: the words of a text are the runs of other bytes.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, (2, 256), dtype=np.uint64) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
#: Texts are hashed in runs of so many bytes, so the power tables stay small.
_RUN = 1 << 16


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW = _powers(_BASE, _RUN)
_POW_INV = _powers(_BASE_INV, _RUN)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(text: str | None, lower: bool = True) -> np.ndarray:
    """One hash per word ``[^\\x20\\x09-\\x0D]+``, in order; A-Z lower-cased if asked."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    if lower:
        data = _LOWER[data]
    edge = np.diff(np.concatenate(([False], ~_SPACE[data], [False])).view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(data, starts, ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Polynomial hash of each byte span; equal bytes give equal hashes wherever they stand.
    The spans are in order; ``salt`` 0 and 1 give two independent hashes."""
    byte = _BYTE[salt]
    out = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(ends, base + _RUN, side="right")))
        low, high = starts[at:stop] - base, ends[at:stop] - base
        if int(high[-1]) <= _RUN:
            n = int(high[-1])
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(byte[data[base : base + n]] * _POW[:n], dtype=np.uint64, out=sums[1:])
            out[at:stop] = (sums[high] - sums[low]) * _POW_INV[low]
        else:  # one word longer than a run: fold its pieces
            n, h, scale = int(high[0]), 0, 1
            step = pow(_BASE, _RUN, 2**64)
            for i in range(0, n, _RUN):
                piece = data[base + i : base + min(n, i + _RUN)]
                h = (h + int(np.sum(byte[piece] * _POW[: len(piece)], dtype=np.uint64)) * scale) % 2**64
                scale = scale * step % 2**64
            out[at] = h
        at = stop
    return mix(out + (ends - starts).astype(np.uint64) * U(0xD6E8FEB86659FD93))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words; of the whole sequence when it is shorter."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    acc = np.full(n - size + 1, U(size), np.uint64)
    for j in range(size):
        acc *= U(0x9E3779B97F4A7C15)
        acc += words[j : n - size + 1 + j]
    return mix(acc)


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """The distinct ``size``-word shingles of a text as sorted hashes; empty without words."""
    return np.unique(windows(word_hashes(text), size))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Intersection size of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


_ROUNDS = np.arange(4097, dtype=np.uint64) * U(0xC2B2AE3D27D4EB4F)
_SEEDS = mix(np.arange(1, 4097, dtype=np.uint64) * U(0xA0761D6478BD642F))


def fast_sketch(items: np.ndarray, t: int = 128) -> np.ndarray:
    """Fast similarity sketch of a set of hashes: ``t`` coordinates (``t`` a power of two), all
    zero for the empty set.

    Round ``r < t`` throws every item into a hashed bin with a hashed value; a bin keeps the
    least value of the first round that reaches it. Round ``t + j`` throws every item into bin
    ``j``, so ``2 t`` rounds fill every coordinate whatever the set. Two sets agree on a
    coordinate with probability equal to their Jaccard similarity, and the rounds concentrate
    the count of agreements as sampling without replacement would.
    """
    shift = U(t.bit_length() - 1)
    low = U(t - 1)
    out = np.zeros(t, np.uint64)
    if not len(items):
        return out
    empty = np.ones(t, bool)
    top = U(0xFFFFFFFFFFFFFFFF)
    for r in range(2 * t):
        g = mix(items ^ _SEEDS[r])
        if r < t:
            least = np.full(t, top, np.uint64)
            np.minimum.at(least, (g & low).astype(np.intp), g >> shift)
            new = empty & (least != top)
            out[new] = mix(least[new] + _ROUNDS[r])
            empty &= ~new
        elif empty[r - t]:
            out[r - t] = mix(g.min(keepdims=True) + _ROUNDS[r : r + 1])[0]
            empty[r - t] = False
        if not empty.any():
            break
    return out


def band_keys(sketch: np.ndarray, rows: int = 4) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` coordinates; the band's number is part of it."""
    bands = sketch.reshape(-1, rows)
    acc = np.arange(len(bands), dtype=np.uint64) * U(0x9E3779B97F4A7C15)
    for j in range(rows):
        acc = mix(acc + bands[:, j])
    return acc
