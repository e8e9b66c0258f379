"""Order MinHash sketches of word k-mers and banded alignment of k-mer sequences, on numpy and plain integers."""

from __future__ import annotations

import zlib

import numpy as np

K = 5
#: Sketches of a text, and k-mers in each.
SKETCHES, TOGETHER = 12, 3
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SEEDS = (np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) | np.uint64(1)
#: Words of a text beyond which the sketches are taken one after the other, for the sake of memory.
WIDE = 50_000


class _Hashes(dict):
    """Word -> number, remembered for the words of a task up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = zlib.crc32(word) | (zlib.adler32(word) << 32)
        return h


_hashes = _Hashes()


def kmers(words: list[bytes]) -> np.ndarray:
    """Hashes of all K-word windows, in order; a shorter text is one window."""
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - K + 1)
    out = np.zeros(n if len(h) else 0, np.uint64)
    for k in range(min(K, len(h))):
        out = (out ^ h[k:k + n]) * _ODD
        out ^= out >> np.uint64(31)
    return out


def labelled(grams: np.ndarray) -> np.ndarray:
    """k-mers with the number of their occurrence mixed in, so that the second of two equal ones differs from the first."""
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return grams
    starts = np.flatnonzero(new)
    nth = np.arange(len(s)) - np.repeat(starts, np.diff([*starts, len(s)]))
    out = np.empty_like(grams)
    out[order] = (s + nth.astype(np.uint64) * _MIX) * np.where(nth > 0, _ODD, np.uint64(1))
    return out


def _ranks(grams: np.ndarray, seed: np.uint64) -> np.ndarray:
    r = (grams ^ seed) * _MIX
    r ^= r >> np.uint64(32)
    return r * _ODD


def sketches(grams: np.ndarray) -> list[int]:
    """SKETCHES numbers, each out of the TOGETHER smallest labelled k-mers in the order of the text; none for no k-mers."""
    if not len(grams):
        return []
    grams = labelled(grams)
    n, t = len(grams), min(TOGETHER, len(grams))
    if n <= t:
        at = np.broadcast_to(np.arange(n), (SKETCHES, n))
    elif n > WIDE:
        at = np.stack([np.argpartition(_ranks(grams, s), t)[:t] for s in _SEEDS])
    else:
        at = np.argpartition(_ranks(grams[None, :], _SEEDS[:, None]), t, axis=1)[:, :t]
    chosen = grams[np.sort(at, axis=1)]
    out = _SEEDS.copy()
    for k in range(t):
        out = (out ^ chosen[:, k]) * _MIX
        out ^= out >> np.uint64(29)
    return out.view(np.int64).tolist()


def similarity(a: list[bytes], b: list[bytes], least: float) -> float:
    """Common part of the best alignment of two k-mer sequences, over their union; 0 where it is below ``least``.

    The alignment is the longest common subsequence within a band around the diagonal that is as wide as ``least``
    allows, on whole-number bit rows: as many steps as k-mers, each over the band's bits.
    """
    x, y = kmers(a).tolist(), kmers(b).tolist()
    if len(x) > len(y):
        x, y = y, x
    if not x or len(x) < least * len(y):
        return float(x == y)
    # what both begin or end with is aligned as it is
    head = 0
    while head < len(x) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < len(x) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    n, m = len(x), len(y)
    p, q = x[head:n - tail], y[head:m - tail]
    # l common ones of n and m: l / (n + m - l) >= least
    need = -(-least * (n + m) // (1 + least)) - head - tail
    if need > len(p):
        return 0.0
    band = max(len(p) - need, len(q) - need, 0)
    common = head + tail + _banded(p, q, int(band))
    share = common / (n + m - common)
    return share if share >= least else 0.0


def jaccard(a: list[bytes], b: list[bytes]) -> float:
    """Common part of the sets of k-mers."""
    x, y = set(kmers(a).tolist()), set(kmers(b).tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def _banded(p: list[int], q: list[int], band: int) -> int:
    """Longest common subsequence with places no further apart than ``band``."""
    places: dict[int, int] = {}
    for j, g in enumerate(q):
        places[g] = places.get(g, 0) | 1 << j
    row = (1 << len(q)) - 1
    full, window = row, (1 << (2 * band + 1)) - 1
    for i, g in enumerate(p):
        match = places.get(g, 0)
        if match:
            match &= window << (i - band) if i >= band else window >> (band - i)
            u = row & match
            row = ((row + u) | (row - u)) & full
    return (row ^ full).bit_count()
