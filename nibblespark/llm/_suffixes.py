"""Suffix sorting with hash comparisons, on byte arrays.

Prefix polynomial hashes (modulo 2**64) give the hash of any span in constant time. A binary search over
spans finds the common extension of two suffixes, so a comparison costs the logarithm of their length, and
a bottom-up mergesort orders all suffixes with it, many comparisons at once. Common extensions between
neighbours are then held against the bytes, so a hash collision cannot pass.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np

_TABLE = np.random.default_rng(7).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _powers_to(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = 1 << max(16, int(n).bit_length())
        _powers[:] = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Hashes:
    """Span hashes of a byte array."""

    def __init__(self, data: np.ndarray):
        up, self.down = _powers_to(len(data) + 1)
        self.data = data
        self.prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_TABLE[data] * up[: len(data)], out=self.prefix[1:])

    def span(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (self.prefix[j] - self.prefix[i]) * self.down[i]

    def common(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common extension of the suffixes at x and y, ``most`` at most."""
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            same = self.span(x, x + mid) == self.span(y, y + mid)
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo


def suffix_sort(data: np.ndarray, group: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the spans (start, length) within their groups, and the common extension with the one before.

    Groups come in ascending order; the extension is -1 at the first of a group.
    """
    n, h = len(start), Hashes(data)
    padded = np.append(data, np.uint8(0))

    def less(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = group[x] < group[y]
        tie = np.flatnonzero(group[x] == group[y])
        if len(tie):
            a, b = x[tie], y[tie]
            most = np.minimum(length[a], length[b])
            k = h.common(start[a], start[b], most)
            ca, cb = padded[start[a] + k], padded[start[b] + k]
            by_end = np.where(length[a] != length[b], length[a] < length[b], a < b)
            out[tie] = np.where(k < most, ca < cb, by_end)
        return out

    order, width = np.arange(n), 1
    at = np.arange(n)
    while width < n:
        run = at // width
        mate = run ^ 1
        lo = np.minimum(mate * width, n)
        first, end = lo.copy(), np.minimum(lo + width, n)
        hi = end.copy()
        while True:  # how many of the other run come before each
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            before = less(order[mid], order[open_])
            lo[open_[before]] = mid[before] + 1
            hi[open_[~before]] = mid[~before]
        place = (run // 2) * 2 * width + (at - run * width) + (lo - first)
        merged = np.empty_like(order)
        merged[place] = order
        order, width = merged, 2 * width
    common = np.full(n, -1, np.int64)
    pair = np.flatnonzero(group[order[1:]] == group[order[:-1]]) + 1
    if len(pair):
        x, y = order[pair - 1], order[pair]
        k = h.common(start[x], start[y], np.minimum(length[x], length[y]))
        common[pair] = _verified(data, start[x], start[y], k)
    return order, common


def _verified(data: np.ndarray, x: np.ndarray, y: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The extensions, cut at the first byte that differs."""
    k = k.astype(np.int64)
    some = np.flatnonzero(k)
    if not len(some):
        return k
    size = k[some]
    begin = np.cumsum(size) - size
    step = np.arange(int(size.sum())) - np.repeat(begin, size)
    differs = data[np.repeat(x[some], size) + step] != data[np.repeat(y[some], size) + step]
    if differs.any():
        k[some] = np.minimum.reduceat(np.where(differs, step, np.iinfo(np.int64).max), begin).clip(max=size)
    return k


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window, by running minima of blocks from both ends."""
    n = len(values) - width + 1
    pad = (-len(values)) % width
    blocks = np.concatenate([values, np.full(pad, np.iinfo(values.dtype).max, values.dtype)]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def segments(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """Windows of each text, put together by their minimizer.

    The minimizer of a window is the ``gram``-byte string in it with the smallest hash, the first on a tie.
    Gives, for runs of windows with one minimizer: text, first and last window start, minimizer start (all in
    ``data``), and the minimizer's hash. ``data`` is under 16 MB.
    """
    if len(data) < window:
        return None
    h = Hashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = mix(h.span(at, at + gram))
    low = np.uint64((1 << 24) - 1)
    best = (sliding_min((grams & ~low) | at.astype(np.uint64), window - gram + 1) & low).astype(np.int64)
    s = np.arange(len(best))
    text = np.searchsorted(starts, s, side="right") - 1
    inside = s + window <= starts[text] + lens[text]
    s, best, text = s[inside], best[inside], text[inside]
    if not len(s):
        return None
    cut = np.flatnonzero((np.diff(best) != 0) | (np.diff(s) != 1)) + 1
    lo, hi = np.append(0, cut), np.append(cut, len(s)) - 1
    first, last, a = s[lo], s[hi], best[lo]
    return text[lo], first, last, a, grams[a]


def digests(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cryptographic digest of 128 bits of each span of bytes, as two numbers: equal ones mean equal bytes."""
    view = memoryview(data)
    raw = b"".join(blake2b(view[i:j], digest_size=16).digest() for i, j in zip(start.tolist(), end.tolist()))
    both = np.frombuffer(raw, np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def repeated_windows(group: np.ndarray, lead: np.ndarray, span: np.ndarray, contexts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Windows that stand in two contexts of one group.

    Context i holds windows that start at 0 to ``span[i]`` in it, all over the minimizer at ``lead[i]``. Two
    windows are equal if they lie alike around the minimizer and agree to its left and to its right; both
    sides are suffix sorted. Gives context, first and last window start for each run of repeated windows.
    """
    n = len(contexts)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    lens = np.fromiter(map(len, contexts), np.int64, n)
    anchor = np.cumsum(lens) - lens + lead
    right, right_common = suffix_sort(data, group, anchor, lens - lead)
    left, left_common = suffix_sort(data[::-1].copy(), group, len(data) - anchor, lead)
    depth = window - gram + 1
    flags = np.zeros((n, depth + 1), bool)
    class_r, class_l = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(depth):  # distance of the window's start from the minimizer
        valid = np.flatnonzero((lead - span <= o) & (o <= lead))
        if len(valid) < 2:
            continue
        class_r[right] = np.cumsum(right_common < window - o)
        class_l[left] = np.cumsum(left_common < o)
        key = class_r[valid] * (n + 1) + class_l[valid]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        hit = np.append(same, False) | np.append(False, same)
        flags[valid[by[hit]], o] = True
    edge = np.diff(np.concatenate([np.zeros((n, 1), np.int8), flags.astype(np.int8)], axis=1), axis=1)
    i, first = np.nonzero(edge == 1)
    _, after = np.nonzero(edge == -1)
    return i, lead[i] - (after - 1), lead[i] - first
