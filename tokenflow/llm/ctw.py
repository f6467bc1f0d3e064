"""Context-tree weighting over bytes, as array arithmetic.

A context of ``depth`` bytes and the next byte form a gram, packed into one
integer with the most recent byte highest and the next byte lowest, so that
cutting low or middle bits gives every shorter context and every bit prefix.
The next byte is decomposed into 8 binary decisions; each of the 255 bit nodes
has its own context tree. A node with n0 and n1 counts has the
Krichevsky-Trofimov probability Pe; the weighted probability is
Pw = (Pe + product of the children's Pw) / 2, and Pe at the full depth.

Functions work on the grams of one subtree (all grams that share the most
recent ``top`` bytes); the levels above are combined from the subtrees' sums.
"""

from __future__ import annotations

import numpy as np

LOG_HALF = np.log(0.5)


def lgamma_half(n: np.ndarray) -> np.ndarray:
    """log Gamma(n + 1/2) for n >= 0."""
    return _lgamma(n + 0.5)


def _lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):  # small arguments upward, then Stirling's series
        low = y < 8
        if not low.any():
            break
        shift[low] -= np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y
    return shift + (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any order of n0 zeros and
    n1 ones."""
    return lgamma_half(n0) + lgamma_half(n1) - _lgamma(n0 + n1 + 1.0) - np.log(np.pi)


def shorten(grams: np.ndarray, depth: int, d: int) -> np.ndarray:
    """Grams with contexts of ``depth`` bytes cut to the ``d`` most recent."""
    drop = np.uint64(8 * (depth - d))
    return ((grams >> np.uint64(8)) >> drop << np.uint64(8)) | (grams & np.uint64(255)) if d < depth else grams


class Level:
    """Nodes of one context length and one bit position."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, bit: int):
        nodes = codes >> np.uint64(8 - bit)
        self.keys, self.of = np.unique(nodes, return_inverse=True)
        one = ((codes >> np.uint64(7 - bit)) & np.uint64(1)).astype(float)
        self.n1 = np.bincount(self.of, weights=counts * one, minlength=len(self.keys))
        self.n0 = np.bincount(self.of, weights=counts, minlength=len(self.keys)) - self.n1
        self.seen = self.n0 + self.n1 > 0
        self.pe = log_kt(self.n0, self.n1)
        self.pw = self.pe

    def weigh(self, children: np.ndarray) -> None:
        """children: summed log Pw of the nodes one byte deeper."""
        self.pw = np.where(self.seen, LOG_HALF + np.logaddexp(self.pe, children), 0.0)

    def stop(self) -> np.ndarray:
        """Posterior weight of stopping at each node."""
        return np.exp(np.minimum(LOG_HALF + self.pe - self.pw, 0.0))

    def kt_one(self) -> np.ndarray:
        return (self.n1 + 0.5) / (self.n0 + self.n1 + 1)


def subtree(grams: np.ndarray, counts: np.ndarray, depth: int, top: int, predict: bool):
    """For the distinct ``grams`` of a subtree with their training counts.

    Returns per bit the root nodes (prefix keys, n0, n1, log Pw) and, with
    ``predict``, the probability of a one at each bit for every gram (8 rows),
    as seen from the subtree's root.
    """
    roots, ones = [], []
    by_depth = []
    for d in range(top, depth + 1):
        codes, of = np.unique(shorten(grams, depth, d), return_inverse=True)
        by_depth.append((codes, of, np.bincount(of, weights=counts, minlength=len(codes))))
    for bit in range(8):
        levels = [Level(codes, n, bit) for codes, _, n in by_depth]
        for k in range(len(levels) - 2, -1, -1):
            deep, flat = levels[k + 1], levels[k]
            parent = np.searchsorted(flat.keys, _parents(deep.keys, top + k + 1, bit))
            flat.weigh(np.bincount(parent, weights=deep.pw, minlength=len(flat.keys)))
        roots.append((levels[0].keys, levels[0].n0, levels[0].n1, levels[0].pw))
        if not predict:
            continue
        p = None
        for k in range(len(levels) - 1, -1, -1):
            at = levels[k].of[by_depth[k][1]]  # node of each gram
            kt, seen = levels[k].kt_one()[at], levels[k].seen[at]
            if p is None:
                p = np.where(seen, kt, np.nan)
            else:
                w = levels[k].stop()[at]
                # a context that training lacks leaves its weight to this one
                p = np.where(np.isnan(p), np.where(seen, kt, np.nan), w * kt + (1 - w) * p)
        ones.append(p)
    return roots, ones


def _parents(keys: np.ndarray, d: int, bit: int) -> np.ndarray:
    """Node keys one context byte shorter: (c1..cd, bits) -> (c1..c(d-1), bits)."""
    low = np.uint64((1 << bit) - 1)
    return (keys >> np.uint64(bit + 8) << np.uint64(bit)) | (keys & low)


class Top:
    """The levels above the subtrees: contexts of 0 to ``top`` - 1 bytes."""

    def __init__(self, roots: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], top: int):
        self.top, self.levels = top, []
        for bit in range(8):
            keys, n0, n1, pw = roots[bit]
            chain = []
            for d in range(top, 0, -1):
                up, of = np.unique(_parents(keys, d, bit), return_inverse=True)
                n0, n1 = (np.bincount(of, weights=x, minlength=len(up)) for x in (n0, n1))
                pe = log_kt(n0, n1)
                seen = n0 + n1 > 0
                children = np.bincount(of, weights=pw, minlength=len(up))
                pw = np.where(seen, LOG_HALF + np.logaddexp(pe, children), 0.0)
                stop = np.exp(np.minimum(LOG_HALF + pe - pw, 0.0))
                chain.append((up, np.where(seen, (n1 + 0.5) / (n0 + n1 + 1), np.nan), stop))
                keys = up
            self.levels.append(chain)  # deepest first

    def log10(self, grams: np.ndarray, ones: list[np.ndarray], depth: int) -> np.ndarray:
        """log10 probability of the next byte of each gram."""
        total = np.zeros(len(grams))
        for bit in range(8):
            p = ones[bit]
            for k, (keys, kt, stop) in enumerate(self.levels[bit]):
                d = self.top - 1 - k
                node = shorten(grams, depth, d) >> np.uint64(8 - bit)
                at = np.minimum(np.searchsorted(keys, node), max(len(keys) - 1, 0))
                hit = keys[at] == node if len(keys) else np.zeros(len(node), bool)
                q = np.where(hit, kt[at], np.nan) if len(keys) else np.full(len(node), np.nan)
                w = np.where(hit, stop[at], 0.0) if len(keys) else np.zeros(len(node))
                p = np.where(np.isnan(p), q, np.where(np.isnan(q), p, w * q + (1 - w) * p))
            p = np.where(np.isnan(p), 0.5, p)
            one = ((grams >> np.uint64(7 - bit)) & np.uint64(1)).astype(bool)
            total += np.log10(np.where(one, p, 1 - p))
        return total


def grams_of(data: np.ndarray, depth: int) -> np.ndarray:
    """Gram of every position of ``data`` (uint8, with ``depth`` leading zeros
    as the context before the text); ``depth`` is at most 6."""
    n = len(data) - depth
    if n <= 0:
        return np.empty(0, np.uint64)
    # 8 bytes from each place on, the first one lowest: the context is in order
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    window = np.ndarray((n,), dtype="<u8", buffer=padded, strides=(1,))
    out = window & np.uint64((1 << (8 * depth)) - 1)
    out <<= np.uint64(8)
    out |= (window >> np.uint64(8 * depth)) & np.uint64(255)
    return out
