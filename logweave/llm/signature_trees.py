"""Signature trees over token sets: OR-combined bitmaps and size ranges, dual traversal, linked components.

A leaf is a set; an inner node holds the OR of its children's bitmaps, the range of their sizes and the largest *slack*
(tokens beyond the set bits) below it. For sets a and b below nodes A and B the overlap is at most
``popcount(A & B) + min(slack A, slack B)``: common tokens lie in common bits, and a set has at most ``slack`` tokens
more than bits. A pair of nodes goes when that bound, or the size ranges, rule out the wanted similarity.
"""

from __future__ import annotations

import numpy as np

FAN = 8
#: Node pairs whose bitmaps are compared at once.
SLAB = 1 << 14


class SignatureTree:
    """A tree over sets (sorted uint64 arrays), leaves in order of size so that near sizes share nodes."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        self.order = np.argsort(sizes, kind="stable")
        marks = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for row, k in enumerate(self.order):
            bit = sets[k] & np.uint64(bits - 1)
            np.bitwise_or.at(marks[row], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        sizes = sizes[self.order]
        slack = sizes - np.bitwise_count(marks).sum(axis=1)
        self.levels = [(marks, sizes, sizes, slack)]
        while len(self.levels[-1][0]) > 1:
            marks, low, high, slack = self.levels[-1]
            starts = np.arange(0, len(marks), FAN)
            self.levels.append(
                (np.bitwise_or.reduceat(marks, starts), np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.maximum.reduceat(slack, starts))
            )

    def children(self, level: int, node: np.ndarray) -> np.ndarray:
        """Rows of the level below under each node, with -1 beyond the last."""
        rows = node[:, None] * FAN + np.arange(FAN)
        rows[rows >= len(self.levels[level - 1][0])] = -1
        return rows


def _possible(a, b, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which node pairs may hold sets with ``den * overlap >= num * union``."""
    (am, al, ah, asl), (bm, bl, bh, bsl) = a, b
    fits = (den * ah[i] >= num * bl[j]) & (den * bh[j] >= num * al[i])
    i, j = i[fits], j[fits]
    most = np.bitwise_count(am[i] & bm[j]).sum(axis=1).astype(np.int64) + np.minimum(asl[i], bsl[j])
    most = np.minimum(most, np.minimum(ah[i], bh[j]))
    fits[fits] = (den + num) * most >= num * (al[i] + bl[j])
    return fits


def candidates(left: SignatureTree, right: SignatureTree | None, num: int, den: int):
    """Slabs of leaf pairs (positions in the given lists) that no node pair above them has ruled out."""
    same = right is None
    other = left if same else right
    a_top, b_top = len(left.levels) - 1, len(other.levels) - 1
    stack = [(a_top, b_top, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        la, lb, i, j = stack.pop()
        if len(i) > SLAB:
            stack += [(la, lb, i[k : k + SLAB], j[k : k + SLAB]) for k in range(0, len(i), SLAB)]
            continue
        keep = _possible(left.levels[la], other.levels[lb], i, j, num, den)
        i, j = i[keep], j[keep]
        if not len(i):
            continue
        if not la and not lb:
            if same:
                i, j = i[i < j], j[i < j]
            yield left.order[i], other.order[j]
            continue
        if la >= lb:
            rows = left.children(la, i)
            j2 = np.repeat(j, FAN)
            i2, na = rows.ravel(), la - 1
            ok = i2 >= 0
            i, j, la = i2[ok], j2[ok], na
            if same and lb == la + 1:  # go down on both sides together, so that i <= j prunes mirror images
                rows = other.children(lb, j)
                i2, j2 = np.repeat(i, FAN), rows.ravel()
                ok = (j2 >= 0) & (i2 <= j2)
                i, j, lb = i2[ok], j2[ok], lb - 1
        else:
            rows = other.children(lb, j)
            i2, j2 = np.repeat(i, FAN), rows.ravel()
            ok = j2 >= 0
            i, j, lb = i2[ok], j2[ok], lb - 1
        stack.append((la, lb, i, j))


def linked(sets: list[np.ndarray], num: int, den: int, others: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Links that join the sets into components: a spanning forest of all pairs with ``den * overlap >= num * union``.

    Sets of one list are joined with one another, or with ``others`` if given (whose positions follow the first's).
    Pairs already joined through other links are not verified again, so a group of near copies costs about one
    verification a set.
    """
    every = sets + (others or [])
    most = max((len(s) for s in every), default=1)
    bits = 1 << int(np.clip(np.ceil(np.log2(4 * most)), 8, 16))
    left = SignatureTree(sets, bits)
    right = SignatureTree(others, bits) if others is not None else None
    root = np.arange(len(every))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = []
    for i, j in candidates(left, right, num, den):
        if others is not None:
            j = j + len(sets)
        for k in range(0, len(i), 256):
            a, b = i[k : k + 256], j[k : k + 256]
            while (root[root] != root).any():
                root = root[root]
            apart = root[a] != root[b]
            for x, y in zip(a[apart].tolist(), b[apart].tolist()):
                rx, ry = find(x), find(y)
                if rx == ry:
                    continue
                u, v = every[x], every[y]
                overlap = len(u) + len(v) - len(np.union1d(u, v)) if len(u) < 64 else int(np.isin(u, v, assume_unique=True, kind="sort").sum())
                if den * overlap >= num * (len(u) + len(v) - overlap):
                    root[max(rx, ry)] = min(rx, ry)
                    links.append((x, y))
    return links
