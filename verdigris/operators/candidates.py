"""The candidates of a small node, in one task: drawn columns, seeds, sides and scores, from the same formulas as the
distributed operators of ``clustering``, in the same order and with the same rounding.

A node of few rows costs little but would take as many shuffles as a large one; a forest has thousands of them. Everything is
linear in the rows but for sorting: pair sums come from sorted prefix sums, label spread from sums of unit vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np


def drawn_columns(seed: str, tree: int, node: int, it: int, cols: list[str], k: int) -> list[str]:
    """The k columns of a candidate: those with the least hash."""
    return sorted(sorted(cols, key=lambda c: (hashlib.md5(f"{seed}|{tree}|{node}|{it}|{c}".encode()).hexdigest(), c))[:k])


def from_b(seed: str, tree: int, node: int, it: int) -> bool:
    """Which of the two ways of transferring rows a candidate takes."""
    return hashlib.md5(f"{seed}coin|{tree}|{node}|{it}".encode()).hexdigest()[:1] < "8"


def cosines(y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """1 - cosine of each row of y and the vector z; 1 where a vector is zero."""
    n = np.sqrt((y * y).sum(1)) * math.sqrt((z * z).sum())
    return 1 - np.divide((y * z).sum(1), n, out=np.zeros(len(y)), where=n > 0)


def anchors(key: np.ndarray, y: np.ndarray) -> tuple[int, int] | None:
    """(a, b): places of the row whose largest label distance is largest and of the row farthest from it; ties to the greater key.

    Rows come in the order of keys; distinct label vectors only are compared, each with all.
    """
    if len(key) < 2:
        return None
    v, at, n = np.unique(y, axis=0, return_inverse=True, return_counts=True)
    at = at.ravel()
    first, last = np.full(len(v), len(y)), np.full(len(v), -1)
    np.minimum.at(first, at, np.arange(len(y)))
    np.maximum.at(last, at, np.arange(len(y)))
    best = (-1.0, -1, -1)
    for i in range(len(v)):
        d = np.round(cosines(v, v[i]), 9) + 0.0
        if n[i] == 1:
            d[i] = 0.0
        other = last.copy()
        other[i] = first[i]  # within its own vector a row's partner is the least key
        top = np.flatnonzero(d == d.max())
        best = max(best, (float(d.max()), int(last[i]), int(other[top].max())))
    return None if best[1] == best[2] else best[1:]


class Node:
    """The rows of a node in the order of their keys: x numbers, c codes of categories by column, y labels, sup."""

    def __init__(self, key: np.ndarray, x: dict[str, np.ndarray], c: dict[str, np.ndarray], y: np.ndarray, sup: np.ndarray) -> None:
        self.key, self.x, self.c, self.y, self.sup = key, x, c, y, sup
        self.span = {k: v.max() - v.min() + 1e-12 for k, v in x.items()}
        self.at = np.flatnonzero(sup)
        self.ab = anchors(key[self.at], y[self.at].astype(float))
        if self.ab:
            own = y[self.at].astype(float)
            self.cos = [cosines(own, own[i]) for i in self.ab]
        norm = np.sqrt((y * y).sum(1).astype(float))
        self.unit = np.divide(y.astype(float), norm[:, None], out=np.zeros(y.shape), where=norm[:, None] > 0)

    def distances(self, cols: list[str], place: int) -> np.ndarray:
        """The mixed distance of all rows to one, over some columns in the order numbers, categories."""
        d = np.zeros(len(self.key))
        for k in self.x:
            if k in cols:
                d += np.abs(self.x[k] - self.x[k][place]) / self.span[k]
        for k in self.c:
            if k in cols:
                d += self.c[k] != self.c[k][place]
        return d / len(cols)

    def sides(self, cols: list[str], by_b: bool) -> np.ndarray | None:
        """The cluster of each row."""
        if not self.ab:
            return None
        a, b = (int(self.at[i]) for i in self.ab)
        wa, wb = (np.round(0.7 + 0.3 * self.distances(cols, p)[self.at] + 0.7 * cos, 9) for p, cos in zip((a, b), self.cos, strict=True))
        far, order, skip, near = (wa, wb, self.ab[1], self.ab[0]) if by_b else (wb, wa, self.ab[0], self.ab[1])
        others = np.flatnonzero(np.arange(len(self.at)) != near)
        first = int(others[np.lexsort((others, far[others]))[-1]])
        rest = np.flatnonzero(np.arange(len(self.at)) != skip)
        rest = rest[np.lexsort((rest, order[rest]))]
        n, i = len(rest), np.arange(len(rest))
        before = lambda w: np.cumsum(w) - w
        m0, m1 = (wa[rest].sum() - before(wa[rest])) / (n - i), (wb[first] + before(wb[rest])) / (i + 1)
        done = np.flatnonzero((i >= 1) & (i <= n - 2) & (np.round(m0, 6) > np.round(m1, 6)))
        stop = int(done[0]) if len(done) else max(n - 2, 0)
        cl = np.where((rest == first) | (i < stop), 1, 0)
        centres = int(self.at[rest[-1]]), int(self.at[rest[stop - 1] if stop else first])
        if first == skip:
            rest, cl = np.append(rest, first), np.append(cl, 1)
        d0, d1 = (np.round(self.distances(cols, p), 9) for p in centres)
        out = np.where(d1 < d0, 1, 0)
        out[self.at[rest]] = cl
        return out

    def score(self, cols: list[str], cl: np.ndarray, least: int, p: dict[str, float]) -> float | None:
        """The weighted score of two sides, None where a side is too small."""
        sup = self.sup
        n, s = [[int(((cl == k) & m).sum()) for k in (0, 1)] for m in (np.ones(len(cl), bool), sup)]
        if min(s) <= 2 or min(n) < least:
            return None
        ratio = [s[k] / n[k] for k in (0, 1)]
        t = {"count_balance": min(s) / max(s), "ratio_balance": min(ratio) / max(ratio)}
        own = [np.flatnonzero((cl == k) & sup) for k in (0, 1)]
        if p["labels"]:
            t["labels"] = 1 - sum(self._label_spread(at) for at in own) / 2
        if p["example_balance"]:
            t["example_balance"] = sum(self._balance(at) for at in own) / 2
        if p["silhouette"]:
            t["silhouette"] = (self._silhouette(cols, cl, n) + 1) / 2
        if p["features"]:
            t["features"] = 1 - sum(self._spread(cols, np.flatnonzero(cl == k)) for k in (0, 1)) / 2
        if p["independence"]:
            t["independence"] = self._independence(cols)
        whole = sum(p.values())
        return sum(p[k] / whole * t[k] for k in p if p[k])

    def _label_spread(self, at: np.ndarray) -> float:
        u, m = self.unit[at], len(at) * (len(at) - 1) / 2
        total = u.sum(0)
        return float((m - ((total * total).sum() - (u * u).sum()) / 2) / m) if m else 0.0

    def _balance(self, at: np.ndarray) -> float:
        pos, neg = (self.y[at] == 1).sum(0), (self.y[at] == 0).sum(0)
        return float((np.minimum(pos, neg) / np.maximum(np.maximum(pos, neg), 1)).mean())

    def _spread(self, cols: list[str], at: np.ndarray) -> float:
        n, s = len(at), 0.0
        if n < 2:
            return 0.0
        for k, x in self.x.items():
            if k in cols:
                v = np.sort(x[at])
                s += float((v * (2 * np.arange(n) - n + 1)).sum()) / (v[-1] - v[0] + 1e-12)
        for k, c in self.c.items():
            if k in cols:
                m = np.unique(c[at], return_counts=True)[1].astype(float)
                s += n * (n - 1) / 2 - float((m * (m - 1) / 2).sum())
        return s / len(cols) / (n * (n - 1) / 2)

    def _silhouette(self, cols: list[str], cl: np.ndarray, n: list[int]) -> float:
        d = np.zeros((2, len(cl)))
        for k, x in self.x.items():
            if k in cols:
                by = np.argsort(x, kind="stable")
                v = x[by]
                for side in (0, 1):
                    one = (cl[by] == side) * 1.0
                    kn, ks = np.cumsum(one) - one, np.cumsum(one * v) - one * v
                    later_n, later_s = n[side] - kn - one, (one * v).sum() - ks - one * v
                    d[side, by] += (v * kn - ks + later_s - v * later_n) / self.span[k]
        for k, c in self.c.items():
            if k in cols:
                for side in (0, 1):
                    d[side] += n[side] - np.bincount(c[cl == side], minlength=int(c.max()) + 1)[c]
        d /= len(cols)
        every = np.arange(len(cl))
        same, other, size = d[cl, every], d[1 - cl, every], np.array(n)[cl]
        a = np.where(size <= 1, 1.0, same / np.maximum(size - 1, 1))
        b = other / np.array(n)[1 - cl]
        top = np.maximum(a, b)
        return float(np.divide(b - a, top, out=np.zeros(len(cl)), where=top != 0).mean())

    def _independence(self, cols: list[str]) -> float:
        v = [self.x[k] - self.x[k].mean() for k in self.x if k in cols]
        r2 = 0.0
        for i, a in enumerate(v):
            for b in v[i + 1 :]:
                q = (a * a).sum() * (b * b).sum()
                r2 += float((a * b).sum() ** 2 / q) if q else 0.0
        return 1 - r2 / (len(v) * (len(v) - 1) / 2) if len(v) > 1 else 1.0

    def options(self, seed: str, tree: int, node: int, iterations: int, k: int, least: int, p: dict[str, float]) -> Iterator[tuple[int, list[str], float, np.ndarray]]:
        """(iter, cols, score, sides) of the valid candidates, one after the other."""
        cols = [*self.x, *self.c]
        for it in range(iterations if self.ab else 0):
            own = drawn_columns(seed, tree, node, it, cols, k)
            cl = self.sides(own, from_b(seed, tree, node, it))
            if cl is not None and (s := self.score(own, cl, least, p)) is not None:
                yield it, own, s, cl
