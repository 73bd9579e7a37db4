"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of a collection of documents.

Round j inserts the suffix of length j of every document that has one: its place follows from the place of the suffix
of length j - 1 and a count of symbols, its common prefixes with both neighbours from those of the round before.
Symbols, prefixes and origins lie in files that each round reads and rewrites from end to end. The rounds are as many
as the longest document has bytes, so the work is their number times the collection: right, but not within bounds for
documents of any length. op6 therefore uses passage_dedup; this one is held against it in the tests.
"""

from __future__ import annotations

import os

import numpy as np


class Column:
    """A sequential file of numbers."""

    def __init__(self, folder: str, name: str, values: np.ndarray) -> None:
        self.path, self.kind = os.path.join(folder, name), values.dtype
        self.write(values)

    def read(self) -> np.ndarray:
        return np.fromfile(self.path, self.kind)

    def write(self, values: np.ndarray) -> None:
        values.astype(self.kind).tofile(self.path)


def inserted(old: np.ndarray, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    out = np.empty(len(old) + len(at), old.dtype)
    rest = np.ones(len(out), bool)
    rest[at] = False
    out[rest], out[at] = old, values
    return out


def construct(texts: list[bytes], folder: str, rounds: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, prefixes, document, start) of all suffixes in order; symbols are bytes + 1, 0 before a whole document."""
    m = len(texts)
    symbols = Column(folder, "symbols", np.zeros(m, np.uint16))
    common = Column(folder, "common", np.zeros(m, np.int32))
    doc, start = Column(folder, "doc", np.arange(m, dtype=np.int32)), Column(folder, "start", np.array([len(t) for t in texts], np.int32))
    active, place = np.arange(m), np.arange(m)
    for j in range(1, 1 + max(map(len, texts), default=0)):
        if rounds is not None and j > rounds:
            break
        more = np.array([len(texts[i]) >= j for i in active], bool)
        active, place = active[more], place[more]
        b, lcp = symbols.read(), common.read()
        b[place] = [texts[i][-j] + 1 for i in active]
        order = np.argsort(b, kind="stable")
        rank = np.empty(len(b), np.int64)
        rank[order] = np.arange(len(b))
        t = rank[place]
        at = m + t - int((b == 0).sum())

        def least(lo: np.ndarray, hi: np.ndarray, lcp: np.ndarray = lcp) -> np.ndarray:
            """1 + the least of lcp[lo + 1 .. hi] for each pair."""
            pairs = np.stack([lo + 1, hi + 1], 1).ravel()
            return 1 + np.minimum.reduceat(np.append(lcp, 0), pairs)[::2] if len(lo) else np.zeros(0, np.int64)

        before, after = np.zeros(len(t), np.int64), np.zeros(len(t), np.int64)
        has = (t > 0) & (b[order[t - 1]] == b[place])
        before[has] = least(order[t[has] - 1], place[has])
        nxt = np.minimum(t + 1, len(order) - 1)
        has = (t + 1 < len(order)) & (b[order[nxt]] == b[place])
        after[has] = least(place[has], order[nxt[has]])
        by = np.argsort(at)
        at_sorted = at[by]
        new = inserted(lcp, at_sorted, before[by])
        below = at + 1 < len(new)
        new[at[below] + 1] = after[below]
        common.write(new)
        symbols.write(inserted(b, at_sorted, np.zeros(len(at), np.uint16)))
        doc.write(inserted(doc.read(), at_sorted, active[by]))
        start.write(inserted(start.read(), at_sorted, np.array([len(texts[i]) - j for i in active[by]])))
        place = at
    return symbols.read(), common.read(), doc.read(), start.read()


def repeated(texts: list[bytes], folder: str, length: int = 100) -> set[tuple[int, int]]:
    """(document, start) of each string of ``length`` bytes that also starts earlier."""
    _, lcp, doc, start = construct(texts, folder)
    group = np.cumsum(lcp < length)
    order = np.lexsort((start, doc, group))
    again = np.zeros(len(order), bool)
    again[order[1:]] = group[order][1:] == group[order][:-1]
    # the first of a group is the earliest; suffixes shorter than length stand alone
    return set(zip(doc[again].tolist(), start[again].tolist(), strict=True))
