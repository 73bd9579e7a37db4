"""Vectorised kernels over many texts at once: words, 64-bit word and shingle hashes, windows.

Words are runs of bytes other than space and 0x09-0x0D. The hash of a span takes its bytes by eights, each mixed into
the state before the next, so no algebraic pattern of the bytes cancels out; spans over LONG bytes get a keyed
cryptographic digest. Equal bytes give equal hashes in any process. ``numbered`` is exact: it compares the bytes.
The polynomial of ``rolling`` is for choosing places only (equal bytes, equal values); nothing is taken as equal by it.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np

_SEED = np.random.Generator(np.random.PCG64(20240607))
BYTE = _SEED.integers(0, 2**64, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
PLACE = _SEED.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_S33, _S29 = np.uint64(33), np.uint64(29)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S33)) * _M1
    h = (h ^ (h >> _S29)) * _M2
    return h ^ (h >> _S33)


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n, BASE, np.uint64)
    down = np.full(n, pow(BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**j and BASE**-j modulo 2**64, for j up to at least n."""
    return _powers(1 << max(16, int(n).bit_length()))


def rolling(buf: np.ndarray, width: int) -> np.ndarray:
    """A number for each window of ``width`` bytes, the same for the same bytes."""
    up, down = powers(len(buf))
    pre = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTE[buf] * up[: len(buf)], dtype=np.uint64, out=pre[1:])
    n = len(buf) - width + 1
    return (pre[width:] - pre[:n]) * down[:n]


#: Spans over so many bytes are digested one by one.
LONG = 256
_KEYS = _SEED.integers(0, 2**64, (4, 2), dtype=np.uint64) | np.uint64(1)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def eights(buf: np.ndarray) -> np.ndarray:
    """The eight bytes at each place of buf as a number, zeros after its end."""
    return np.ndarray(len(buf) + 1, "<u8", buffer=np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))


def span_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, family: int = 0, view: np.ndarray | None = None) -> np.ndarray:
    """A mixed 64-bit hash of buf[start:end] for each pair; families are independent of each other."""
    view, n, (k, seed) = eights(buf) if view is None else view, end - start, _KEYS[family]
    h = mix(n.astype(np.uint64) * seed)
    at = np.flatnonzero((n > 0) & (n <= LONG))
    for off in range(0, LONG, 8):
        if not len(at):
            break
        left = n[at] - off
        h[at] = mix(h[at] ^ ((view[start[at] + off] & _MASK[np.minimum(left, 8)]) * k))
        at = at[left > 8]
    for i in np.flatnonzero(n > LONG):
        h[i] = np.frombuffer(hashlib.blake2b(buf[start[i] : end[i]].tobytes(), digest_size=8, key=seed.tobytes()).digest(), "<u8")[0]
    return h


def _unlike(view: np.ndarray, buf: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> bool:
    """Whether any span differs from the one that ``first`` names for it."""
    n, other = end - start, start[first]
    if (n != n[first]).any():
        return True
    at = np.flatnonzero(other != start)
    for off in range(0, LONG, 8):
        if not len(at):
            return False
        left = n[at] - off
        mask = _MASK[np.minimum(left, 8)]
        if ((view[start[at] + off] & mask) != (view[other[at] + off] & mask)).any():
            return True
        at = at[left > 8]
    return any((buf[start[i] + LONG : end[i]] != buf[other[i] + LONG : other[i] + n[i]]).any() for i in at)


def numbered(buf: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, first): equal numbers for equal bytes and no others; the first span of each number. Hashes only
    propose: all spans of a number are compared with its first."""
    _, first, at = np.unique(hashes, return_index=True, return_inverse=True)
    if len(start) and _unlike(eights(buf), buf, start, end, first[at]):
        known: dict[bytes, int] = {}
        raw = buf.tobytes()
        at = np.array([known.setdefault(raw[s:e], len(known)) for s, e in zip(start.tolist(), end.tolist(), strict=True)])
        first = np.unique(at, return_index=True)[1]
    return at, first


class Words:
    """Words of some texts. start, end: in buf; doc: index of the text; hash: by family; count: words of each text."""

    def __init__(self, texts: list[bytes], lower: bool = True, family: int = 0) -> None:
        buf = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
        self.buf = buf = LOWER[buf] if lower else buf
        gap = SPACE[buf]
        self.start = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
        self.end = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        self.base = np.cumsum([1, *(len(t) + 1 for t in texts)])  # where each text begins
        edge = np.searchsorted(self.start, self.base)
        self.first, self.count = edge[:-1], np.diff(edge)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        self.hash = span_hash(buf, self.start, self.end, family)

    def rehashed(self, family: int) -> "Words":
        """The same words with the hashes of another family."""
        out = object.__new__(Words)
        out.__dict__ = {**self.__dict__, "hash": span_hash(self.buf, self.start, self.end, family)}
        return out

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def shingles_at(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text index and first word of each window of k words, in order of texts."""
    n = len(w.hash) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h += w.hash[at + j] * PLACE[j]
    return mix(h), w.doc[at], at


def shingles(w: Words, k: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each window of k words, in order of texts. whole: fewer words count as one window."""
    h, doc, _ = shingles_at(w, k)
    short = np.flatnonzero((w.count > 0) & (w.count < k)) if whole else np.zeros(0, int)
    if len(short):
        extra = np.array([int(mix(np.array([np.sum(w.hash[f : f + c] * PLACE[:c], dtype=np.uint64) + np.uint64(c)], np.uint64))[0]) for f, c in zip(w.first[short], w.count[short], strict=True)], np.uint64)
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        h, doc = h[order], doc[order]
    return h, doc


def runs(doc: np.ndarray, n: int) -> np.ndarray:
    """Where each text's part of a sorted text index begins; n + 1 long."""
    return np.searchsorted(doc, np.arange(n + 1))
