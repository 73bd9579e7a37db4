"""Byte-level BPE as a monoid: encodings of neighbouring byte strings are joined, never rebuilt.

A piece is halved recursively; short halves are encoded by plain merges. Two encodings are joined by re-encoding a
window of tokens around the seam. A token sequence is the encoding of its bytes if and only if each two neighbours
are the encoding of theirs, so the tokens outside a window are proven stable once the window's first and last token
form such pairs with the tokens beside it; until then the window doubles on the side that fails. Decoding
concatenates the tokens' bytes up the same tree.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_in, exact, kept, trimmed

#: Halves of at most so many bytes (when decoding, tokens) are the leaves of the tree.
LEAF = 24
#: Windows of more bytes are merged with a heap.
PLAIN = 32
#: Encodings that a worker remembers at most before it starts anew.
MEMORY = 300_000
#: Pairs of tokens that it knows to be stable or not, likewise.
PAIRS = 150_000
#: White space beside a space: such texts cannot be cut at every single space.
_ODD = re.compile(r" \s|\s |\n\s|\s\n|[\x1c-\x1f\x85\r\v\f]")


class Monoid:
    """Encoder and decoder for the ranks of a vocabulary (bytes to rank)."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}

    def merge(self, s: bytes) -> list[int]:
        """Plain merges: the least rank first, the leftmost of equals."""
        if len(s) > PLAIN:
            return self.long_merge(s)
        ranks, parts = self.ranks, [s[i : i + 1] for i in range(len(s))]
        costs = [ranks.get(s[i : i + 2], 1 << 60) for i in range(len(s) - 1)]
        while costs and (least := min(costs)) < 1 << 60:
            i = costs.index(least)
            parts[i] += parts.pop(i + 1)
            costs.pop(i)
            if i:
                costs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
            if i < len(costs):
                costs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
        return [ranks[p] for p in parts]

    def long_merge(self, s: bytes) -> list[int]:
        """The same merges with a heap of pairs and linked neighbours, for windows of many tokens."""
        ranks, n = self.ranks, len(s)
        end, before = list(range(1, n + 1)), list(range(-1, n))  # of the part that begins at a place; 0: none begins there
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(s[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            m = end[i]
            if not m or m >= n or end[m] != e:
                continue  # a pair that a merge has changed
            end[i], end[m] = e, 0
            if e < n:
                before[e] = i
                if (r := ranks.get(s[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if i and (r := ranks.get(s[before[i] : e])) is not None:
                heapq.heappush(heap, (r, before[i], e))
        return [ranks[s[i : end[i]]] for i in range(n) if end[i]]

    def stable(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def decode(self, ids: list[int]) -> bytes:
        """The tokens' bytes, concatenated up a tree: halves of at most LEAF tokens first, then neighbours."""
        parts = [b"".join([self.bytes_of[t] for t in ids[i : i + LEAF]]) for i in range(0, len(ids), LEAF)]
        while len(parts) > 1:
            parts = [b"".join(parts[i : i + 2]) for i in range(0, len(parts), 2)]
        return parts[0] if parts else b""

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        i, j = 1, 1  # tokens of either side in the window
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(self.decode(left[len(left) - i :] + right[:j]))
            ok_left = i == len(left) or self.stable(left[-i - 1], window[0])
            ok_right = j == len(right) or self.stable(window[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if ok_left else 2 * i, j if ok_right else 2 * j

    def tree(self, s: bytes) -> list[int]:
        if len(s) <= LEAF:
            return self.merge(s)
        half = len(s) // 2
        return self.join(self.tree(s[:half]), self.tree(s[half:]))

    def encode(self, piece: bytes) -> list[int]:
        """One match of the pattern. A piece that is a token as a whole is that token, reachable by merges or not."""
        whole = self.ranks.get(piece)
        return self.tree(piece) if whole is None else [whole]


class Encoder:
    """Whole texts, cut by a pattern; distinct units are encoded once."""

    def __init__(self, monoid: Monoid, pattern: str) -> None:
        import regex

        self.monoid, self.split = monoid, regex.compile(pattern).findall
        self.after: dict[str, tuple[int, ...]] = {}  # units that follow a space
        self.first: dict[str, tuple[int, ...]] = {}

    def unit(self, text: str) -> tuple[int, ...]:
        out: list[int] = []
        for p in self.split(text):
            out += self.monoid.encode(p.encode())
        return tuple(out)

    def __call__(self, text: str) -> list[int]:
        """The ids of a text.

        Where no white space stands beside a space or line end, a single space between other characters starts a
        match of the pattern and a line end is a match of its own, so lines and words can be encoded apart.
        """
        if not text:
            return []
        if _ODD.search(text):
            return list(self.unit(text))
        after, first, out = self.after, self.first, []
        if len(after) > MEMORY or len(first) > MEMORY:
            after.clear()
            first.clear()
        for n, line in enumerate(text.split("\n")):
            if n:
                if (u := first.get("\n")) is None:
                    u = first["\n"] = self.unit("\n")
                out += u
            words = line.split(" ")
            if (u := first.get(words[0])) is None:
                u = first[words[0]] = self.unit(words[0])
            out += u
            for w in words[1:]:
                if (u := after.get(w)) is None:
                    u = after[w] = self.unit(" " + w)
                out += u
        return out


def read_ranks(data: str) -> dict[bytes, int]:
    """A rank file: base64 of a token and its rank in each line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """Kept by a worker from task to task."""
    with open(path) as f:
        return Encoder(Monoid(read_ranks(f.read())), pattern)


kept("bpe", encoder.cache_clear)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row: texts encoded, then decoded from their ids.

    path: a rank file that every executor has. Null texts are empty: no ids, digests of nothing; texts of any length are
    taken whole, in n log n steps even where they are one piece. Null ids stay null. Repeated rows are encoded one by
    one; empty tables give no rows; further columns are not read. Nothing is shuffled.
    """

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = encoder(path, pattern)
        names = [str(i) for i in range(max(own.monoid.bytes_of) + 1)]
        for b in batches:
            counts, of_ids, of_bytes = [], [], []
            for t in b["_t"]:
                ids = own(t)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.monoid.decode(ids)).hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": pd.Series(counts, dtype="int64"), "ids_sha256": of_ids, "decoded_sha256": of_bytes})

    own = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    cols = exact(own)
    return as_in(cols.mapInPandas(trimmed(work, "bpe"), f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"), own)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
