"""Near duplicates by SimHash: fingerprints, and the components of those within a few bits of each other.

1. A text's words are folded (A-Z lower-cased, white space to one space) and its 3-word shingles, repeats included,
   are hashed; a bit of the fingerprint is set where over half of the hashes have it.
2. The search runs over distinct fingerprints, by the general pigeonhole principle: the 64 bits are cut into
   partitions, correlated bits together. A fingerprint gets a threshold t_i of its own for each partition, so that the
   (t_i + 1) add up to RADIUS + 1: if it is further than t_i from another one in every partition, it is further than
   RADIUS in all. So a fingerprint that probes every value within t_i of its own in each partition meets all of its
   links. The thresholds are allocated by dynamic programming on the numbers of candidates that are to be
   expected, from exact histograms of the sub-partitions; frequent values are left out (t_i = -1) where others are cheaper.
3. A bucket holds the fingerprints that have or probe one value of one partition. Members are verified by their bits.
   A bucket with more than BUCKET members is dealt out anew: the bits outside its partition are cut into blocks, and
   members meet for each choice of RADIUS blocks, agreeing in all others. Two linked members do so for some choice, and
   as few bits are left open, such a bucket is bounded by their number. So nothing is skipped and nothing expanded
   into all pairs, however many copies a text has.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_in, discard, exact, partitions, small_batches, text_bytes, written
from .ngram_join import components

WIDTH = 3
SEED = 42
RADIUS = 2
#: Fingerprints of a bucket that are compared with each other; larger buckets are dealt out anew.
BUCKET = 1_024
#: Bits of a block, of RADIUS of which a fine bucket leaves the bits open.
BLOCK_BITS = 5
#: Bits of a sub-partition whose histogram is held.
SUB_BITS = 11
#: What one more probe costs, in candidates.
PROBE = 4.0
#: Shingles that are hashed before their bits are counted.
CHUNK = 1 << 16
_FOLD = bytes(0x20 if 0x09 <= b <= 0x0D else b + 32 if 65 <= b <= 90 else b for b in range(256))


def fold(text: bytes) -> bytes:
    """The words of a text, A-Z lower-cased, with one space between them."""
    t = text.translate(_FOLD).strip(b" ")
    while b"  " in t:
        t = t.replace(b"  ", b" ")
    return t


def fingerprint(text: bytes) -> int:
    """The SimHash of a text, unsigned; 0 for one without words."""
    t = fold(text)
    if not t:
        return 0
    gaps = np.flatnonzero(np.frombuffer(t, np.uint8) == 0x20)
    if len(gaps) < WIDTH - 1:
        return xxhash.xxh64_intdigest(t, SEED)
    # a shingle goes from the word after one gap to the WIDTH-th gap from there
    start, end = np.append(-1, gaps[: len(gaps) - WIDTH + 1]) + 1, np.append(gaps[WIDTH - 1 :], len(t))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(start), CHUNK):
        h = np.array([digest(t[s:e], SEED) for s, e in zip(start[i : i + CHUNK].tolist(), end[i : i + CHUNK].tolist(), strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(start), bitorder="little").view("<u8")[0])


def _fingerprinted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fp = np.array([fingerprint(t) for t in b["_t"]], np.uint64).view(np.int64)
        yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fp (a signed long) for each row of docs."""
    cols = docs.select(F.col(key).alias("doc_id"), text_bytes(text).alias("_t"))
    named = exact(cols)
    return as_in(named.mapInPandas(_fingerprinted, f"doc_id {named.schema['doc_id'].dataType.simpleString()}, fp long"), cols.select("doc_id"))


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(i, j, n): how often bits i and j are set together."""
    n = np.zeros((64, 64))
    for b in batches:
        x = _bits(b["fp"].to_numpy(np.int64)).astype(np.float32)
        n += x.T @ x
    i, j = np.nonzero(n)
    yield pd.DataFrame({"i": i, "j": j, "n": n[i, j].astype(np.int64)})


def grouped_bits(together: np.ndarray, total: int, m: int) -> list[list[int]]:
    """m partitions of the bits: each starts from the most correlated pair that is left and takes the bit that is most
    correlated with it on average."""
    p = np.diag(together) / max(total, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(together / max(total, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, -1)
    left, out = list(range(64)), []
    for k in range(m):
        size = -(-len(left) // (m - k))
        sub = corr[np.ix_(left, left)]
        a, b = np.unravel_index(sub.argmax(), sub.shape)
        own = sorted({left[a], left[b]})
        rest = [x for x in left if x not in own]
        while len(own) < size:
            best = rest[int(corr[np.ix_(rest, own)].mean(1).argmax())]
            own.append(best)
            rest.remove(best)
        out.append(sorted(own))
        left = rest
    return out


def mask(bits: Iterable[int]) -> int:
    return sum(1 << b for b in bits)


def flips(bits: list[int], most: int) -> list[np.ndarray]:
    """By distance from 0 to most: the masks of so many of the bits."""
    return [np.array([mask(c) for c in itertools.combinations(bits, d)], np.uint64) for d in range(most + 1)]


def _packed(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint as a small number."""
    return sum(((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << k for k, b in enumerate(bits))


def subs(bits: list[int]) -> list[list[int]]:
    k = -(-len(bits) // SUB_BITS)
    return [bits[i * len(bits) // k : (i + 1) * len(bits) // k] for i in range(k)]


def _counted(groups: list[list[int]], batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(s, v, n): how many fingerprints have the value v in sub-partition s."""
    all_ = [s for g in groups for s in subs(g)]
    n = [np.zeros(1 << len(s), np.int64) for s in all_]
    for b in batches:
        fp = b["fp"].to_numpy(np.int64).view(np.uint64)
        for c, s in zip(n, all_, strict=True):
            c += np.bincount(_packed(fp, s), minlength=len(c))
    at = [np.flatnonzero(c) for c in n]
    yield pd.DataFrame({"s": np.repeat(np.arange(len(n)), [len(a) for a in at]), "v": np.concatenate(at), "n": np.concatenate([c[a] for c, a in zip(n, at, strict=True)])})


@dataclass
class Allocator:
    """Thresholds of fingerprints by dynamic programming. shares[i][k][v]: what share of all fingerprints is at distance
    0, 1, .. from value v in the k-th sub-partition of partition i."""

    groups: list[list[int]]
    shares: list[list[np.ndarray]]
    total: int

    @classmethod
    def of(cls, groups: list[list[int]], counts: list[np.ndarray], total: int) -> "Allocator":
        it, shares = iter(counts), []
        for g in groups:
            own = []
            for s in subs(g):
                n, v = next(it), np.arange(1 << len(s))
                at = [sum((n[v ^ mask(c)] for c in itertools.combinations(range(len(s)), d)), np.zeros(len(n))) for d in range(RADIUS + 1)]
                own.append(np.stack(at, 1) / max(total, 1))
            shares.append(own)
        return cls(groups, shares, total)

    def costs(self, fp: np.ndarray) -> np.ndarray:
        """[fingerprint, partition, t + 1]: expected candidates and probes for a threshold t."""
        out = np.zeros((len(fp), len(self.groups), RADIUS + 2))
        for i, g in enumerate(self.groups):
            far = np.zeros((len(fp), RADIUS + 1))
            far[:, 0] = 1
            for s, share in zip(subs(g), self.shares[i], strict=True):  # sub-partitions count as independent
                own = share[_packed(fp, s)]
                far = np.stack([sum(far[:, d - e] * own[:, e] for e in range(d + 1)) for d in range(RADIUS + 1)], 1)
            probes = np.cumsum([math.comb(len(g), d) for d in range(RADIUS + 1)])
            out[:, i, 1:] = self.total * np.cumsum(far, 1) + PROBE * probes
        return out

    def allocate(self, fp: np.ndarray) -> np.ndarray:
        """[fingerprint, partition]: thresholds, -1 for none, of the least cost; the (t + 1) add up to RADIUS + 1."""
        cost, units = self.costs(fp), RADIUS + 1
        best = np.full((len(fp), units + 1), np.inf)
        best[:, 0], took = 0, []
        for i in range(len(self.groups)):
            options = np.stack([np.stack([best[:, b - u] + cost[:, i, u] if u <= b else np.full(len(fp), np.inf) for u in range(units + 1)], 1) for b in range(units + 1)], 1)
            took.append(options.argmin(2))
            best = options.min(2)
        out, left = np.zeros((len(fp), len(self.groups)), np.int64), np.full(len(fp), units)
        for i in reversed(range(len(self.groups))):
            u = took[i][np.arange(len(fp)), left]
            out[:, i], left = u - 1, left - u
        return out


def _dealt(plan: Allocator, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(part, v, fp): the values that each fingerprint has and those that it probes."""
    each = [flips(g, RADIUS) for g in plan.groups]
    for b in batches:
        fp = b["fp"].to_numpy(np.int64).view(np.uint64)
        t = plan.allocate(fp)
        part, v, of = [], [], []
        for i, g in enumerate(plan.groups):
            own = fp & np.uint64(mask(g))
            for d, m in enumerate(each[i]):
                k = np.flatnonzero(t[:, i] >= d) if d else np.arange(len(fp))
                v.append((own[k][:, None] ^ m[None]).ravel())
                of.append(np.repeat(fp[k], len(m)))
                part.append(np.full(len(v[-1]), i))
        yield pd.DataFrame({"part": np.concatenate(part), "v": np.concatenate(v).view(np.int64), "fp": np.concatenate(of).view(np.int64)})


def _dealt_finely(groups: list[list[int]], batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(part, v, open, rest, fp): a key for each choice of RADIUS blocks of the bits outside the partition."""
    fixed = []
    for g in groups:
        rest = [b for b in range(64) if b not in g]
        k = -(-len(rest) // BLOCK_BITS)
        blocks = [rest[i * len(rest) // k : (i + 1) * len(rest) // k] for i in range(k)]
        fixed.append(np.array([mask(rest) - mask(itertools.chain(*c)) for c in itertools.combinations(blocks, RADIUS)], np.uint64))
    for b in batches:
        part, fp = b["part"].to_numpy(np.int64), b["fp"].to_numpy(np.int64).view(np.uint64)
        for i, f in enumerate(fixed):
            at = np.flatnonzero(part == i)
            for j in range(0, len(at), 2_048):
                k = at[j : j + 2_048]
                yield pd.DataFrame({"part": i, "v": np.repeat(b["v"].to_numpy(np.int64)[k], len(f)), "open": np.tile(np.arange(len(f)), len(k)), "rest": (fp[k][:, None] & f[None]).ravel().view(np.int64), "fp": np.repeat(fp[k], len(f)).view(np.int64)})


def spanning(fp: np.ndarray) -> Iterator[tuple[np.uint64, np.ndarray]]:
    """(root, others) for the components of fingerprints by their links, where others are not empty."""
    left = np.unique(fp)
    while len(left) > 1:
        root, left = left[0], left[1:]
        todo = np.array([root])
        while len(todo) and len(left):
            some, todo = todo[:256], todo[256:]
            near = (np.bitwise_count(some[:, None] ^ left[None]) <= RADIUS).any(0)
            if near.any():
                yield root, left[near]
                todo, left = np.concatenate([todo, left[near]]), left[~near]


#: Buckets of so many rows are compared side by side.
FEW = 8


def _linked(keys: list[str], batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, b) that connect what is linked within a bucket. Rows come in the order of their keys."""
    held = None
    for b in itertools.chain(batches, [None]):
        rows = pd.concat([x for x in (held, b) if x is not None], ignore_index=True) if held is not None or b is not None else None
        if rows is None or not len(rows):
            continue
        key, fp = rows[keys].to_numpy(np.int64), rows["fp"].to_numpy(np.int64).view(np.uint64)
        edge = np.append(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1))), len(rows))
        if b is not None:  # the last bucket may go on
            held, edge = rows.iloc[edge[-2] :], edge[:-1]
            if len(edge) < 2:
                continue
        size, left, right = np.diff(edge), [], []
        few = np.repeat(size <= FEW, size)
        bucket = np.repeat(np.arange(len(size)), size)
        for d in range(1, FEW):
            n = len(few) - d
            if n <= 0:
                break
            at = np.flatnonzero(few[:n] & (bucket[:n] == bucket[d:]))
            at = at[(np.bitwise_count(fp[at] ^ fp[at + d]) <= RADIUS) & (fp[at] != fp[at + d])]
            left.append(fp[at])
            right.append(fp[at + d])
        for i in np.flatnonzero(size > FEW):
            for root, others in spanning(fp[edge[i] : edge[i + 1]]):
                left.append(np.full(len(others), root))
                right.append(others)
        if left:
            yield pd.DataFrame({"a": np.concatenate(left).view(np.int64), "b": np.concatenate(right).view(np.int64)})


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): enough links between the fingerprints (fp, distinct) to connect all that are linked."""
    spark = distinct.sparkSession
    total = distinct.count()
    m = min(4, max(2, 64 // max(1, total.bit_length())))
    counts = np.zeros((64, 64))
    for r in distinct.mapInPandas(_together, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():  # 64 x 64 at most
        counts[r.i, r.j] = r.n
    groups = grouped_bits(counts, total, m)
    sizes = [np.zeros(1 << len(s)) for g in groups for s in subs(g)]
    for r in distinct.mapInPandas(functools.partial(_counted, groups), "s int, v int, n long").groupBy("s", "v").agg(F.sum("n").alias("n")).collect():  # 2**SUB_BITS for each sub-partition at most
        sizes[r.s][r.v] = r.n
    plan = Allocator.of(groups, sizes, total)
    dealt = written(distinct.mapInPandas(functools.partial(_dealt, plan), "part int, v long, fp long"), "dealt")
    # sums of what tasks have counted themselves; single rows have nothing to meet
    shared = dealt.groupBy("part", "v").agg(F.count("*").alias("n")).where("n > 1")
    own = written(dealt.join(shared.hint("merge"), ["part", "v"]), "buckets")
    discard(dealt)

    def met(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.repartition(partitions(spark), *keys).sortWithinPartitions(*keys).mapInPandas(functools.partial(_linked, list(keys)), "a long, b long")

    coarse = met(own.where(F.col("n") <= BUCKET).select("part", "v", "fp"), "part", "v")
    fine = own.where(F.col("n") > BUCKET).select("part", "v", "fp").mapInPandas(functools.partial(_dealt_finely, groups), "part int, v long, open int, rest long, fp long")
    out = written(coarse.unionAll(met(fine, "part", "v", "open", "rest")).distinct(), "links")
    discard(own)
    return out


def joined(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of docs; further columns are not read.

    component_id is the least doc_id of the rows that can be reached by links of RADIUS or fewer differing bits; ids
    may be of any type that has an order. A null or empty text, or one without words, has fingerprint zero and is
    linked like any other. A text of fewer than three words is one shingle. Texts of any length are taken whole. Rows that share
    an id and not a text are two documents; repeated rows are there as often as in docs. A row without doc_id has a
    fingerprint, no component, and links nothing. Empty tables give no rows.
    """
    with small_batches(docs.sparkSession):
        rows = written(fingerprints(docs, text, key), "fingerprints")
    own = written(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    found = links(own.select("fp"))
    of = components(found)
    # only what has links moves to another row's id
    tied = own.join(of.hint("merge"), own["fp"] == of["node"]).select("fp", "rep", "label")
    least = tied.groupBy("label").agg(F.min("rep").alias("least"))
    moved = tied.join(least.hint("merge"), "label").select("fp", "least")
    reps = own.join(moved.hint("merge"), "fp", "left").select("fp", F.coalesce("least", "rep").alias("component"))
    out = rows.join(reps.hint("merge"), "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"))
    out = written(out, "components")
    discard(rows, own, found, of)
    return out


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))
