"""Exact Jaccard join of word shingle sets by signature trees, and the components of its links.

1. Each text becomes its set of shingles. Equal sets form one class (by two independent 64-bit hashes of each word).
2. Candidates: two sets of similarity J >= t differ in (a + b)(1 - t)/(1 + t) shingles at most. For a size level, the
   hash space is cut into more parts than that, so similar sets agree in some parts. A set has a signature for each
   of its non-empty parts; sets with a signature in common form its group. A level has spare parts enough for the empty ones
   that its sets are expected to have; a set with still more of them signs these too, so no link can be missed.
3. First each set is compared with the centre of each of its groups only (a star, not pairs): the set whose groups have
   the most members in all, as the original that copies were made from shares most with them. What that links is one component
   from here on. Then only groups with several components are left: small ones give their distinct pairs,
   large ones are joined as a whole.
4. Comparisons run over signature trees of the sets' sketches: nodes hold OR- and AND-combined bitmaps and size ranges; a
   dual traversal prunes node pairs by the greatest overlap they allow. What is left is verified by exact intersection: of
   the hashes first, then of the shingles' bytes. In a large group the traversal takes what the sketches allow as linked and skips
   what that connects; if verification refutes any of it, the group is joined once more over the texts themselves,
   every link verified where it is found. Large joins are dealt out as pairs of blocks.
5. The components of the verified links are those of the join.

Nodes are sets, not ids: rows that share an id and not a text are two documents.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_in, chunks, discard, exact, partitions, small_batches, text_bytes, trimmed, written
from .textkit import Words, mix, runs, shingles

SPARE = 2
#: A component with more documents or shingles than these is dealt out as pairs of blocks of about that size.
BLOCK_DOCS = 2_000
BLOCK_SHINGLES = 1_000_000
#: Signatures are shuffled in so many slices, one after the other: the disk holds one slice at a time.
SLICES = 2
#: Groups of at most so many sets give their pairs, each pair once however many groups it shares.
SMALL = 64
FANOUT = 16
_SALT = np.uint64(0xA0761D6478BD642F)


@dataclass(frozen=True)
class Rule:
    """Two documents link when 100 * shared >= percent * union, of their sets of ``width``-word shingles."""

    width: int = 3
    percent: int = 90

    def alike(self, shared, a, b):
        return (100 + self.percent) * shared >= self.percent * (a + b)

    def sized(self, less, more):
        """Whether a set of ``less`` shingles can be similar to one of ``more``."""
        return 100 * more >= self.percent * less


@functools.cache
def levels(percent: int = 90, top: int = 1 << 31) -> np.ndarray:
    """Upper sizes of the levels: similar sets are on the same level or on neighbouring ones."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, out[-1] * 100 // percent))
    return np.array(out)


def most_lost(n: int, upper: int, percent: int) -> int:
    """In how many shingles a set of n can differ from a similar one, if neither has more than ``upper``."""
    return min(2 * upper * (100 - percent) // (100 + percent), n * (100 - percent) // percent)


@functools.cache
def parts(level: int, percent: int = 90) -> int:
    """Parts of a level, 0 where only equal sets can be similar. More by SPARE + 1 than two sets can differ in, and
    by what the sets that sign here are expected to leave empty, with four deviations."""
    upper = int(levels(percent)[level])
    d, t = 2 * upper * (100 - percent) // (100 + percent), percent / 100
    if not d:
        return 0

    def short(k: int) -> float:
        """By how much the empty parts exceed what a set can spare; the largest and the smallest sets decide."""
        worst = -math.inf
        for n in (upper, t * upper, t * t * upper):
            e = k * math.exp(-n / k)
            worst = max(worst, e + 4 * math.sqrt(e) - (k - 1 - most_lost(int(n), upper, percent)))
        return worst

    best, spare = d + 1 + SPARE, SPARE
    while spare <= SPARE + d:
        k = d + 1 + spare
        if short(k) <= 0:
            return k
        best = min(best, k, key=short)
        spare += max(1, spare // 16)
    return best


def signatures(h: np.ndarray, percent: int = 90) -> np.ndarray:
    """A signature of each non-empty part of a sorted set, on its level and the next."""
    out, own = [], mix(h ^ _SALT)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own, dtype=np.uint64)])
    bounds = levels(percent)
    level = int(np.searchsorted(bounds, len(h)))
    for at in (level, level + 1):
        if k := parts(at, percent):
            edge = np.searchsorted(h, (np.arange(k, dtype=np.uint64) << np.uint64(32)) // np.uint64(k) << np.uint64(32))
            edge = np.append(edge, len(h))
            names = mix(np.arange(k, dtype=np.uint64) + np.uint64(at << 32))
            sig = mix((total[edge[1:]] - total[edge[:-1]]) ^ names)
            full = edge[1:] > edge[:-1]
            out.append(sig if (~full).sum() > k - 1 - most_lost(len(h), int(bounds[at]), percent) else sig[full])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def sets(texts: list[bytes], width: int = 3, families: tuple[int, ...] = (0,)) -> Iterator[tuple[np.ndarray, ...]]:
    """The sorted shingle set of each text, by each family of hashes."""
    for i, j in chunks(texts, 1 << 19):
        w = Words(texts[i:j], family=families[0])
        each = [shingles(w if f == families[0] else w.rehashed(f), width) for f in families]
        edge = runs(each[0][1], j - i)
        for d in range(j - i):
            yield tuple(np.unique(h[edge[d] : edge[d + 1]]) for h, _ in each)


def _name(h: np.ndarray) -> int:
    """One number for a set."""
    return int(mix(h ^ np.uint64(1)).sum(dtype=np.uint64).view(np.int64))


def sketch(h: np.ndarray) -> np.ndarray:
    """A bitmap of a set, of four to eight bits for each shingle, as words."""
    bits = max(64, 1 << (4 * len(h) - 1).bit_length())
    out = np.zeros(bits, bool)
    out[(h & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def _sketched(rule: Rule, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of (cid, n, f1, text) whose text has that name (else it is another text of the same id), with sketches."""
    for b in batches:
        own = [h for (h,) in sets(b["_t"].to_list(), rule.width)]
        b = b.assign(sketch=[sketch(h).tobytes() for h in own])
        yield b[np.array([_name(h) for h in own], np.int64) == b["f1"].to_numpy(np.int64)] if len(b) else b


def _measured(rule: Rule, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """n, f1, f2 of each row's set, and leader: the same for the rows of one set in a batch, else unique."""
    from pyspark import TaskContext

    leader = TaskContext.get().partitionId() << 40
    for b in batches:
        seen: dict[tuple, int] = {}
        rows = []
        for x, y in sets(b["_t"].to_list(), rule.width, (0, 1)):
            own = (max(len(x), len(y)), _name(x), _name(y))
            first = own not in seen
            if first:
                seen[own] = leader
                leader += 1
            rows.append((*own, seen[own], first))
        yield pd.concat([b.drop(columns="_t").reset_index(drop=True), pd.DataFrame(rows, columns=["n", "f1", "f2", "leader", "leads"])], axis=1)


def _signed(rule: Rule, part: int, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """sig, node: a slice of the signatures of each set of a batch, and its name (a coarse one: what it ties is verified)."""
    for b in batches:
        own: dict[int, np.ndarray] = {}
        for (h,) in sets(b["_t"].to_list(), rule.width):
            if len(h) and (k := _name(h)) not in own:
                sig = signatures(h, rule.percent)
                own[k] = sig[sig % np.uint64(SLICES) == part].view(np.int64)
        if own:
            names = np.repeat(np.array(list(own), np.int64), [len(x) for x in own.values()])
            yield pd.DataFrame({"sig": np.concatenate(list(own.values())), "node": names})


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node it can reach) for the nodes of edges (a, b); distributed, by contraction.

    Each round maps every node to the neighbour of the least hash, or to itself if its own is less, and that one to its
    own choice once more; the edges are relabelled and loops go. As the hash orders the nodes at random, whatever their
    ids, a round leaves a constant share of the nodes of a path or a star, so the rounds grow with the logarithm of
    the longest path. The hash changes every third round. Tables of older rounds are deleted.
    """
    edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().select("node", F.col("node").alias("label")), "labels")
    turn = 0
    while not edges.isEmpty():
        named = lambda c, k=turn // 3: F.struct(F.xxhash64(F.lit(k), c).alias("h"), F.col(c).alias("node"))
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = written(both.groupBy("a").agg(F.min(named("b")).alias("m")).select(F.col("a").alias("u"), F.least("m", named("a"))["node"].alias("q")), "choices")
        then = first.select(F.col("u").alias("q"), F.col("q").alias("p"))
        least = written(first.join(then.hint("merge"), "q").select("u", "p"), "parents")
        moved_labels = written(labels.join(least, labels["label"] == least["u"], "left").select("node", F.coalesce("p", "label").alias("label")), "labels")
        pa, pb = least.select(F.col("u").alias("a"), F.col("p").alias("pa")), least.select(F.col("u").alias("b"), F.col("p").alias("pb"))
        moved = written(edges.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        discard(edges, first, least, labels)
        edges, labels, turn = moved, moved_labels, turn + 1
    out = written(labels.join(labels.groupBy("label").agg(F.min("node").alias("least")).hint("merge"), "label").select("node", F.col("least").alias("label")), "labels")
    discard(edges, labels)
    return out


class Tree:
    """Sets of one block, in an order that puts similar ones side by side, under levels of FANOUT."""

    def __init__(self, n: np.ndarray, bits: np.ndarray, place: np.ndarray) -> None:
        self.place = place  # of each set among all sets of the task
        self.levels = [(bits, bits, n, n)]  # OR, AND, least and greatest size
        while len(self.levels[-1][2]) > 1:
            some, every, lo, hi = self.levels[-1]
            cut = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(some, cut), np.bitwise_and.reduceat(every, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)))

    def range(self, level: int, node: int) -> slice:
        return slice(node * FANOUT**level, min((node + 1) * FANOUT**level, len(self.place)))

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][2])))


def possible(x: Tree, i: int, xs: np.ndarray, y: Tree, j: int, ys: np.ndarray, rule: Rule) -> np.ndarray:
    """Which pairs of nodes xs (level i of x) and ys (level j of y) can hold a link, by size and greatest overlap."""
    (xor, xand, xlo, xhi), (yor, yand, ylo, yhi) = ([a[k] for a in t.levels[v]] for t, v, k in ((x, i, xs), (y, j, ys)))
    lost_x = np.bitwise_count(xand[:, None] & ~yor[None]).sum(2, dtype=np.int64)
    lost_y = np.bitwise_count(yand[None] & ~xor[:, None]).sum(2, dtype=np.int64)
    most = np.minimum(xhi[:, None] - lost_x, yhi[None] - lost_y)
    return rule.alike(most, xlo[:, None], ylo[None]) & rule.sized(ylo[None], xhi[:, None]) & rule.sized(xlo[:, None], yhi[None])


def linked(a: np.ndarray, b: np.ndarray, rule: Rule = Rule()) -> bool:
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return bool(rule.alike(shared, len(a), len(b)))


def exact_set(text: bytes, width: int) -> frozenset[bytes]:
    """The shingles of a text, byte by byte."""
    w = text.lower().split()  # ASCII case and white space, as in Words
    return frozenset(b" ".join(w[i : i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset()


def join(x: Tree, y: Tree, root: np.ndarray, rule: Rule, verified=None) -> Iterator[tuple[int, int]]:
    """Places of the pairs of x and y that can be linked. root: the component of each set of the task; with ``verified``, a
    test of two places, what it finds linked is joined there, and pairs that are connected already are skipped."""
    todo = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while todo:
        i, p, j, q = todo.pop()
        rx, ry = root[x.place[x.range(i, p)]], root[y.place[y.range(j, q)]]
        if rx[0] == ry[0] and (rx == rx[0]).all() and (ry == rx[0]).all():
            continue
        if i == 0 and j == 0:
            u, v = int(x.place[p]), int(y.place[q])
            if verified is None:
                yield u, v
            elif verified(u, v):
                a, b = sorted((int(rx[0]), int(ry[0])))
                root[root == b] = a
                yield u, v
            continue
        ps = x.children(i, p) if i and i >= j else np.array([p])
        qs = y.children(j, q) if j and j >= i else np.array([q])
        di, dj = i - (i >= j and i > 0), j - (j >= i and j > 0)
        ok = possible(x, di, ps, y, dj, qs, rule)
        if x is y and di == dj:
            ok &= ps[:, None] <= qs[None]
        # the closest last, to be taken first: their links spare others
        todo += [(di, int(ps[a]), dj, int(qs[b])) for a, b in sorted(zip(*np.nonzero(ok), strict=True), key=lambda t: -abs(int(ps[t[0]]) - int(qs[t[1]])))]


def _task(rows: list[tuple[int, int, int, bytes, int]], rule: Rule) -> list[tuple[int, int]]:
    """Pairs of classes of one task. rows: side, class, its component, and a sketch and its size, or a text and 0.

    Sketches: between two sides, all pairs that can be linked; within one, as many as connect what can be. Texts: as
    many links as connect what is linked.
    """
    held = {}
    for side, k, comp, raw, n in rows:
        held.setdefault((side, k), (comp, raw, n))
    keys, comps, raws, sizes = list(held), *([v[i] for v in held.values()] for i in range(3))
    if len(keys) < 2:
        return []
    whole = not all(sizes)
    own = [h for (h,) in sets(raws, rule.width)] if whole else []
    words = [sketch(h) for h in own] if whole else [np.frombuffer(r, np.uint64) for r in raws]
    n, least = np.array([len(h) for h in own] if whole else sizes), min(map(len, words))
    bits = np.stack([np.bitwise_or.reduce(w.reshape(-1, least), axis=0) for w in words])
    bounds = levels(rule.percent)
    order = np.lexsort((n, bits[:, 0], np.searchsorted(bounds, n) // 2))
    first: dict[int, int] = {}
    root, trees, side = np.array([first.setdefault(c, i) for i, c in enumerate(comps)]), [], np.array([s for s, _ in keys])
    for s in np.unique(side):
        at = order[side[order] == s]
        trees.append(Tree(n[at], bits[at], at))
    exact_of = functools.lru_cache(maxsize=64)(lambda k: exact_set(raws[k], rule.width))

    def verified(u: int, v: int) -> bool:
        if not linked(own[u], own[v], rule):
            return False
        a, b = exact_of(u), exact_of(v)
        return rule.alike(len(a & b), len(a), len(b))

    test = verified if whole else None if len(trees) > 1 else lambda u, v: u != v
    return [(keys[u][1], keys[v][1]) for u, v in join(trees[0], trees[-1], root, rule, test) if u != v]


def _joined(rule: Rule, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (task, side, cid, comp, raw, n) in the order of tasks; one task is held at a time."""
    last, rows = None, []
    for b in batches:
        out = []
        for t, *row in zip(b["task"], b["side"], b["cid"], b["comp"], b["raw"], b["n"], strict=True):
            if t != last and rows:
                out += [(last, *x) for x in _task(rows, rule)]
                rows = []
            last, row = t, tuple(row)
            if not rows or rows[-1][:2] != row[:2]:  # a row that is there twice
                rows.append(row)
        yield pd.DataFrame(out, columns=["task", "a", "b"])
    if rows:
        yield pd.DataFrame([(last, *x) for x in _task(rows, rule)], columns=["task", "a", "b"])


def _centred(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """cid, task, side for distinct pairs (centre, leaf): a task joins a centre with a block of its leaves."""
    p = pairs if "n" in pairs.columns else pairs.join(sizes.select(F.col("cid").alias("leaf"), "n"), "leaf")
    total = p.groupBy("centre").agg(F.ceil(F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    task = lambda k: F.concat_ws("/", F.lit("c"), "centre", k)
    leaves = p.join(total, "centre").select(F.col("leaf").alias("cid"), task(F.pmod(F.xxhash64("leaf"), "nb")).alias("task"), F.lit(1).alias("side"))
    centres = total.select(F.col("centre").alias("cid"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("k"), "centre").select("cid", task(F.col("k")).alias("task"), F.lit(0).alias("side"))
    return leaves.unionAll(centres)


def _compared(texts: DataFrame, dealt: DataFrame, rule: Rule, whole: bool) -> DataFrame:
    """(task, a, b) for dealt (cid, comp, task, side): what the sketches allow or, if whole, what the texts prove."""
    own = texts.select("cid", F.col("_t").alias("raw"), F.lit(0).cast("long").alias("n")) if whole else texts.select("cid", F.col("sketch").alias("raw"), "n")
    j = own.join(dealt.hint("merge"), "cid").select("task", "side", "cid", "comp", "raw", "n")
    j = j.repartition(partitions(texts.sparkSession), "task").sortWithinPartitions("task", "side", "cid")
    return j.mapInPandas(trimmed(functools.partial(_joined, rule)), "task string, a long, b long")


def _proved(texts: DataFrame, members: DataFrame, pairs: DataFrame, rule: Rule) -> DataFrame:
    """(a, b): the pairs (centre, leaf) that are links."""
    out = _compared(texts, _centred(pairs, members).withColumn("comp", F.col("cid")), rule, True)
    return out.select("a", "b")


def _tasks(members: DataFrame, rule: Rule) -> DataFrame:
    """cid, task, side for members (node, label, n): a group is one task, or pairs of blocks where it is large.

    Blocks are cut within a level by a hash of the id; only blocks of the same or neighbouring levels are paired.
    """
    bounds = ", ".join(str(x) for x in levels(rule.percent))
    m = members.withColumn("v", F.expr(f"CAST(aggregate(array({bounds}), 0L, (s, u) -> s + CAST(u < n AS INT)) AS INT)"))
    sizes = m.groupBy("label", "v").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    total = sizes.groupBy("label").agg((F.sum("c") <= BLOCK_DOCS).alias("small1"), (F.sum("w") <= BLOCK_SHINGLES).alias("small2"))
    cut = sizes.join(total, "label").select("label", "v", F.when(F.col("small1") & F.col("small2"), 0).otherwise(F.ceil(F.greatest(F.col("c") / BLOCK_DOCS, F.col("w") / BLOCK_SHINGLES))).cast("int").alias("nb"))
    # the numbers of blocks of the neighbouring levels, where a group has them; a row for each level of a group
    by = Window.partitionBy("label").orderBy("v")
    beside = lambda f, step: F.when(f("v").over(by) == F.col("v") + step, f("nb").over(by))
    cut = cut.withColumns({"down": beside(F.lag, -1), "up": beside(F.lead, 1)})
    m = m.join(cut, ["label", "v"])
    m = m.withColumn("k", F.pmod(F.xxhash64("node"), F.greatest("nb", F.lit(1))).cast("int"))
    block = lambda v, k: f"concat({v}, '.', {k})"
    pairs = f"""CASE WHEN nb = 0 THEN array(struct(CAST(label AS STRING) AS task, 0 AS side)) ELSE concat(
        transform(sequence(0, nb - 1), j -> struct(concat_ws('/', label, {block('v', 'least(j, k)')}, {block('v', 'greatest(j, k)')}) AS task, CAST(k > j AS INT) AS side)),
        CASE WHEN up > 0 THEN transform(sequence(0, up - 1), j -> struct(concat_ws('/', label, {block('v', 'k')}, {block('v + 1', 'j')}) AS task, 0 AS side)) ELSE array() END,
        CASE WHEN down > 0 THEN transform(sequence(0, down - 1), j -> struct(concat_ws('/', label, {block('v - 1', 'j')}, {block('v', 'k')}) AS task, 1 AS side)) ELSE array() END) END"""
    return m.select(F.col("node").alias("cid"), F.explode(F.expr(pairs)).alias("x")).select("cid", "x.task", "x.side")


def joined(docs: DataFrame, text: str = "text", key: str = "doc_id", rule: Rule = Rule(), small: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs; further columns are not read.

    component_id is the least doc_id of the rows that can be reached by links; ids may be of any type that has an order.
    Rows that share an id and not a text are two documents. A row without doc_id has no component and links nothing.
    A null or empty text, or one without words, has no shingles and is its own component; texts of any length are
    taken whole. Empty tables give no rows. small: groups of at most so many sets give their pairs, larger ones are
    joined as a whole; the result is the same. Any number of copies of a text costs as much as one after the first step;
    groups of near copies are never expanded into pairs.
    """
    return grouped(docs, text, key, rule, small).select("doc_id", "n_shingles", "component_id")


def grouped(docs: DataFrame, text: str = "text", key: str = "doc_id", rule: Rule = Rule(), small: int | None = None) -> DataFrame:
    """What ``joined`` returns, and digest, the md5 of each row's text, and group, a number for each component (null for
    rows without id or words): documents that share an id may be in different ones."""
    spark, small = docs.sparkSession, SMALL if small is None else small
    cols = docs.select(F.col(key).alias("doc_id"), text_bytes(text).alias("_t"))
    typed = cols.withColumn("digest", F.md5("_t"))
    with small_batches(spark):
        kinds = exact(typed).schema
        measured = exact(typed).mapInPandas(trimmed(functools.partial(_measured, rule)), f"doc_id {kinds['doc_id'].dataType.simpleString()}, digest string, n long, f1 long, f2 long, leader long, leads boolean")
        rows = written(as_in(measured, typed), "sets")
        own = rows.where("n > 0 AND doc_id IS NOT NULL")
        # a class has one row in each batch; the rest of its copies follow their leader
        classes = written(own.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep")).withColumn("cid", F.monotonically_increasing_id()), "classes")
        by, named = Window.partitionBy("sig"), cols.where("doc_id IS NOT NULL").select("_t")
        slices = []
        for i in range(SLICES):
            signed = named.mapInPandas(trimmed(functools.partial(_signed, rule, i)), "sig long, node long")
            signed = signed.withColumns({"lo": F.min("node").over(by), "hi": F.max("node").over(by)}).where("lo <> hi")
            slices.append(written(signed.select("sig", "node").distinct(), "shared"))
        shared = functools.reduce(DataFrame.unionAll, slices)
        nodes = shared.select("node").distinct()
        # the candidates grow with the documents: the same joins at every size, never a broadcast
        members = written(classes.join(nodes.hint("merge"), classes["f1"] == nodes["node"]).select("cid", "rep", "n", "f1"), "members")
        own_texts = cols.join(members.hint("merge"), cols["doc_id"] == members["rep"]).select("cid", "n", "f1", "_t")
        texts = written(own_texts.mapInPandas(trimmed(functools.partial(_sketched, rule)), "cid long, n long, f1 long, _t binary, sketch binary"), "texts")
        groups = written(shared.join(members.select("cid", "f1", "n").hint("merge"), shared["node"] == F.col("f1")).select("sig", "cid", "n"), "groups")
        discard(*slices)
        pair = lambda df: df.select(F.least("a", "b").alias("centre"), F.greatest("a", "b").alias("leaf")).distinct()

        wide = groups.withColumn("k", F.count("*").over(by)).groupBy("cid").agg(F.sum("k").alias("shares"))
        centred = groups.join(wide.hint("merge"), "cid").withColumn("centre", F.max(F.struct("shares", "cid")).over(by)["cid"])
        stars = written(centred.where("cid <> centre").select("centre", F.col("cid").alias("leaf"), "n").distinct(), "stars")
        near = _compared(texts, _centred(stars, members).withColumn("comp", F.col("cid")), rule, False)
        near_pairs = written(pair(near), "pairs")
        near = components(_proved(texts, members, near_pairs, rule))
        known = members.join(near, members["cid"] == near["node"], "left").select("cid", F.coalesce("label", "cid").alias("comp"))
        whole = groups.join(known, "cid").withColumns({"lo": F.min("comp").over(by), "hi": F.max("comp").over(by), "k": F.count("*").over(by)})
        open_ = written(whole.where("lo <> hi").select("sig", "cid", "n", "comp", "k"), "open")
        few = open_.where(F.col("k") <= small).groupBy("sig").agg(F.array_sort(F.collect_list(F.struct("cid", "n", "comp"))).alias("g"))
        fits = f"y.comp <> x.comp AND 100 * least(x.n, y.n) >= {rule.percent} * greatest(x.n, y.n)"
        few = few.select(F.explode(F.expr(f"flatten(transform(g, (x, i) -> transform(filter(slice(g, i + 2, size(g)), y -> {fits}), y -> struct(x.cid AS centre, y.cid AS leaf, y.n AS n))))")).alias("p"))
        few = few.select("p.centre", "p.leaf", "p.n").distinct().join(stars.select(F.least("centre", "leaf").alias("centre"), F.greatest("centre", "leaf").alias("leaf")), ["centre", "leaf"], "left_anti")
        large = open_.where(F.col("k") > small).select(F.col("cid").alias("node"), F.col("sig").alias("label"), "n")
        large = written(_tasks(large, rule).withColumn("task", F.concat(F.lit("g"), "task")).join(known, "cid"), "large")
        allowed = written(_compared(texts, _centred(few, members).join(known, "cid").unionByName(large), rule, False), "allowed")
        more = written(_proved(texts, members, pair(allowed), rule), "links")
        # large groups where an allowed pair is no link: once more, by texts
        refuted = allowed.where("task LIKE 'g%'").select("task", F.least("a", "b").alias("centre"), F.greatest("a", "b").alias("leaf")).join(pair(more), ["centre", "leaf"], "left_anti").select("task").distinct()
        rest = _compared(texts, large.join(refuted, "task", "left_semi"), rule, True).select("a", "b")
        final = components(near.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(more).unionAll(rest))
        found = members.join(final, members["cid"] == final["node"]).select("cid", "rep", final["label"].alias("group"))
        least = found.groupBy("group").agg(F.min("rep").alias("component"))
        found = found.join(least, "group").select("cid", "group", "component")
        reps = classes.join(found, "cid", "left").select("n", "f1", "f2", F.coalesce("group", "cid").alias("group"), F.coalesce("component", "rep").alias("component"))
        leaders = own.where("leads").select("leader", "n", "f1", "f2").join(reps, ["n", "f1", "f2"]).select("leader", "group", "component")
        led = own.join(leaders, "leader").select("doc_id", "digest", "n", "group", "component")
        rest = rows.where("NOT (n > 0 AND doc_id IS NOT NULL)").select("doc_id", "digest", "n", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component"))
        out = written(led.unionAll(rest).select("doc_id", "digest", "group", F.col("n").alias("n_shingles"), F.col("component").alias("component_id")), "components")
    discard(rows, classes, members, texts, groups, stars, near_pairs, near, open_, large, allowed, more, final)
    return out


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"), small=16)


#: Brute force: all pairs that share a shingle, and what their links reach.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.reach)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(reach) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
