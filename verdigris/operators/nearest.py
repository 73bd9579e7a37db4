"""The nearest or the farthest member of a group for each query row, by an exact index instead of all pairs.

The distance is that of the mixed tables: absolute differences over a span for each number, 1 for each category that
differs, summed in the order of the columns. Members of a group are dealt into shards of about SHARD rows, by cuts
at quantiles of the widest column, WAYS at once; a shard fits a task. In it, different members stand in leaves of LEAF rows and leaves
in blocks of BLOCK, each with a bounding box (ranges of the numbers, the categories that occur). A query looks at blocks, then at their
leaves, in the order of their lower bounds and stops when the bound proves that no other leaf holds a nearer member or an equal one.
It is searched in the shard that it falls into first; the distance found there and the boxes of the group's shards decide which others
are asked at all.

Queries of a shard are dealt into parts, each with a copy of the shard, so a shard that many ask isn't one task.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.sources.shared import cut

SHARD = 65_536
#: Parts that a shard is cut into at once.
WAYS = 8
LEAF = 32
#: Leaves of a block.
BLOCK = 32
#: Queries of a shard that go to one task.
QUERIES = 262_144
#: Queries that a task searches at once, and leaves that it compares at once.
SOME = 4_096
#: Blocks, and leaves of a block, that queries look at one after the other before they look at all that are left.
FIRST = 3
#: Different categories of a column beyond which leaves don't tell them apart.
CODES = 4_096
#: More than any error of rounding in a sum.
SLACK = 1e-11


def _table(c: list[list] | np.ndarray, n: int) -> np.ndarray:
    c = np.array(c, object)
    return c.reshape(n, -1) if c.size else np.zeros((n, 0), object)


class Index:
    """The leaves of one shard. key: of each member, any type with an order; x, c: its numbers and categories. Of equal members
    only the one of the least key is held, or all of them."""

    def __init__(self, key: list | np.ndarray, x: np.ndarray, c: list[list] | np.ndarray, span: np.ndarray, every: bool = False) -> None:
        n = len(key)
        c = _table(c, n)
        key = np.asarray(key) if not len(key) or not isinstance(key[0], str) else np.array(key, object)
        order = np.argsort(key, kind="stable")
        key, x, c = key[order], x[order], c[order]
        self.names, code = [], np.zeros((n, c.shape[1]), np.int64)
        for j in range(c.shape[1]):
            code[:, j], names = pd.factorize(c[:, j])
            code[code[:, j] < 0, j] = len(names)  # null
            self.names.append(pd.Index(names, dtype=object))
        if not every:
            first = ~pd.DataFrame(np.concatenate([x, code], 1)).duplicated().to_numpy()
            key, x, code = key[first], x[first], code[first]
        self.key, self.span = key, span
        leaves = self._leaves(x / span if x.shape[1] else x, code)
        size, n = max(map(len, leaves)), -(-len(leaves) // BLOCK) * BLOCK
        self.place = np.zeros((n, size), np.int64)
        self.there = np.zeros((n, size), bool)
        for i, leaf in enumerate(leaves):
            self.place[i, : len(leaf)], self.there[i, : len(leaf)] = leaf, True
        self.x, self.code = x[self.place], code[self.place]
        shown = self.there[:, :, None]
        self.lo, self.hi = np.where(shown, self.x, np.inf).min(1), np.where(shown, self.x, -np.inf).max(1)
        self.real = self.there.any(1)
        self.has: list = []  # of a column: by leaf and by block, whether it has each category and how many it has
        for j, names in enumerate(self.names):
            if len(names) > CODES:
                self.has.append(None)
                continue
            own = np.zeros((n, len(names) + 2), bool)
            own[np.repeat(np.arange(n), size)[self.there.ravel()], self.code[:, :, j][self.there]] = True
            above = own.reshape(-1, BLOCK, own.shape[1]).any(1)
            self.has.append([(h, h.sum(1)) for h in (own, above)])
        by = lambda f, v: f(v.reshape(len(v) // BLOCK, BLOCK, v.shape[1]), 1)
        self.block_lo, self.block_hi = by(np.min, self.lo), by(np.max, self.hi)

    @staticmethod
    def _leaves(x: np.ndarray, code: np.ndarray) -> list[np.ndarray]:
        """Places by leaf, in the order of keys within each: halves along the widest column; a category is as wide as 1. Leaves
        next to each other are near each other."""
        out, todo = [], [np.arange(max(len(x), len(code)))]
        while todo:
            at = todo.pop()
            if len(at) <= LEAF:
                out.append(np.sort(at))
                continue
            wide = np.concatenate([np.ptp(x[at], axis=0) if x.shape[1] else np.zeros(0), (code[at] != code[at[0]]).any(0) * 1.0])
            d = int(wide.argmax())
            half = len(at) // 2
            if wide[d] > 0:
                v = x[at, d] if d < x.shape[1] else code[at, d - x.shape[1]]
                by = np.argsort(v, kind="stable")
                if d >= x.shape[1]:  # whole categories on either side
                    edge = np.flatnonzero(np.diff(v[by])) + 1
                    half = int(edge[np.abs(edge - half).argmin()])
                at = at[by]
            todo += [at[:half], at[half:]]
        return out

    def codes(self, c: list[list] | np.ndarray, n: int) -> np.ndarray:
        """Codes of the categories of n queries; those that no member has share one more."""
        c = _table(c, n)
        out = np.zeros((n, len(self.names)), np.int64)
        for j, names in enumerate(self.names):
            at = names.get_indexer(c[:, j])
            out[:, j] = np.where(pd.isna(c[:, j]), len(names), np.where(at < 0, len(names) + 1, at))
        return out

    def _bounds(self, level: int, x: np.ndarray, own: np.ndarray, at: np.ndarray | None, far: bool) -> np.ndarray:
        """Lower bounds of the distance of queries to all blocks (level 1), or to the leaves at (level 0, a row for each query)."""
        lo, hi = (self.block_lo, self.block_hi) if level else (self.lo, self.hi)
        pick = (lambda v: v[None]) if at is None else (lambda v: v[at])
        bound = np.zeros((len(x), len(lo) if at is None else at.shape[1]))
        for j in range(x.shape[1]):
            below, above = pick(lo[:, j]) - x[:, j, None], x[:, j, None] - pick(hi[:, j])
            bound += (-np.maximum(np.abs(below), np.abs(above)) if far else np.maximum(np.maximum(below, above), 0)) / self.span[j]
        for j, has in enumerate(self.has):
            if has is None:
                bound -= far
                continue
            own_has = has[level][0][:, own[:, j]].T if at is None else has[level][0][at, own[:, j, None]]
            if far:  # one with another category than the query's
                bound -= pick(has[level][1]) > own_has
            else:
                bound += ~own_has
        return bound if level else np.where(pick(self.real), bound, np.inf)

    def search(self, x: np.ndarray, c: list[list] | np.ndarray, best: np.ndarray, digits: int | None, far: bool = False, itself: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, distance, members looked at) of each query's nearest member, ties to the least key; place -1 where none is
        as near as best. far: of the farthest one; distances count negative, so that the farthest is the least. itself: a place
        that each query may not find, -1 for none."""
        n = len(x)
        own = self.codes(c, n)
        slack = SLACK * (1 + x.shape[1]) + (0 if digits is None else 10.0**-digits)
        best, place, looked = best.copy(), np.full(n, -1), np.zeros(n, np.int64)

        def look(q: np.ndarray, leaf: np.ndarray) -> None:
            """Queries at one leaf each; a query may come several times."""
            d = np.zeros((len(q), self.place.shape[1]))
            for j in range(x.shape[1]):
                d += np.abs(x[q, j, None] - self.x[leaf, :, j]) / self.span[j]
            for j in range(own.shape[1]):
                d += own[q, j, None] != self.code[leaf, :, j]
            d = np.where(self.there[leaf], (d if digits is None else np.round(d, digits)) * (-1 if far else 1), np.inf)
            if itself is not None:
                d[self.place[leaf] == itself[q, None]] = np.inf
            np.add.at(looked, q, self.there[leaf].sum(1))
            k = d.argmin(1)  # the least key of the equal ones
            d, p = d[np.arange(len(q)), k], self.place[leaf, k]
            order = np.lexsort((p, d, q))
            order = order[np.diff(q[order], prepend=-1) > 0]  # the best leaf of each query
            q, d, p = q[order], d[order], p[order]
            better = (d < best[q]) | ((d == best[q]) & ((place[q] < 0) | (p < place[q])))
            best[q[better]], place[q[better]] = d[better], p[better]

        def inside(q: np.ndarray, block: np.ndarray, first: int) -> None:
            """Queries at one block each: the first leaves one after the other, then the others."""
            leaves = block[:, None] * BLOCK + np.arange(BLOCK)
            bound = self._bounds(0, x[q], own[q], leaves, far)
            for _ in range(first):
                k = bound.argmin(1)
                at = np.flatnonzero(bound[np.arange(len(q)), k] <= best[q] + slack)
                if not len(at):
                    return
                look(q[at], leaves[at, k[at]])
                bound[at, k[at]] = np.inf
            i, k = np.nonzero(bound <= best[q, None] + slack)
            for s in range(0, len(i), 2 * SOME):
                a, b = i[s : s + 2 * SOME], k[s : s + 2 * SOME]
                live = np.flatnonzero(bound[a, b] <= best[q[a]] + slack)
                if len(live):
                    look(q[a[live]], leaves[a[live], b[live]])

        bound = self._bounds(1, x, own, None, far)
        for _ in range(FIRST):
            k = bound.argmin(1)
            q = np.flatnonzero(bound[np.arange(n), k] <= best + slack)
            if not len(q):
                return place, best, looked
            inside(q, k[q], FIRST)
            bound[q, k[q]] = np.inf
        q, k = np.nonzero(bound <= best[:, None] + slack)
        order = np.argsort(bound[q, k], kind="stable")  # the nearest first
        q, k = q[order], k[order]
        for s in range(0, len(q), SOME):
            a, b = q[s : s + SOME], k[s : s + SOME]
            live = np.flatnonzero(bound[a, b] <= best[a] + slack)
            if len(live):
                inside(a[live], b[live], 0)
        return place, best, looked


def _searched(digits: int | None, numbers: int, categories: int, far: bool, apart: bool, onward: bool, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, g, nearest, d, looked, shard, x, c) for queries; rows come by (g, shard, part, kind): one of kind 0 with the group's spans and the boxes
    of its shards, the members of kind 1, the queries of kind 2. onward: also a row for each other shard that can hold a member
    as near as the one found, with the query's columns."""
    xs, cs = [f"x{i}" for i in range(numbers)], [f"c{i}" for i in range(categories)]
    shown = ["key", "g", "nearest", "d", "looked", *(["shard", *xs, *cs] if onward else [])]
    last, held, index, span, boxes = None, [], None, None, None
    for b in batches:
        out: list[pd.DataFrame] = []
        names = list(zip(b["g"], b["shard"].tolist(), b["part"].tolist(), strict=True))
        edge = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for i, j in itertools.pairwise(edge):
            if i == j:
                continue
            if names[i] != last:
                last, held, index = names[i], [], None
            own = b.iloc[i:j]
            kind = own["kind"].to_numpy()
            if (kind == 0).any():
                known = np.asarray(own["known"].iloc[0], float)
                span, boxes = known[:numbers], known[numbers:].reshape(-1, 1 + 2 * numbers)
            if (kind == 1).any():
                held.append(own.loc[kind == 1, ["key", *xs, *cs]])
            asked = own[kind == 2]
            if not len(asked):
                continue
            if index is None and held:
                members = pd.concat(held) if len(held) > 1 else held[0]
                index = Index(members["key"].to_numpy(), members[xs].to_numpy(float), members[cs].to_numpy(object), span, apart)
                held = []
                if apart:
                    at_key = {k: i for i, k in enumerate(index.key.tolist())}
            for k in range(0, len(asked), SOME):
                some = asked.iloc[k : k + SOME]
                x, best = some[xs].to_numpy(float), some["best"].to_numpy(float)
                if index is not None:
                    itself = np.array([at_key.get(k, -1) for k in some["key"]]) if apart else None
                    place, best, looked = index.search(x, some[cs].to_numpy(object), best, digits, far, itself)
                    found = np.flatnonzero(place >= 0)
                    out.append(some.iloc[found][["key", "g"]].assign(nearest=index.key[place[found]], d=best[found], looked=looked[found]))
                if onward:
                    lo, hi = boxes[:, 1 : 1 + numbers], boxes[:, 1 + numbers :]
                    bound = np.full((len(x), len(boxes)), -float(categories) if far else 0.0)
                    for m in range(numbers):
                        below, above = lo[None, :, m] - x[:, m, None], x[:, m, None] - hi[None, :, m]
                        bound += (-np.maximum(np.abs(below), np.abs(above)) if far else np.maximum(np.maximum(below, above), 0)) / span[m]
                    q, s = np.nonzero((bound <= best[:, None] + 1e-8) & (boxes[:, 0] != last[1]))
                    out.append(some.iloc[q][["key", "g", *xs, *cs]].assign(d=best[q], shard=boxes[s, 0].astype(np.int64)))
        for o in out:
            yield pd.DataFrame({name: pd.Series(o[name].to_numpy(object) if name in o else [None] * len(o), dtype=object) if name not in o or not pd.api.types.is_numeric_dtype(o[name]) else o[name].to_numpy() for name in shown})


def _asked(members: DataFrame, known: DataFrame, queries: DataFrame, kind: str, numbers: int, categories: int, digits: int | None, far: bool, apart: bool, onward: bool) -> DataFrame:
    """key, g, nearest, d, looked: queries (key, g, x, c, shard, best) searched in their shards. known: g and the numbers of ``_searched``.
    onward: also shard, x0, .., c0, ..; rows with a shard say where else to ask."""
    spark = members.sparkSession
    of = ["g", "shard"]
    flat = lambda t: [*(F.element_at("x", i + 1).alias(f"x{i}") if t else F.lit(None).cast("double").alias(f"x{i}") for i in range(numbers)), *(F.element_at("c", i + 1).alias(f"c{i}") if t else F.lit(None).cast("string").alias(f"c{i}") for i in range(categories))]
    parts = cut(queries.groupBy(*of).agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")))  # a row for each shard
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    nothing, never = F.lit(None).cast("array<double>").alias("known"), F.lit(0.0).alias("best")
    head = parts.join(known, "g").select(*of, each, F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("key"), *flat(False), never, "known")
    copies = members.join(F.broadcast(parts), of).select(*of, each, F.lit(1).alias("kind"), "key", *flat(True), never, nothing)
    dealt = queries.join(F.broadcast(parts), of).select(*of, F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"), F.lit(2).alias("kind"), "key", *flat(True), "best", nothing)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = reduce(DataFrame.unionByName, [head, copies, dealt]).repartition(n, *of, "part").sortWithinPartitions(*of, "part", "kind")
    schema = [f"key {kind}, g string, nearest {kind}, d double, looked long"]
    if onward:
        schema += ["shard long", *(f"x{i} double" for i in range(numbers)), *(f"c{i} string" for i in range(categories))]
    return rows.mapInPandas(functools.partial(_searched, digits, numbers, categories, far, apart, onward), ", ".join(schema))


def _cut_up(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows moved to a part of their shard where that is cut."""
    x = F.element_at("x", F.col("dim") + 1)
    side = F.when(F.col("dim") < 0, F.pmod(F.xxhash64("key", "shard"), F.lit(WAYS))).when(F.col("strict"), (x >= F.element_at("at", 1)).cast("long")).otherwise(F.size(F.filter("at", lambda b: b < x)).cast("long"))
    return rows.join(F.broadcast(cuts), ["g", "shard"], "left").withColumn("shard", F.when(F.col("dim").isNull(), F.col("shard")).otherwise(WAYS * F.col("shard") + side)).drop("dim", "at", "strict")


def _sharded(members: DataFrame, numbers: int) -> tuple[DataFrame, list[DataFrame]]:
    """Members with their shard, and the cuts of each round (a row for each shard that is cut): g, shard, dim (-1: by a hash), at (the bounds),
    strict (the one bound belongs to the right part)."""
    rows, rounds = members.withColumn("shard", F.lit(1).cast("long")), []
    share = [i / WAYS for i in range(1, WAYS)]
    for _ in range(20):  # the digits of a shard's number
        x = lambda i: F.element_at("x", i + 1)
        large = cut(rows.groupBy("g", "shard").agg(F.count("*").alias("n"), *(f(x(i)).alias(f"{k}{i}") for i in range(numbers) for k, f in (("lo", F.min), ("hi", F.max))), F.first("span").alias("span")).where(F.col("n") > SHARD))
        if large.isEmpty():
            break
        wide = [F.struct(((F.col(f"hi{i}") - F.col(f"lo{i}")) / F.element_at("span", i + 1)).alias("w"), F.lit(i).alias("dim"), F.col(f"hi{i}").alias("hi")) for i in range(numbers)]
        none = F.struct(F.lit(0.0).alias("w"), F.lit(-1).alias("dim"), F.lit(0.0).alias("hi"))
        best = F.greatest(none, *wide) if wide else none
        dims = large.select("g", "shard", "n", best.alias("b")).select("g", "shard", "n", F.when(F.col("b.w") > 0, F.col("b.dim")).otherwise(-1).alias("dim"), "b.hi")
        v = F.when(F.col("dim") < 0, F.lit(0.0)).otherwise(F.element_at("x", F.greatest(F.col("dim"), F.lit(0)) + 1)) if numbers else F.lit(0.0)
        own = rows.join(F.broadcast(dims), ["g", "shard"]).groupBy("g", "shard", "dim", "hi", "n").agg(F.percentile_approx(v, share, 1_000).alias("q"))
        # as many parts as are needed, of equal steps among the quantiles
        step = F.greatest(F.lit(1), F.floor(F.lit(WAYS * SHARD * 0.75) / F.col("n")).cast("int"))
        some = F.array_distinct(F.filter("q", lambda b, i: (b < F.col("hi")) & ((i + 1) % F.least(step, F.lit(WAYS // 2)) == 0)))
        cuts = cut(own.select("g", "shard", "dim", F.when(F.size(some) > 0, some).otherwise(F.array("hi")).alias("at"), (F.size(some) == 0).alias("strict")))
        rounds.append(cuts)
        rows = cut(_cut_up(rows, cuts))
    return rows, rounds


def nearest(members: DataFrame, queries: DataFrame, by: list[str], key: str, numeric: list[str], categorical: list[str], spans: DataFrame | None = None, digits: int | None = None, farthest: bool = False, apart: bool = False) -> DataFrame:
    """key, by, nearest, d, looked: for each query row the nearest member of its group (``by``), ties to the least key.

    d is the sum over columns, not their mean; with digits, rounded to so many before it is compared. spans: by and
    span_<col> for each number; else the range over the group's members and queries. A column that a group leaves out is the same
    in all of its rows. Numbers have no nulls; a null category equals only nulls. A query may be asked once for each group. looked: how
    many members were compared with the query. Queries of groups without members have no row. farthest: the farthest member
    instead, ties to the least key. apart: a query does not find the member of its own key.
    """
    kind = members.schema[key].dataType.simpleString()
    if spans is None:
        every = members.select(*by, *numeric).unionAll(queries.select(*by, *numeric))
        spans = every.groupBy(*by).agg(*((F.max(c) - F.min(c) + 1e-12).alias(f"span_{c}") for c in numeric), F.lit(0).alias("_"))
    numbers, categories = len(numeric), len(categorical)
    named = F.to_json(F.struct(*by)).alias("g")
    span = F.array(*(F.col(f"span_{c}").cast("double") for c in numeric)).cast("array<double>").alias("span")
    x = F.array(*(F.col(c).cast("double") for c in numeric)).cast("array<double>").alias("x")
    c = F.array(*(F.col(c).cast("string") for c in categorical)).cast("array<string>").alias("c")
    held = members.join(spans, by).select(named, F.col(key).alias("key"), x, c, span)
    rows, rounds = _sharded(cut(held), numbers)
    asked = queries.select(named, F.col(key).alias("key"), x, c, F.lit(float("inf")).alias("best"), F.lit(1).cast("long").alias("shard"))
    for cuts in rounds:
        asked = _cut_up(asked, cuts)
    box = rows.groupBy("g", "shard").agg(F.first("span").alias("span"), *(f(F.element_at("x", i + 1)).alias(f"{k}{i}") for k, f in (("lo", F.min), ("hi", F.max)) for i in range(numbers)))
    box = box.groupBy("g").agg(F.first("span").alias("span"), F.flatten(F.collect_list(F.array(F.col("shard").cast("double"), *(f"{k}{i}" for k in ("lo", "hi") for i in range(numbers))))).alias("boxes"))  # a row for each group
    known = cut(box.select("g", F.concat("span", "boxes").alias("known")))
    ask = functools.partial(_asked, rows, known, kind=kind, numbers=numbers, categories=categories, digits=digits, far=farthest, apart=apart)
    asked = cut(asked)
    found = ask(asked, onward=bool(rounds))
    if rounds:
        found = cut(found)
        flat = F.array(*(f"x{i}" for i in range(numbers))).cast("array<double>").alias("x"), F.array(*(f"c{i}" for i in range(categories))).cast("array<string>").alias("c")
        more = ask(found.where("shard IS NOT NULL").select("g", "key", *flat, F.col("d").alias("best"), "shard"), onward=False)
        both = found.where("shard IS NULL").select("key", "g", "nearest", "d", "looked").unionAll(more).groupBy("key", "g").agg(F.min(F.struct("d", "nearest", "looked")).alias("x"), F.sum("looked").alias("n"))
        found = both.select("key", "g", "x.nearest", "x.d", F.col("n").alias("looked"))
    groups = cut(queries.select(*by).distinct().select(*by, F.to_json(F.struct(*by)).alias("_g")))  # a row for each group
    return found.select(F.col("g").alias("_g"), F.col("key").alias("_key"), "nearest", (-F.col("d") if farthest else F.col("d")).alias("d"), "looked").join(groups, "_g").select(F.col("_key").alias(key), *by, "nearest", "d", "looked")
