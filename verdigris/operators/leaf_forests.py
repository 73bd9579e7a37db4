"""Random forests for many leaves, labels and trees at once, grown level by level from histograms.

Every (group, label) has a forest of its own. Values of a column fall into BINS bins of equal width within the group. A row
counts in a tree as often as a hash draws it (Poisson of mean 1, the bootstrap of large samples). Rows stay one for each member,
with the draws of all trees and labels in one value; groups are dealt into parts of PART rows, which meet the splits made so
far by a cogroup, so a group of any size is never one task's. On a level, each part counts its draws by (label, tree, place, column,
bin) and class in arrays, and Spark adds the parts up. Splits are chosen from these sums, a few bins for each node and column.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.expressions import draw
from verdigris.sources.shared import cut

BINS = 32
#: Shares of rows that a tree draws at most 0, 1, 2, .. times.
POISSON = [round(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)), 6) for k in range(6)]
LEAST_GAIN = 1e-9
#: Rows of a group that one call counts or predicts.
PART = 32_768
#: Draws that a task holds at once.
DRAWS = 500_000


def unit(seed: str, *cols: str | Column) -> Column:
    """A hash in [0, 1)."""
    return F.conv(F.substring(draw(seed, *cols), 1, 8), 16, 10).cast("double") / 4294967296.0


def edges(train: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """group, lo_<col>, hi_<col> over the training rows."""
    return train.groupBy(*group).agg(*(f(c).cast("double").alias(f"{k}_{c}") for c in cols for k, f in (("lo", F.min), ("hi", F.max))))


def binned(rows: DataFrame, spans: DataFrame, group: list[str], cols: list[str], keep: list[Column | str]) -> DataFrame:
    """group, kept columns, _b0, _b1, ..: the bin of each column; values outside the training rows' range count as its ends."""
    at = lambda c: F.floor(F.coalesce(F.try_divide(F.col(c).cast("double") - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)) * BINS)
    return rows.join(spans, group).select(*group, *keep, *(F.least(F.greatest(at(c), F.lit(0)), F.lit(BINS - 1)).cast("short").alias(f"_b{i}") for i, c in enumerate(cols)))


def _parts(rows: DataFrame, sizes: DataFrame, group: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """rows with their part of the group, and group, _part of all parts; sizes: group, n."""
    parts = sizes.select(*group, F.ceil(F.col("n") / PART).cast("int").alias("_parts"))
    each = parts.select(*group, F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    return rows.join(parts, group).withColumn("_part", F.pmod(F.xxhash64(key), "_parts").cast("int")).drop("_parts"), each


def _with_draws(seed: str, labels: int, trees: int, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """_w in place of _k, the key as text: how often each tree of each label draws the row, a byte for each."""
    least = np.array([math.ceil(p * 4294967296.0) for p in POISSON])
    names = [f"{seed}|{t}|{i}|".encode() for i in range(labels) for t in range(trees)]
    for b in batches:
        out, some = [], max(1, DRAWS // len(names))
        for at in range(0, len(b), some):
            hashes = b"".join([hashlib.md5(p + k).digest() for k in map(str.encode, b["_k"].iloc[at : at + some]) for p in names])
            w = np.searchsorted(least, np.frombuffer(hashes, ">u4")[::4], side="right").astype(np.uint8)
            out += [r.tobytes() for r in w.reshape(-1, len(names))]
        yield b.drop(columns="_k").assign(_w=out)


def _of_two(f: Callable) -> Callable:
    """f as a function that Spark sees to take two tables, not a key too."""
    return lambda a, b: f(a, b)


@functools.lru_cache(maxsize=1 << 18)
def _drawn(seed: str, label: int, rt: int, place: int, cols: int, k: int) -> list[int]:
    """The k columns of a node: those with the least hash."""
    return sorted(range(cols), key=lambda c: (hashlib.md5(f"{seed}col|{label}|{rt}|{place}|{c}".encode()).hexdigest(), c))[:k]


def _walked(bins: np.ndarray, col: np.ndarray, at: np.ndarray, steps: int) -> np.ndarray:
    """The place (row, tree) of each row of bins after steps splits, 0 once a leaf is passed. col, at: of (tree, place), col -1 for none."""
    place, tree, row = np.ones((len(bins), len(col)), np.int64), np.arange(len(col))[None], np.arange(len(bins))[:, None]
    for _ in range(steps):
        c = col[tree, place]
        place = np.where(c < 0, 0, 2 * place + (bins[row, np.maximum(c, 0)] > at[tree, place]))
    return place


def _counted(level: int, last: bool, seed: str, cols: int, labels: int, trees: int, k: int, group: list[str], rows: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """Draws of a part by label, rt, place, column, bin and class; column -1: of the whole node. known: the splits of earlier levels,
    and a row of rt -1 for each label that has both classes."""
    names, out = ["label", "rt", "place", "col", "at", "n0", "n1"], []
    n, width = len(rows), 1 << level
    if n and len(known):
        bins = rows[[f"_b{i}" for i in range(cols)]].to_numpy(np.int64)
        w = np.frombuffer(b"".join(rows["_w"]), np.uint8).reshape(n, labels, trees)
        split = known[known["rt"] >= 0]
        for i in known["label"][known["rt"] < 0]:
            own = split[split["label"] == i]
            col, at = np.full((trees, width), -1), np.zeros((trees, width), np.int64)
            col[own["rt"], own["place"]], at[own["rt"], own["place"]] = own["col"], own["at"]
            place = _walked(bins, col, at, level)
            row, tree = np.nonzero((w[:, i] > 0) & (place > 0))
            node, weight, y = tree * width + place[row, tree] - width, w[row, i, tree], rows[f"_y{i}"].to_numpy(np.int64)[row]

            def add(code: np.ndarray, of, label: int = i, weight: np.ndarray = weight, y: np.ndarray = y) -> np.ndarray:
                m = np.bincount(2 * code + y, weight)
                m = np.append(m, np.zeros(len(m) % 2)).reshape(-1, 2).astype(np.int64)
                there = np.flatnonzero(m.any(1))
                nodes, c, b = of(there)
                out.append(np.column_stack([np.full(len(there), label), nodes // width, nodes % width + width, c, b, m[there]]))
                return nodes

            there = add(node, lambda x: (x, np.full(len(x), -1), np.zeros(len(x), np.int64)))
            if not last:
                drawn = np.zeros((trees * width, k), np.int64)
                for x in there.tolist():
                    drawn[x] = _drawn(seed, int(i), x // width, x % width + width, cols, k)
                for j in range(k):
                    c = drawn[node, j]
                    add((node * cols + c) * BINS + bins[row, c], lambda x: (x // (cols * BINS), x // BINS % cols, x % BINS))
    done = pd.DataFrame(np.concatenate(out) if out else np.zeros((0, len(names)), np.int64), columns=names)
    return pd.concat([pd.DataFrame({c: [rows[c].iloc[0]] * len(done) for c in group}, index=done.index), done], axis=1) if len(done) else done.reindex(columns=[*group, *names])


def fit(train: DataFrame, group: list[str], key: str, cols: list[str], labels: list[str], trees: int = 12, depth: int = 4, balanced: bool = False, seed: str = "leaf", least_rows: int = 2) -> dict[str, DataFrame]:
    """edges, nodes and shares of the forests of labels (0 or 1) of train, by group.

    nodes: group, label, rt (the tree), place (a heap number), col and at (rows of bins up to at go left; null for a leaf), gain (of the weighted
    Gini impurity, times the node's weight), prob (share of ones). shares: group, label, n, ones. A node draws round(sqrt(columns))
    columns by hash; it takes the cut of the greatest gain (at 9 digits; ties to the first column, then the least bin) that leaves both
    sides some weight. Nodes of one class, of weight below least_rows, without a gain, or at depth are leaves. balanced:
    a row weighs n / (2 * rows of its class) more. Values have no nulls.
    """
    spans = cut(edges(train, group, cols))
    k = max(1, int(math.sqrt(len(cols)) + 0.5))
    long = train.select(*group, F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(c).cast("int").alias("y")) for i, c in enumerate(labels)))).alias("s"))
    shares = cut(long.groupBy(*group, "s.label").agg(F.count("*").alias("n"), F.sum("s.y").alias("ones")))
    # a constant label needs no forest
    mixed = shares.where("ones > 0 AND ones < n")
    rows = binned(train, spans, group, cols, [F.col(key).alias("_key"), *(F.col(c).cast("short").alias(f"_y{i}") for i, c in enumerate(labels))])
    rows, parts = _parts(rows, mixed.groupBy(*group).agg(F.max("n").alias("n")), group, "_key")
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    kept = [c for c in rows.columns if c != "_key"]
    draws = functools.partial(_with_draws, seed, len(labels), trees)
    rows = cut(rows.select(*kept, F.col("_key").cast("string").alias("_k")).mapInPandas(draws, ", ".join([*(f"`{c}` {kind[c]}" for c in kept), "_w binary"])))
    by, done = [*group, "label", "rt", "place"], []
    splits = mixed.select(*group, "label", F.lit(-1).alias("rt"), F.lit(0).cast("long").alias("place"), F.lit(-1).alias("col"), F.lit(-1).alias("at"))
    of = [*group, "_part"]
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in group), "label int, rt int, place long, col int, at int, n0 long, n1 long"])
    for level in range(depth + 1):
        count = functools.partial(_counted, level, level == depth, seed, len(cols), len(labels), trees, k, group)
        counts = rows.groupBy(*of).cogroup(splits.join(parts, group).groupBy(*of)).applyInPandas(_of_two(count), schema)
        counts = cut(counts.groupBy(*by, "col", "at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
        if balanced:
            each = lambda m: F.col("n") / (2.0 * m)
            counts = counts.join(shares, [*group, "label"]).select(*by, "col", "at", (F.col("n0") * each(F.col("n") - F.col("ones"))).alias("w0"), (F.col("n1") * each(F.col("ones"))).alias("b1"))
        else:
            counts = counts.select(*by, "col", "at", F.col("n0").cast("double").alias("w0"), F.col("n1").cast("double").alias("b1"))
        counts = counts.select(*by, "col", "at", (F.col("w0") + F.col("b1")).alias("bw"), "b1")
        size = counts.where("col < 0").select(*by, F.col("bw").alias("tw"), F.col("b1").alias("t1"), (F.col("b1") / F.col("bw")).alias("prob"))
        if level == depth:
            done.append(size.select(*by, F.lit(None).cast("int").alias("col"), F.lit(None).cast("int").alias("at"), F.lit(0.0).alias("gain"), "prob"))
            break
        open_ = size.where((F.col("prob") > 1e-12) & (F.col("prob") < 1 - 1e-12) & (F.col("tw") >= least_rows))
        sums = counts.where("col >= 0").join(open_.drop("prob"), by)
        way = Window.partitionBy(*by, "col").orderBy("at")  # the bins of one column of a node
        left = sums.withColumns({"lw": F.sum("bw").over(way), "l1": F.sum("b1").over(way)}).where("tw - lw > 1e-9")
        gini = lambda n, s: 2 * (s / n) * (1 - s / n)
        rw, r1 = F.col("tw") - F.col("lw"), F.col("t1") - F.col("l1")
        gain = F.round(F.col("tw") * gini(F.col("tw"), F.col("t1")) - F.col("lw") * gini(F.col("lw"), F.col("l1")) - rw * gini(rw, r1), 9)
        best = left.groupBy(*by).agg(F.max(F.struct(gain.alias("gain"), (-F.col("col")).alias("c"), (-F.col("at")).alias("a"))).alias("x")).where(F.col("x.gain") > LEAST_GAIN)
        best = cut(best.select(*by, (-F.col("x.c")).alias("col"), (-F.col("x.a")).alias("at"), "x.gain"))
        done.append(size.join(best, by, "left").select(*by, "col", "at", F.coalesce("gain", F.lit(0.0)).alias("gain"), "prob"))
        if best.isEmpty():
            break
        splits = splits.unionByName(best.drop("gain"))
    return {"edges": spans, "nodes": cut(reduce(DataFrame.unionByName, done)), "shares": shares}


def _applied(cols: int, group: list[str], key: str, rows: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
    """group, key, label, prob of the rows of a part by its group's nodes (label, rt, place, col, at, prob); rt -1: a constant label's value."""
    out = []
    if len(rows) and len(nodes):
        bins = rows[[f"_b{i}" for i in range(cols)]].to_numpy(np.int64)
        for i, own in nodes.groupby("label"):
            if (own["rt"] < 0).any():
                p = np.full(len(rows), own["prob"].iloc[0])
            else:
                trees, places = own["rt"].max() + 1, 2 * own["place"].max() + 2
                col, at, prob = np.full((trees, places), -1), np.zeros((trees, places), np.int64), np.full((trees, places), np.nan)
                inner = own[own["col"].notna()]
                col[inner["rt"], inner["place"]], at[inner["rt"], inner["place"]] = inner["col"], inner["at"]
                prob[own["rt"], own["place"]] = own["prob"]
                place, tree, row = np.ones((len(rows), trees), np.int64), np.arange(trees)[None], np.arange(len(rows))[:, None]
                while (live := (c := col[tree, place]) >= 0).any():
                    place = np.where(live, 2 * place + (bins[row, np.maximum(c, 0)] > at[tree, place]), place)
                grown = np.unique(own["rt"])  # a tree that drew no row is none
                p = prob[tree, place][:, grown].mean(1)
            out.append(rows[[*group, key]].assign(label=int(i), prob=p))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[*group, key, "label", "prob"])


def probabilities(model: dict[str, DataFrame], rows: DataFrame, group: list[str], key: str, cols: list[str]) -> DataFrame:
    """group, key, label, prob: the mean over a forest's trees of the leaf that each row reaches; a constant label's value.
    Rows of groups without a model are left out."""
    own = cut(binned(rows, model["edges"], group, cols, [key]))
    own, parts = _parts(own, own.groupBy(*group).agg(F.count("*").alias("n")), group, key)
    fixed = model["shares"].where("ones = 0 OR ones = n")
    nodes = model["nodes"].select(*group, "label", "rt", "place", "col", "at", "prob").unionByName(fixed.select(*group, "label", F.lit(-1).alias("rt"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("int").alias("at"), (F.col("ones") > 0).cast("double").alias("prob")))
    kind = {f.name: f.dataType.simpleString() for f in own.schema}
    of = [*group, "_part"]
    apply = functools.partial(_applied, len(cols), group, key)
    return own.groupBy(*of).cogroup(nodes.join(parts, group).groupBy(*of)).applyInPandas(_of_two(apply), ", ".join([*(f"`{c}` {kind[c]}" for c in (*group, key)), "label int, prob double"]))


def predictions(model: dict[str, DataFrame], rows: DataFrame, group: list[str], key: str, cols: list[str], zero_first: bool = False) -> DataFrame:
    """group, key, label, prob, pred. A probability of one above 0.95 of the label's share of ones in the leaf predicts 1; zero_first:
    a probability of zero above 0.95 of the share of zeros predicts 0, all else 1. A constant label is that constant."""
    p = probabilities(model, rows, group, key, cols).join(model["shares"], [*group, "label"])
    one = F.when(F.round(1 - F.col("prob"), 9) > F.round(0.95 * (1 - F.col("ones") / F.col("n")), 9), 0).otherwise(1) if zero_first else F.when(F.round("prob", 9) > F.round(0.95 * F.col("ones") / F.col("n"), 9), 1).otherwise(0)
    constant = (F.col("ones") == 0) | (F.col("ones") == F.col("n"))
    return p.select(*group, key, "label", "prob", F.when(constant, (F.col("ones") > 0).cast("int")).otherwise(one).alias("pred"))


def importances(model: dict[str, DataFrame], group: list[str], cols: list[str]) -> DataFrame:
    """group, label, col, importance: each column's share of the impurity that a forest's trees remove, a tree's shares adding up to
    1 (or none, for a tree of one leaf); columns that no tree cuts are left out."""
    by = [*group, "label", "rt"]
    each = model["nodes"].where("col IS NOT NULL")
    total = each.groupBy(*by).agg(F.sum("gain").alias("_t"))
    share = each.join(total, by).groupBy(*group, "label", "rt", "col").agg((F.sum(F.col("gain") / F.col("_t"))).alias("s"))
    grown = model["nodes"].where("place = 1").join(total, by).groupBy(*group, "label").agg(F.count("*").alias("_n"))
    out = share.groupBy(*group, "label", "col").agg(F.sum("s").alias("s")).join(grown, [*group, "label"])
    return out.select(*group, "label", F.element_at(F.array(*map(F.lit, cols)), F.col("col") + 1).alias("col"), (F.col("s") / F.col("_n")).alias("importance"))


def supervised_fill(df: DataFrame, group: list[str], key: str, cols: list[str], labels: list[str], trees: int = 7, depth: int = 4, seed: str = "fill") -> DataFrame:
    """group, key, labels: unlabelled rows (-1 in the first label) get the class that a forest of the group's labelled rows finds
    likelier, ties to 0; groups without labelled rows are left out."""
    known, open_ = df.where(F.col(labels[0]) >= 0), df.where(F.col(labels[0]) < 0)
    p = probabilities(fit(known, group, key, cols, labels, trees, depth, seed=seed), open_, group, key, cols)
    wide = p.groupBy(*group, key).agg(*(F.max(F.when(F.col("label") == i, (F.round("prob", 9) > 0.5).cast("int"))).alias(c) for i, c in enumerate(labels)))
    return known.select(*group, key, *(F.col(c).cast("int").alias(c) for c in labels)).unionByName(wide)
