"""The candidates of nodes that no task holds whole: the sides and scores of ``candidates``, in parts that Spark adds up.

A row stays one row for all candidates of its node. What a candidate needs to side a row (anchors, seed, where the transfer stops, centres) is
a few values, so a row's side is computed from these alone wherever it is asked for. Sums of pairs come from cells of each column,
between approximate quantiles of the node: a cell's rows are sorted in one task, the other cells count by their numbers and sums.
A value as frequent as a cell is a cell of its own, whose rows are dealt further. The driver sees values by node, candidate and cell.
"""

from __future__ import annotations

import itertools
import pickle
from collections.abc import Callable, Iterable, Iterator
from functools import partial, reduce
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.prefix import before
from verdigris.operators import clustering as C
from verdigris.operators.candidates import cosines, drawn_columns, from_b
from verdigris.sources.shared import cut

#: Rows of a cell, about.
CELL = 32_768
#: Candidates of a node whose pair sums are taken at once, a bit of a row for each.
AT_ONCE = 32

NODE = ["tree", "node"]


def _by_node(batches: Iterable[pd.DataFrame], known: dict) -> Iterator[tuple[tuple[int, int], dict, pd.DataFrame]]:
    """The rows of each node of each batch, nodes that are not known left out."""
    for b in batches:
        for (tree, node), at in b.groupby(NODE, sort=False).indices.items():
            if (name := (int(tree), int(node))) in known:
                yield name, known[name], b.iloc[at]


def _distance(own: pd.DataFrame, k: dict, cols: list[str], to: dict) -> np.ndarray:
    """The mixed distance of rows to one, over some columns in the order numbers, categories."""
    d = np.zeros(len(own))
    for c in k["span"]:
        if c in cols:
            d += np.abs(own[c].to_numpy(float) - to[c]) / k["span"][c]
    for c in k["categorical"]:
        if c in cols:
            d += (own[c].to_numpy(object) != to[c]).astype(bool)
    return d / len(cols)


def _weights(own: pd.DataFrame, k: dict, cols: list[str]) -> list[np.ndarray]:
    """w of labelled rows from either anchor."""
    y = own[k["labels"]].to_numpy(float)
    return [np.round(0.7 + 0.3 * _distance(own, k, cols, t) + 0.7 * cosines(y, np.array([t[c] for c in k["labels"]], float)), 9) for t in k["ab"]]


def _weighed(key: str, known: dict, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """tree, node, iter, key, far, wo, wa, wb, near, skip of labelled rows, for each candidate."""
    for (tree, node), k, own in _by_node(batches, known):
        keys, (a, b) = own[key].to_numpy(), (t[key] for t in k["ab"])
        for it, cols, by_b in k["drawn"]:
            wa, wb = _weights(own, k, cols)
            far, order, skip, near = (wa, wb, b, a) if by_b else (wb, wa, a, b)
            yield pd.DataFrame({"tree": tree, "node": node, "iter": it, key: keys, "far": far, "wo": order, "wa": wa, "wb": wb, "near": keys == near, "skip": keys == skip})


def _side(own: pd.DataFrame, key: str, k: dict, it: int) -> np.ndarray:
    """The cluster of each row by one candidate."""
    cols, by_b, s = k["options"][it]
    d0, d1 = (np.round(_distance(own, k, cols, t), 9) for t in s["centres"])
    out = np.where(d1 < d0, 1, 0)
    at = np.flatnonzero(own[k["labels"][0]].to_numpy() >= 0)
    keys, order = own[key].to_numpy()[at], _weights(own.iloc[at], k, cols)[1 if by_b else 0]
    wo, last = s["last"]
    first = (order < wo) | ((order == wo) & (keys <= last)) if s["stop"] else np.zeros(len(at), bool)
    listed = keys != k["ab"][1 if by_b else 0][key]
    out[at[listed]] = first[listed]
    out[at[keys == s["seed"]]] = 1
    return out


def _of_one(f: Callable) -> Callable:
    """f as a function that Spark sees to take a table, not a key too."""
    return lambda g: f(g)


def _added(a: dict[str, np.ndarray], b: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {c: (np.minimum if c == "lo" else np.maximum if c == "hi" else np.add)(a[c], b[c]) for c in a}


def _summed(of: Callable, known: dict, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """tree, node, sums: of(name, known, rows) added up over a task's rows."""
    held: dict = {}
    for name, k, own in _by_node(batches, known):
        s = of(name, k, own)
        held[name] = _added(held[name], s) if name in held else s
    if held:
        yield pd.DataFrame([(*name, pickle.dumps(s)) for name, s in held.items()], columns=[*NODE, "sums"])


def _sums(rows: DataFrame, of: Callable, known: dict) -> dict[tuple[int, int], dict]:
    """The sums by node; a node's are added up in one task, a value for each task that had rows."""
    schema = "tree int, node long, sums binary"
    add = lambda g: pd.DataFrame([(g["tree"].iloc[0], g["node"].iloc[0], pickle.dumps(reduce(_added, map(pickle.loads, g["sums"]))))], columns=[*NODE, "sums"])
    done = rows.mapInPandas(partial(_summed, of, known), schema).groupBy(*NODE).applyInPandas(add, schema)
    return {(r.tree, r.node): pickle.loads(r.sums) for r in done.collect()}  # a row for each node


def _sizes(key: str, numeric: list[str], name: tuple, k: dict, own: pd.DataFrame) -> dict[str, np.ndarray]:
    """Counts, sums of unit label vectors, label counts and ranges by candidate and side; products of the numbers."""
    y = own[k["labels"]].to_numpy(float)
    sup = y[:, 0] >= 0
    norm = np.sqrt((y * y).sum(1))
    unit = np.divide(y, norm[:, None], out=np.zeros(y.shape), where=norm[:, None] > 0)
    x = np.column_stack([own[c].to_numpy(float) for c in numeric]) if numeric else np.zeros((len(own), 0))
    z = x - np.array([k["mean"][c] for c in numeric])
    shape = (len(k["options"]), 2)
    out = {"n": np.zeros(shape), "s": np.zeros(shape), "uu": np.zeros(shape), "products": z.T @ z, "lo": np.full((*shape, x.shape[1]), np.inf), "hi": np.full((*shape, x.shape[1]), -np.inf)}
    out |= {c: np.zeros((*shape, y.shape[1])) for c in ("unit", "pos", "neg")}
    for i, it in enumerate(k["options"]):
        cl = _side(own, key, k, it)
        for side in (0, 1):
            m = cl == side
            ms = m & sup
            out["n"][i, side], out["s"][i, side], out["uu"][i, side] = m.sum(), ms.sum(), (unit[ms] ** 2).sum()
            out["unit"][i, side], out["pos"][i, side], out["neg"][i, side] = unit[ms].sum(0), (y[ms] == 1).sum(0), (y[ms] == 0).sum(0)
            if m.any():
                out["lo"][i, side], out["hi"][i, side] = x[m].min(0), x[m].max(0)
    return out


def _cell(x: np.ndarray, bounds: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The cell of each value: an even one up to a bound, an odd one for a bound that is a cell of its own."""
    i = np.searchsorted(bounds, x, side="left")
    j = np.minimum(i, len(bounds) - 1)
    return 2 * i + ((i < len(bounds)) & (bounds[j] == x) & often[j]) if len(bounds) else np.zeros(len(x), np.int64)


def _in_cells(key: str, name: tuple, k: dict, own: pd.DataFrame) -> dict[str, np.ndarray]:
    """Numbers and sums of the rows in each cell of each column, by candidate and side."""
    out, cl = {}, [_side(own, key, k, it) for it in k["some"]]
    for c in k["span"]:
        cell, v, n = _cell(own[c].to_numpy(float), *k["cells"][c]), own[c].to_numpy(float) - k["mean"][c], 2 * len(k["cells"][c][0]) + 2
        for what, w in (("n", None), ("s", v)):
            out[f"{what}|{c}"] = np.stack([np.bincount(2 * cell + s, w, minlength=2 * n).reshape(n, 2).T for s in cl])
    return out


def _dealt(key: str, numeric: list[str], categorical: list[str], known: dict, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each row and number: tree, node, col, cell, part, key, x, sides; and one with the categories, col -1."""
    for (tree, node), k, own in _by_node(batches, known):
        sides = np.zeros(len(own), np.int64)
        for i, it in enumerate(k["some"]):
            sides |= _side(own, key, k, it).astype(np.int64) << i
        keys = own[key].to_numpy()
        part = (pd.util.hash_array(keys) % np.uint64(k["parts"])).astype(np.int64)
        for j, c in enumerate(numeric):
            x = own[c].to_numpy(float)
            cell = _cell(x, *k["cells"][c])
            yield pd.DataFrame({"tree": tree, "node": node, "col": j, "cell": cell, "part": part, "slice": np.where(cell % 2 == 1, part, 0), key: keys, "x": x - k["mean"][c], "sides": sides, **dict.fromkeys(categorical)})
        if categorical:
            yield pd.DataFrame({"tree": tree, "node": node, "col": -1, "cell": 0, "part": part, "slice": 0, key: keys, "x": 0.0, "sides": sides, **{c: own[c].to_numpy(object) for c in categorical}})


def _near(key: str, numeric: list[str], width: int, known: dict, totals: dict, g: pd.DataFrame) -> pd.DataFrame:
    """tree, node, col, part, key, sides, d0, d1, ..: the sum of the distances in one column of each row of a cell to the rows of either side, by candidate."""
    name, j, cell = (int(g["tree"].iloc[0]), int(g["node"].iloc[0])), int(g["col"].iloc[0]), int(g["cell"].iloc[0])
    k, c = known[name], numeric[j]
    g = g.sort_values("x", kind="stable")
    v, sides = g["x"].to_numpy(), g["sides"].to_numpy()
    n, s = (totals[name][f"{what}|{c}"] for what in "ns")
    d = np.zeros((len(v), 2 * width))
    for i, it in enumerate(k["some"]):
        if c not in k["options"][it][0]:
            continue
        for side in (0, 1):
            below_n, below_s, above_n, above_s = n[i, side, :cell].sum(), s[i, side, :cell].sum(), n[i, side, cell + 1 :].sum(), s[i, side, cell + 1 :].sum()
            own = v * (below_n - above_n) - below_s + above_s
            if cell % 2 == 0:
                one = ((sides >> i & 1) == side) * 1.0
                kn, ks = np.cumsum(one) - one, np.cumsum(one * v) - one * v
                own = own + v * kn - ks + (one * v).sum() - ks - one * v - v * (one.sum() - kn - one)
            d[:, 2 * i + side] = own
    return pd.concat([g[[*NODE, "col", "part", key, "sides"]].reset_index(drop=True), pd.DataFrame(d, columns=[f"d{i}" for i in range(2 * width)])], axis=1)


def _silhouettes(key: str, numeric: list[str], categorical: list[str], width: int, known: dict, g: pd.DataFrame) -> pd.DataFrame:
    """tree, node, sums of a part's rows: of silhouettes by candidate, then by candidate, column and side of distances within the side."""
    name = int(g["tree"].iloc[0]), int(g["node"].iloc[0])
    k, cols = known[name], [*numeric, *categorical]
    at, keys = pd.factorize(g[key])
    sides = np.zeros(len(keys), np.int64)
    sides[at] = g["sides"].to_numpy()
    col, values = g["col"].to_numpy(), g[[f"d{i}" for i in range(2 * width)]].to_numpy()
    out, within = np.zeros(width), np.zeros((width, len(cols), 2))
    each, every = [np.flatnonzero(col == j) for j in range(len(cols))], np.arange(len(keys))
    for i, it in enumerate(k["some"]):
        own, n, total = sides >> i & 1, k["n"][it], np.zeros((2, len(keys)))
        for j, c in enumerate(cols):
            if c in k["options"][it][0]:
                d = np.zeros((2, len(keys)))
                d[:, at[each[j]]] = values[each[j], 2 * i : 2 * i + 2].T
                if j >= len(numeric):  # how many rows have the category
                    d = n[:, None] - d
                within[i, j] = np.bincount(own, d[own, every], minlength=2)
                total += d / k["span"][c] if c in k["span"] else d
        total /= len(k["options"][it][0])
        same, other, size = total[own, every], total[1 - own, every], n[own]
        a = np.where(size <= 1, 1.0, same / np.maximum(size - 1, 1))
        b = other / n[1 - own]
        top = np.maximum(a, b)
        out[i] = np.divide(b - a, top, out=np.zeros(len(keys)), where=top != 0).sum()
    return pd.DataFrame([(*name, [*out.tolist(), *within.ravel().tolist()])], columns=[*NODE, "sums"])


def _pair_sums(wide: DataFrame, key: str, numeric: list[str], categorical: list[str], known: dict) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """By node: sums of silhouettes and of distances within sides, of the candidates some of each node of known."""
    kind, width = wide.schema[key].dataType.simpleString(), max(len(k["some"]) for k in known.values())
    totals = _sums(wide, partial(_in_cells, key), known) if numeric else {}
    plain = wide.select(*NODE, key, *numeric, *categorical, *next(iter(known.values()))["labels"])
    rows = cut(plain.mapInPandas(partial(_dealt, key, numeric, categorical, known), f"tree int, node long, col int, cell long, part long, slice long, {key} {kind}, x double, sides long" + "".join(f", `{c}` string" for c in categorical)))
    d = [f"d{i}" for i in range(2 * width)]
    shown = [*NODE, "col", "part", key, "sides", *d]
    parts = []
    if numeric:
        near = rows.where("col >= 0").drop(*categorical).groupBy(*NODE, "col", "cell", "slice")
        parts.append(near.applyInPandas(_of_one(partial(_near, key, numeric, width, known, totals)), f"tree int, node long, col int, part long, {key} {kind}, sides long, " + ", ".join(f"{c} double" for c in d)))
    for j, c in enumerate(categorical):
        own = rows.where("col < 0").select(*NODE, "part", key, "sides", F.col(c).alias("_v"))
        bit = lambda i: F.shiftright("sides", i // 2).bitwiseAND(F.lit(1)) == i % 2
        counts = own.groupBy(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("_v").alias("_w")).agg(*(F.count(F.when(bit(i), 1)).cast("double").alias(x) for i, x in enumerate(d)))
        same = (F.col("tree") == F.col("_t")) & (F.col("node") == F.col("_n")) & F.col("_v").eqNullSafe(F.col("_w"))
        parts.append(own.join(counts, same).withColumn("col", F.lit(len(numeric) + j)))
    done = reduce(DataFrame.unionByName, [p.select(*shown) for p in parts]).groupBy(*NODE, "part")
    done = done.applyInPandas(_of_one(partial(_silhouettes, key, numeric, categorical, width, known)), "tree int, node long, sums array<double>")
    out: dict = {}
    for r in done.collect():  # a row for each part of CELL rows
        out[r.tree, r.node] = out.get((r.tree, r.node), 0) + np.array(r.sums)
    return {name: (v[:width], v[width:].reshape(width, -1, 2)) for name, v in out.items()}


def _score(k: dict, i: int, it: int, sil: float, within: np.ndarray, numeric: list[str], categorical: list[str], p: dict[str, float]) -> float:
    """The score of ``candidates.Node.score`` from the sums of candidate it, the i-th of its node."""
    t, cols = k["sums"], k["options"][it][0]
    n, s = t["n"][i], t["s"][i]
    ratio = s / n
    terms = {"count_balance": s.min() / s.max(), "ratio_balance": ratio.min() / ratio.max()}
    m = s * (s - 1) / 2
    spread = (m - ((t["unit"][i] ** 2).sum(1) - t["uu"][i]) / 2) / m
    terms["labels"] = 1 - spread.sum() / 2
    pos, neg = t["pos"][i], t["neg"][i]
    terms["example_balance"] = (np.minimum(pos, neg) / np.maximum(np.maximum(pos, neg), 1)).mean(1).sum() / 2
    terms["silhouette"] = (sil / n.sum() + 1) / 2
    each = np.zeros(2)
    for j, c in enumerate([*numeric, *categorical]):
        if c in cols:
            each += within[j] / 2 / (t["hi"][i, :, j] - t["lo"][i, :, j] + 1e-12 if j < len(numeric) else 1)
    pairs = n * (n - 1) / 2
    terms["features"] = 1 - np.divide(each / len(cols), pairs, out=np.zeros(2), where=pairs > 0).sum() / 2
    at, r2 = [j for j, c in enumerate(numeric) if c in cols], 0.0
    for a, b in itertools.combinations(at, 2):
        q = t["products"][a, a] * t["products"][b, b]
        r2 += t["products"][a, b] ** 2 / q if q else 0.0
    terms["independence"] = 1 - r2 / (len(at) * (len(at) - 1) / 2) if len(at) > 1 else 1.0
    return sum(p[x] / sum(p.values()) * terms[x] for x in p if p[x])


def _moved(key: str, known: dict, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for (tree, node), k, own in _by_node(batches, known):
        score, it = k["best"]
        yield pd.DataFrame({"tree": tree, "node": node, key: own[key].to_numpy(), "cl": _side(own, key, k, it), "iter": it, "score": score, "cols": [k["options"][it][0]] * len(own)})


def _named(wide: DataFrame, at: DataFrame, key: str) -> dict[tuple, dict[str, Any]]:
    """Some rows of nodes by tree, node and key."""
    return {(r["tree"], r["node"], r[key]): r.asDict() for r in wide.join(F.broadcast(at), [*NODE, key]).collect()}  # a few for each candidate


def _seeds(wide: DataFrame, key: str, known: dict) -> dict[tuple[int, int, int], dict[str, Any]]:
    """By candidate: the seed, where the transfer of rows stops, the last row moved and the centres, as in ``candidates.Node.sides``."""
    spark, kind = wide.sparkSession, wide.schema[key].dataType.simpleString()
    group = [*NODE, "iter"]
    sup = wide.where(F.col(next(iter(known.values()))["labels"][0]) >= 0)
    j = cut(sup.mapInPandas(partial(_weighed, key, known), f"tree int, node long, iter int, {key} {kind}, far double, wo double, wa double, wb double, near boolean, skip boolean"))
    first = cut(j.where("NOT near").groupBy(*group).agg(F.max(F.struct("far", F.col(key).alias("k"), "wb")).alias("s")).select(*group, F.col("s.k").alias("seed"), F.col("s.wb").alias("wseed")))
    listed = j.where("NOT skip").select(*group, key, "wo", "wa", "wb")
    whole = cut(listed.groupBy(*group).agg(F.count("*").alias("n"), F.sum("wa").alias("ta")))
    rest = before(listed, group, "wo", key, {"i": F.lit(1), "sa": F.col("wa"), "sb": F.col("wb")}).join(F.broadcast(whole), group).join(F.broadcast(first), group)  # a row for each candidate
    m0, m1 = (F.col("ta") - F.col("sa")) / (F.col("n") - F.col("i")), (F.col("wseed") + F.col("sb")) / (F.col("i") + 1)
    done = (F.col("i") >= 1) & (F.col("i") <= F.col("n") - 2) & (F.round(m0, 6) > F.round(m1, 6))
    rest = cut(rest.select(*group, key, "wo", "i", "n", "seed", done.alias("done")))
    stop = rest.groupBy(*group).agg(F.coalesce(F.min(F.when(F.col("done"), F.col("i"))), F.max(F.greatest(F.col("n") - 2, F.lit(0)))).alias("stop"), F.first("seed").alias("seed"))
    ends = rest.drop("seed").join(F.broadcast(stop), group).where("i = n - 1 OR i = stop - 1").collect()  # two rows for each candidate
    out: dict = {}
    for r in ends:
        s = out.setdefault((r["tree"], r["node"], r["iter"]), {"seed": r["seed"], "stop": r["stop"], "last": (0.0, None)})
        if r["i"] == r["n"] - 1:
            s["centre0"] = r[key]
        if r["i"] == r["stop"] - 1:
            s["last"] = r["wo"], r[key]
    for s in out.values():
        s["centre1"] = s["last"][1] if s["stop"] else s["seed"]
    asked = sorted({(t, n, s[f"centre{i}"]) for (t, n, _), s in out.items() for i in (0, 1)})
    rows = _named(wide, spark.createDataFrame(asked, f"tree int, node long, {key} {kind}"), key)
    for (t, n, _), s in out.items():
        s["centres"] = [rows[t, n, s[f"centre{i}"]] for i in (0, 1)]
    return out


def split(wide: DataFrame, key: str, numeric: list[str], categorical: list[str], labels: list[str], least: int, iterations: int, groups: int, width: int, seed: str, weights: dict[str, float]) -> DataFrame:
    """tree, node, key, cl, iter, score, cols for the rows of each node that is split, nodes of any size."""
    kind, cols = wide.schema[key].dataType.simpleString(), [*numeric, *categorical]
    wide = cut(wide.select(*NODE, key, *numeric, *categorical, *labels))
    stats = [f(c).cast("double").alias(f"{n}_{c}") for c in numeric for n, f in (("lo", F.min), ("hi", F.max), ("mean", F.avg))]
    size = wide.groupBy(*NODE).agg(F.count("*").alias("n"), *stats).collect()  # a row for each large node
    bounds = max(1, -(-max(r["n"] for r in size) // CELL))
    share = [i / bounds for i in range(1, bounds)]
    cells = wide.groupBy(*NODE).agg(*(F.percentile_approx(F.col(c).cast("double"), share, max(1_000, 20 * bounds)).alias(c) for c in numeric)).collect() if share and numeric else []
    cells = {(r["tree"], r["node"]): {c: np.unique(np.array(r[c]), return_counts=True) for c in numeric} for r in cells}
    ab = cut(C.anchors(wide.where(F.col(labels[0]) >= 0).select(*NODE, key, *labels), NODE, key, labels).where("a <> b"))
    rows = _named(wide, ab.select(*NODE, F.explode(F.array("a", "b")).alias(key)), key)
    pair = {(r["tree"], r["node"]): [rows[r["tree"], r["node"], r[x]] for x in "ab"] for r in ab.collect()}
    known = {}
    for r in size:
        name = r["tree"], r["node"]
        if name in pair:
            edge = {c: (cells[name][c][0], cells[name][c][1] > 1) if cells else (np.zeros(0), np.zeros(0, bool)) for c in numeric}
            drawn = [(it, drawn_columns(seed, *name, it, cols, width), from_b(seed, *name, it)) for it in range(iterations)]
            known[name] = {"span": {c: r[f"hi_{c}"] - r[f"lo_{c}"] + 1e-12 for c in numeric}, "mean": {c: r[f"mean_{c}"] for c in numeric}, "categorical": categorical, "labels": labels, "cells": edge, "parts": -(-r["n"] // CELL), "ab": pair[name], "drawn": drawn}
    schema = f"tree int, node long, {key} {kind}, cl int, iter int, score double, cols array<string>"
    if not known:
        return wide.sparkSession.createDataFrame([], schema)
    seeds = _seeds(wide, key, known)
    for name, k in known.items():
        k["options"] = {it: (own, by_b, seeds[(*name, it)]) for it, own, by_b in k["drawn"]}
    for name, t in _sums(wide, partial(_sizes, key, numeric), known).items():
        k = known[name]
        k["sums"], k["n"] = t, dict(zip(k["options"], t["n"], strict=True))
        valid = (t["s"].min(1) > 2) & (t["n"].min(1) >= least)
        k["valid"] = [it for it, v in zip(k["options"], valid, strict=True) if v][:groups]
    for at in range(0, max(len(k["valid"]) for k in known.values()), AT_ONCE):
        plain = {name: {x: v for x, v in k.items() if x != "sums"} | {"some": k["valid"][at : at + AT_ONCE]} for name, k in known.items() if k["valid"][at:]}
        for name, (sil, within) in _pair_sums(wide, key, numeric, categorical, plain).items():
            k = known[name]
            for i, it in enumerate(plain[name]["some"]):
                s = round(_score(k, list(k["options"]).index(it), it, sil[i], within[i], numeric, categorical, weights), 9)
                if s > k.get("best", (-1.0, 0))[0]:
                    k["best"] = float(s), it
    chosen = {name: {x: v for x, v in k.items() if x != "sums"} for name, k in known.items() if "best" in k}
    return wide.mapInPandas(partial(_moved, key, chosen), schema)
