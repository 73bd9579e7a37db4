"""Leaf models: completed labels, thresholds and small forests."""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.expressions import draw
from verdigris.operators.similarity import nearest_in_group


def completed_labels(df: DataFrame, group: list[str], key: str, numeric: list[str], categorical: list[str], labels: list[str], reps: int = 3, width: int = 2, seed: str = "fill") -> DataFrame:
    """group, key, labels: an unlabelled row (-1) copies the labels of the nearest labelled row of its leaf, by ``width``
    hashed columns in each of ``reps`` repetitions; the mean is rounded half to even."""
    known, open_ = df.where(F.col(labels[0]) >= 0), df.where(F.col(labels[0]) < 0)
    cols = [*numeric, *categorical]
    each = []
    for r in range(reps):
        order = sorted(cols, key=lambda c: hashlib.md5(f"{seed}|{r}|{c}".encode()).hexdigest())[:width]
        num, cat = [c for c in numeric if c in order], [c for c in categorical if c in order]
        each.append(nearest_in_group(known.select(*group, key, *order), open_.select(*group, key, *order), group, key, num, cat).select(key, "nearest"))
    near = reduce(DataFrame.unionAll, each).join(known.select(F.col(key).alias("nearest"), *labels), "nearest")
    filled = near.groupBy(key).agg(*(F.bround(F.avg(c), 0).cast("int").alias(c) for c in labels)).join(open_.select(*group, key), key)
    return known.select(*group, key, *labels).unionAll(filled.select(*group, key, *labels))


def mean_vectors(df: DataFrame, group: list[str], labels: list[str]) -> DataFrame:
    """group, label, prob, pred: a simple leaf predicts 1 where the mean of the label is 0.5 or more."""
    long = df.select(*group, F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(c).alias("y")) for i, c in enumerate(labels)))).alias("s")).select(*group, "s.*")
    return long.groupBy(*group, "label").agg(F.avg("y").alias("prob")).withColumn("pred", F.when(F.col("prob") >= 0.5, 1).otherwise(0))


def thresholds(df: DataFrame, group: list[str], labels: list[str]) -> DataFrame:
    """group, label, threshold: 0.95 of the label's share of ones; a probability above it predicts 1."""
    return mean_vectors(df, group, labels).select(*group, "label", (0.95 * F.col("prob")).alias("threshold"))


def _tree(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, gain: np.ndarray) -> tuple:
    if depth == 0 or len(y) < 4 or y.min() == y.max():
        return (float(y.mean()),)
    best = (1e-12, -1, 0.0)
    for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]) + 0.5)), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, s, n = x[order, f], np.cumsum(y[order]), np.arange(1, len(y) + 1)
        ok = np.flatnonzero(v[:-1] < v[1:])
        if len(ok):
            p, q = s[ok] / n[ok], (s[-1] - s[ok]) / (n[-1] - n[ok])
            g = y.mean() * (1 - y.mean()) - (n[ok] * p * (1 - p) + (n[-1] - n[ok]) * q * (1 - q)) / n[-1]
            if g.max() > best[0]:
                best = (float(g.max()), int(f), float(v[ok[g.argmax()]]))
    if best[1] < 0:
        return (float(y.mean()),)
    gain[best[1]] += best[0] * len(y)
    left = x[:, best[1]] <= best[2]
    return (best[1], best[2], _tree(x[left], y[left], rng, depth - 1, gain), _tree(x[~left], y[~left], rng, depth - 1, gain))


def _value(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    return np.where(x[:, tree[0]] <= tree[1], _value(tree[2], x), _value(tree[3], x))


def _values(tree: tuple, x: list[np.ndarray], at: np.ndarray, out: np.ndarray) -> None:
    """out[at]: the values of ``_value``, each side's rows alone walking on."""
    if len(tree) == 1:
        out[at] = tree[0]
    elif len(at):
        left = x[tree[0]][at] <= tree[1]
        _values(tree[2], x, at[left], out)
        _values(tree[3], x, at[~left], out)


def forest_models(train: DataFrame, test: DataFrame, group: list[str], key: str, cols: list[str], labels: list[str], trees: int = 12, depth: int = 4) -> DataFrame:
    """group, key, label, prob, pred, importance: for each leaf and label a small forest of the leaf's rows, applied to
    the test rows of the leaf; a constant label is that constant. Leaves are bounded by the bag, so one is one task's."""
    kinds = {f.name: f.dataType.simpleString() for f in train.schema}
    both = train.select(*group, key, *cols, *labels, F.lit(True).alias("_train")).unionAll(test.select(*group, key, *cols, *(F.lit(None).cast(kinds[c]).alias(c) for c in labels), F.lit(False).alias("_train")))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable")
        own, other = rows[rows["_train"]], rows[~rows["_train"]]
        x, z = own[cols].to_numpy(float), other[cols].to_numpy(float)
        out = []
        for i, label in enumerate(labels):
            y, gain = own[label].to_numpy(float), np.zeros(len(cols))
            if not len(other):
                continue
            if not len(y):
                p = np.zeros(len(z))
            elif y.min() == y.max():
                p = np.full(len(z), y[0])
            else:
                rng = np.random.default_rng(i)
                p = np.zeros(len(z))
                for _ in range(trees):
                    at = rng.integers(0, len(y), len(y))
                    p += _value(_tree(x[at], y[at], rng, depth, gain), z) / trees
            cut = 0.95 * y.mean() if len(y) else 1.0
            pred = p.astype(int) if len(y) and y.min() == y.max() else (p > cut).astype(int)
            top = cols[int(gain.argmax())] if gain.any() else None
            out.append(other[[*group, key]].assign(label=i, prob=p, pred=pred, importance=top))
        return pd.concat(out) if out else rows[[*group, key]].head(0).assign(label=pd.Series(dtype=int), prob=0.0, pred=0, importance=None)

    schema = ", ".join(f"{c} {kinds[c]}" for c in (*group, key)) + ", label int, prob double, pred int, importance string"
    return both.groupBy(*group).applyInPandas(fit, schema)


def local_fill(df: DataFrame, group: list[str], key: str, labels: list[str], seed: str = "fill") -> DataFrame:
    """key, labels: an unlabelled row gets 1 with probability d (1 - g) / (1 - (g d + (1 - g) (1 - d))), d the label's
    share in its group and g in all rows; the draw is a hash of the key."""
    d = df.groupBy(*group).agg(*(F.avg(F.when(F.col(c) >= 0, F.col(c))).alias(f"d_{c}") for c in labels))
    g = df.agg(*(F.avg(F.when(F.col(c) >= 0, F.col(c))).alias(f"g_{c}") for c in labels))
    j = df.join(d, group).join(F.broadcast(g))  # one row
    out = []
    for c in labels:
        dd, gg = F.col(f"d_{c}"), F.col(f"g_{c}")
        p = F.try_divide(dd * (1 - gg), 1 - (gg * dd + (1 - gg) * (1 - dd)))
        u = F.conv(F.substring(draw(seed, F.lit(c), key), 1, 8), 16, 10).cast("double") / 4294967296.0
        out.append(F.when(F.col(c) >= 0, F.col(c)).otherwise((u < p).cast("int")).alias(c))
    return j.select(key, *out)


def _surest(v: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest values, of equal ones the first."""
    if n >= len(v):
        return np.arange(len(v))
    least = np.partition(v, len(v) - n)[len(v) - n]
    more = np.flatnonzero(v > least)
    return np.concatenate([more, np.flatnonzero(v == least)[: n - len(more)]])


def _drawn_tree(x: list[np.ndarray], y: np.ndarray, w: np.ndarray, orders: list[np.ndarray], rng: np.random.Generator, depth: int) -> tuple:
    """The tree of ``_tree`` over rows drawn w times each, to the last digit: orders are the drawn rows in the order of each column, so nothing
    is sorted again."""
    drawn = w[orders[0]]
    n, ones = int(drawn.sum()), int((drawn * y[orders[0]]).sum())
    mean = ones / n
    if depth == 0 or n < 4 or ones in (0, n):
        return (mean,)
    best = (1e-12, -1, 0.0)
    for f in rng.choice(len(x), max(1, int(np.sqrt(len(x)) + 0.5)), replace=False):
        at = orders[f]
        v, m = x[f][at], w[at]
        ok = np.flatnonzero(v[:-1] < v[1:])
        if len(ok):
            k, s = np.cumsum(m)[ok], np.cumsum(m * y[at])[ok]
            p, q = s / k, (ones - s) / (n - k)
            g = mean * (1 - mean) - (k * p * (1 - p) + (n - k) * q * (1 - q)) / n
            i = int(g.argmax())
            if g[i] > best[0]:
                best = (float(g[i]), int(f), float(v[ok[i]]))
    if best[1] < 0:
        return (mean,)
    left = x[best[1]] <= best[2]
    sides = [[at[left[at] == s] for at in orders] for s in (True, False)]
    return (best[1], best[2], *(_drawn_tree(x, y, w, own, rng, depth - 1) for own in sides))


def self_trained(df: DataFrame, group: list[str], key: str, cols: list[str], label: str, k_best: int = 10, rounds: int = 200) -> DataFrame:
    """group, key, label, round: labels completed by self-training within each leaf: a small forest of the labelled rows
    labels the k_best surest open rows, round by round. A leaf with more than k_best * rounds open rows labels the same
    share of them in each round instead, so no row is left over for the last; a leaf without labels stays open."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable").reset_index(drop=True)
        x, y = rows[cols].to_numpy(float), rows[label].to_numpy(int).copy()
        at = np.where(y >= 0, 0, -1)
        best = max(k_best, -(-int((y < 0).sum()) // rounds))
        columns = [x[:, f].copy() for f in range(x.shape[1])]
        orders = [np.argsort(v, kind="stable") for v in columns]
        for r in range(1, rounds + 1):
            known, open_ = np.flatnonzero(y >= 0), np.flatnonzero(y < 0)
            if not len(open_) or not len(known):
                break
            rng, p, value = np.random.default_rng(r), np.zeros(len(open_)), np.zeros(len(y))
            for _ in range(5):
                w = np.bincount(known[rng.integers(0, len(known), len(known))], minlength=len(y))
                _values(_drawn_tree(columns, y, w, [o[w[o] > 0] for o in orders], rng, 4), columns, open_, value)
                p += value[open_] / 5
            sure = _surest(np.abs(p - 0.5), best)
            y[open_[sure]], at[open_[sure]] = (p[sure] >= 0.5).astype(int), r
        return rows[[*group, key]].assign(label=y, round=at)

    return df.select(*group, key, *cols, label).groupBy(*group).applyInPandas(fit, ", ".join(f"{c} {kinds[c]}" for c in (*group, key)) + ", label int, round int")
