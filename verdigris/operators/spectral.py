"""Two-way spectral sides of the rows of each group, over any columns, without a matrix of the rows.

The rows' Gaussian affinity is carried by its columns for LANDMARKS rows of a group (a low-rank approximation: as the kernel is
smooth, a few dozen tell the rest). Degrees and the normalised affinity's products are sums over rows of vectors and
matrices of that size, which Spark adds up task by task; the second eigenvector of the small matrix then gives each row its side.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.expressions import draw
from verdigris.sources.shared import cut

LANDMARKS = 48


def _affinity(z: np.ndarray, m: np.ndarray, gamma: float) -> np.ndarray:
    return np.exp(-gamma * ((z[:, None] - m[None]) ** 2).sum(2))


def _root(m: np.ndarray, gamma: float) -> np.ndarray:
    """The inverse square root of the landmarks' affinity, without its directions of no weight."""
    w, v = np.linalg.eigh(_affinity(m, m, gamma))
    keep = w > 1e-10 * w[-1]
    return v[:, keep] / np.sqrt(w[keep])


def _vectors(b: pd.DataFrame, name: str) -> np.ndarray:
    return np.array([list(v) for v in b[name]], float)


def _summed(of: Callable, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(g, place, v): sums over this task's rows of the numbers that ``of`` gives for the rows of a group."""
    total: dict[str, np.ndarray] = {}
    for b in batches:
        for g, own in b.groupby("g", sort=False):
            x = of(own)
            total[g] = total[g] + x if g in total else x
        if len(total) > 256:  # a task that meets many groups
            yield _sums(total)
            total = {}
    yield _sums(total)


def _sums(total: dict[str, np.ndarray]) -> pd.DataFrame:
    n = [len(x) for x in total.values()]
    return pd.DataFrame({"g": np.repeat(np.array(list(total), object), n), "place": np.concatenate([np.arange(k) for k in n] or [np.zeros(0, int)]), "v": np.concatenate(list(total.values()) or [np.zeros(0)])})


def _first(gamma: float, own: pd.DataFrame) -> np.ndarray:
    return _affinity(_vectors(own, "z"), np.array([list(v) for v in own["m"].iloc[0]], float), gamma).sum(0)


def _second(gamma: float, own: pd.DataFrame) -> np.ndarray:
    m = np.array([list(v) for v in own["m"].iloc[0]], float)
    k, r = _affinity(_vectors(own, "z"), m, gamma), _root(m, gamma)
    d = np.maximum(k @ (r @ (r.T @ np.array(own["s"].iloc[0], float))), 1e-12)
    p = k @ r
    return (p.T @ (p / d[:, None])).ravel()


def _directions(gamma: float, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(g, c): by the affinities to the landmarks, the numbers whose sum has the sign of a row's entry of the second eigenvector."""
    for b in batches:
        out = []
        for row in b.itertuples(index=False):
            m = np.array([list(v) for v in row.m], float)
            r = _root(m, gamma)
            w, v = np.linalg.eigh(np.array(row.b, float).reshape(r.shape[1], r.shape[1]))
            c = r @ (v[:, -2] if len(w) > 1 else np.zeros(len(w)))
            first = float(_affinity(m[:1], m, gamma)[0] @ c)
            out.append((row.g, (c if first <= 0 else -c).tolist()))
        yield pd.DataFrame(out, columns=["g", "c"])


def _sided(gamma: float, key: str, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        parts = []
        for _, own in b.groupby("g", sort=False):
            k = _affinity(_vectors(own, "z"), np.array([list(v) for v in own["m"].iloc[0]], float), gamma)
            parts.append(pd.DataFrame({"g": own["g"], key: own[key], "side": (k @ np.array(own["c"].iloc[0], float) > 1e-12).astype(int)}))
        if parts:
            yield pd.concat(parts)


def sides(df: DataFrame, group: list[str], key: str, cols: list[str], gamma: float = 8.0, seed: str = "landmark") -> DataFrame:
    """group, key, side (0 or 1): the sign of the second eigenvector of the rows' normalised Gaussian affinity, over columns
    scaled to [0, 1] in their group. The landmark of the least hash is on side 0; rows of a group without differences all are.
    Values have no nulls; rows that are equal are on one side."""
    span = df.groupBy(*group).agg(*(f(c).cast("double").alias(f"{k}_{c}") for c in cols for k, f in (("lo", F.min), ("hi", F.max))))
    z = F.array(*(F.coalesce(F.try_divide(F.col(c).cast("double") - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.0)) for c in cols))
    kind = df.schema[key].dataType.simpleString()
    rows = cut(df.join(span, group).select(F.to_json(F.struct(*group)).alias("g"), *group, key, z.alias("z"), draw(seed, key).alias("_h")))
    # each task's least hashes first, so that a group's landmarks are picked from few rows
    near = rows.withColumn("_t", F.pmod(F.xxhash64(key), F.lit(64)))
    few = near.withColumn("_r", F.row_number().over(Window.partitionBy("g", "_t").orderBy("_h"))).where(F.col("_r") <= LANDMARKS)
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy("g").orderBy("_h"))).where(F.col("_r") <= LANDMARKS)
    marks = cut(few.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("_r", "z"))), lambda x: x["z"]).alias("m")))
    rows = rows.select("g", key, "z").join(marks, "g")
    listed = lambda t, name: t.groupBy("g", "place").agg(F.sum("v").alias("v")).groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]).alias(name))
    s = cut(listed(rows.mapInPandas(functools.partial(_summed, functools.partial(_first, gamma)), "g string, place int, v double"), "s"))
    b = listed(rows.join(s, "g").mapInPandas(functools.partial(_summed, functools.partial(_second, gamma)), "g string, place int, v double"), "b")
    c = cut(marks.join(b, "g").mapInPandas(functools.partial(_directions, gamma), "g string, c array<double>"))
    out = rows.join(c, "g").mapInPandas(functools.partial(_sided, gamma, key), f"g string, {key} {kind}, side int")
    return out.join(df.select(*group).distinct().withColumn("g", F.to_json(F.struct(*group))), "g").select(*group, key, "side")
