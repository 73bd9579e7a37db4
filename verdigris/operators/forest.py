"""A forest of trees that split rows by seeded clustering, grown level by level, and the routing of rows through it.

All open nodes of all trees are one table; a level is one set of plans for the whole forest. Only node tables (a row
for each node) come to the driver's loop as counts; memberships stay distributed and are checkpointed by level.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators import clustering as C
from verdigris.operators import large_nodes, sampling
from verdigris.operators.candidates import Node
from verdigris.operators.nearest import nearest
from verdigris.sources.shared import cut


#: Nodes of so many rows at most have their candidates evaluated in one task, all of them one after the other.
SMALL_NODE = 131_072


@dataclass(frozen=True)
class Config:
    trees: int = 2
    depth: int = 2
    groups: int = 2  # valid candidates compared at a node
    iterations: int = 3  # candidates drawn at most
    n_attr: int = 8  # log2 of it: columns of a candidate
    bag: float = 0.9
    least_share: float = 0.02  # rows of a leaf, of all
    seed: str = "forest"
    weights: dict[str, float] = field(default_factory=lambda: dict(C.WEIGHTS))

    def width(self, cols: list[str]) -> int:
        """Columns of a candidate."""
        return math.ceil(min(len(cols), int(math.log2(self.n_attr))))


def _split_small(wide: DataFrame, key: str, numeric: list[str], categorical: list[str], labels: list[str], least: int, c: Config) -> DataFrame:
    """tree, node, key, cl, iter, score, cols for the rows of each node that is split; a node is one task's."""
    kind = wide.schema[key].dataType.simpleString()

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(key, kind="stable")
        tree, node = int(rows["tree"].iloc[0]), int(rows["node"].iloc[0])
        y = rows[labels].to_numpy(np.int64)
        code = {k: pd.factorize(rows[k], use_na_sentinel=False)[0] for k in categorical}
        own = Node(rows[key].to_numpy(), {k: rows[k].to_numpy(float) for k in numeric}, code, y, y[:, 0] >= 0)
        best = None
        for it, cols, s, cl in itertools.islice(own.options(c.seed, tree, node, c.iterations, c.width([*numeric, *categorical]), least, c.weights), c.groups):
            if round(s, 9) > (best[0] if best else -1):
                best = (round(s, 9), it, cols, cl)
        if best is None:
            return rows[["tree", "node", key]].head(0).assign(cl=0, iter=0, score=0.0, cols=None)
        s, it, cols, cl = best
        return rows[["tree", "node", key]].assign(cl=cl, iter=it, score=s, cols=[cols] * len(rows))

    return wide.groupBy("tree", "node").applyInPandas(split, f"tree int, node long, {key} {kind}, cl int, iter int, score double, cols array<string>")


def grow(df: DataFrame, key: str, numeric: list[str], categorical: list[str], labels: list[str], c: Config, bags: DataFrame | None = None, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): nodes(tree, node, level, is_leaf, cols, score), members(tree, node, level, key) of every level.

    df: labels of -1 mark unlabelled rows. Node ids are heap numbers: root 1, children 2i and 2i + 1. A candidate's distances,
    spread and correlations are over the columns that it drew. A node takes the best of the first ``groups`` valid
    candidates among ``iterations``, ties to the first; without one it is a leaf.

    A level is one set of plans for the whole forest: nodes of SMALL_NODE rows at most are a group each, larger ones are
    split in parts (``large_nodes``). Both come to the same sides and scores. bags (tree, node 1, key): the
    members of the trees, drawn elsewhere from about ``rows`` rows each.
    """
    cols = [*numeric, *categorical]
    n = rows or df.count()
    if bags is None:
        each = F.explode(F.array(*(F.struct(F.lit(t).alias("tree"), F.lit(f"{c.seed}{t}").alias("seed")) for t in range(c.trees)))).alias("s")
        bags = sampling.inverse_frequency_bags(df.select(key, *labels, each).select(key, *labels, "s.*"), labels, c.bag, key)
        bags = cut(bags.select("tree", F.lit(1).cast("long").alias("node"), key))
    members = bags
    all_members, nodes, least = [members.withColumn("level", F.lit(0))], [], math.ceil(n * c.least_share)
    for level in range(c.depth + 1):
        size = cut(members.groupBy("tree", "node").agg(F.count("*").alias("n")))
        if level == c.depth:
            nodes.append(size.select("tree", "node", F.lit(level).alias("level"), F.lit(True).alias("is_leaf"), F.lit(None).cast("array<string>").alias("cols"), F.lit(None).cast("double").alias("score")))
            break
        wide = members.join(size, ["tree", "node"]).join(df.select(key, *cols, *labels), key)
        small = _split_small(wide.where(F.col("n") <= SMALL_NODE).drop("n"), key, numeric, categorical, labels, least, c)
        if not size.where(F.col("n") > SMALL_NODE).isEmpty():
            small = small.unionByName(large_nodes.split(wide.where(F.col("n") > SMALL_NODE).drop("n"), key, numeric, categorical, labels, least, c.iterations, c.groups, c.width(cols), c.seed, c.weights))
        split = cut(small)
        best = split.groupBy("tree", "node").agg(F.first("cols").alias("cols"), F.first("score").alias("score"), F.lit(False).alias("_inner"))
        nodes.append(size.join(best, ["tree", "node"], "left").select("tree", "node", F.lit(level).alias("level"), F.col("_inner").isNull().alias("is_leaf"), "cols", "score"))
        members = cut(split.select("tree", (2 * F.col("node") + F.col("cl")).alias("node"), key))
        all_members.append(members.withColumn("level", F.lit(level + 1)))
        if members.isEmpty():
            break
    union = lambda x: cut(reduce(DataFrame.unionByName, x))
    return union(nodes), union(all_members)


def children(members: DataFrame, df: DataFrame, nodes: DataFrame, key: str, numeric: list[str], categorical: list[str]) -> tuple[DataFrame, DataFrame]:
    """(tree, node, side, key, columns) of the members of the children of each inner node, columns that it did not draw being
    constant, and (tree, node, side, span_<col>) over both children."""
    inner = nodes.where("NOT is_leaf").select("tree", "node", "cols")
    child = members.where("node > 1").select("tree", F.shiftright("node", 1).alias("node"), (F.col("node") % 2).cast("int").alias("side"), key)
    child = masked(child.join(df.select(key, *numeric, *categorical), key).join(inner, ["tree", "node"]), ["tree", "node", "side", key], numeric, categorical)
    span = child.groupBy("tree", "node").agg(*((F.max(x) - F.min(x) + 1e-12).alias(f"span_{x}") for x in numeric))
    return child, span.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))


def masked(rows: DataFrame, keep: list[str], numeric: list[str], categorical: list[str]) -> DataFrame:
    """Columns that are not in cols made constant, so they add nothing to a distance."""
    taken = lambda x: F.array_contains("cols", F.lit(x))
    return rows.select(*keep, *(F.when(taken(x), F.col(x)).otherwise(F.lit(0.0)).alias(x) for x in numeric), *(F.when(taken(x), F.col(x)).otherwise(F.lit("")).alias(x) for x in categorical))


def route(rows: DataFrame, df: DataFrame, nodes: DataFrame, members: DataFrame, key: str, numeric: list[str], categorical: list[str], trees: DataFrame | None = None) -> DataFrame:
    """key, tree, node: the leaf that each row reaches in each tree, or in those that trees (key, tree) names. At a node the row goes to the child with the nearer nearest
    member by the node's columns (ties right), over the value ranges of both children's members; members are searched by
    the index of ``nearest``, not compared with every row."""
    inner = cut(nodes.where("NOT is_leaf").select("tree", "node", "level", "cols"))
    if trees is None:  # a row for each tree
        known = [r.tree for r in nodes.select("tree").distinct().collect()]
        trees = rows.select(key, F.explode(F.array(*map(F.lit, known)).cast("array<int>")).alias("tree"))
    at = cut(trees.select(key, "tree", F.lit(1).cast("long").alias("node")))
    child, span = (cut(x) for x in children(members, df, nodes, key, numeric, categorical))
    done = []
    for level in range(int(nodes.agg(F.max("level")).first()[0]) + 1):
        here = inner.where(F.col("level") == level).select("tree", "node", "cols")
        done.append(at.join(here.select("tree", "node"), ["tree", "node"], "left_anti").select(key, "tree", "node"))
        if here.isEmpty():
            break
        own = here.select("tree", "node")
        asked = at.join(here, ["tree", "node"]).join(rows.select(key, *numeric, *categorical), key).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
        asked = masked(asked, ["tree", "node", "side", key], numeric, categorical)
        near = nearest(child.join(own, ["tree", "node"]), asked, ["tree", "node", "side"], key, numeric, categorical, span, digits=9)
        near = near.groupBy(key, "tree", "node").agg(*(F.min(F.when(F.col("side") == s, F.col("d"))).alias(f"d{s}") for s in (0, 1)))
        at = cut(near.select(key, "tree", (2 * F.col("node") + F.when(F.col("d0") < F.col("d1"), 0).otherwise(1)).alias("node")))
    return reduce(DataFrame.unionAll, done)


def structure(nodes: DataFrame, members: DataFrame, df: DataFrame, key: str, sup) -> DataFrame:
    """tree, node, parent, left, right, level, is_leaf, cols, path (columns on the way), n, n_sup: a row for each node."""
    n = members.join(df.select(key, sup.alias("_s")), key).groupBy("tree", "node").agg(F.count("*").alias("n"), F.count(F.when(F.col("_s"), 1)).alias("n_sup"))
    out = nodes.join(n, ["tree", "node"]).withColumn("path", F.coalesce("cols", F.array().cast("array<string>")))
    for up in range(1, 1 + int(nodes.agg(F.max("level")).first()[0])):
        above = nodes.select("tree", F.col("node").alias("_a"), F.coalesce("cols", F.array().cast("array<string>")).alias("_c"))
        out = out.withColumn("_a", F.floor(F.col("node") / (1 << up)).cast("long")).join(above, ["tree", "_a"], "left").withColumn("path", F.array_union("path", F.coalesce("_c", F.array().cast("array<string>")))).drop("_a", "_c")
    inner = ~F.col("is_leaf")
    return out.select("tree", "node", F.when(F.col("node") > 1, F.floor(F.col("node") / 2).cast("long")).alias("parent"), F.when(inner, 2 * F.col("node")).alias("left"), F.when(inner, 2 * F.col("node") + 1).alias("right"), "level", "is_leaf", "cols", F.sort_array("path").alias("path"), "n", "n_sup")


def vote(leaf: DataFrame, key: str) -> DataFrame:
    """key, label, vote, prob, pred over the trees' (key, label, pred, prob)."""
    return leaf.groupBy(key, "label").agg(F.avg(F.col("pred").cast("double")).alias("vote"), F.avg("prob").alias("prob")).withColumn("pred", F.when(F.col("vote") >= 0.5, 1).otherwise(0))
