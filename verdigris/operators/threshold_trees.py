"""The older trees: cuts of one column by the reduction of its variance, checked by the compatibility of the labels on both sides.

A tree grows level by level over a table of memberships. A level's cuts come from sums over sorted values in two levels, its
compatibilities from the label vectors of each side; no node is one task's. The same nodes serve the walker, the counts
of a leaf and the stochastic prediction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.expressions import draw
from verdigris.functions.prefix import before
from verdigris.operators.splits import long_columns
from verdigris.sources.shared import cut


def own_cuts(df: DataFrame, group: list[str], key: str, cols: list[str]) -> DataFrame:
    """group, col, cut, reduction, gain: the cut v <= cut of each column that reduces the column's own variance most, both sides
    having two rows or more. reduction is relative to that variance (at 9 digits, ties to the least cut), gain is not."""
    by = [*group, "col"]
    values = long_columns(df, group, key, cols, []).groupBy(*by, "v").agg(F.count("*").cast("double").alias("n"))
    values = values.select(*by, "v", "n", (F.col("n") * F.col("v")).alias("s"), (F.col("n") * F.col("v") * F.col("v")).alias("q"))
    whole = values.groupBy(*by).agg(*(F.sum(c).alias(f"t{c}") for c in "nsq"))
    p = before(values, by, "v", "v", {"bn": F.col("n"), "bs": F.col("s"), "bq": F.col("q")}).join(whole, by)
    p = p.select(*by, "v", *((F.col(f"b{c}") + F.col(c)).alias(f"l{c}") for c in "nsq"), "tn", "ts", "tq").where("ln > 1 AND tn - ln > 1")
    var = lambda n, s, q: q / n - (s / n) * (s / n)
    rest = [F.col(f"t{c}") - F.col(f"l{c}") for c in "nsq"]
    left, right, all_ = var(F.col("ln"), F.col("ls"), F.col("lq")), var(*rest), var(F.col("tn"), F.col("ts"), F.col("tq"))
    reduction = F.round(F.coalesce(F.try_divide(all_ - F.col("ln") / F.col("tn") * left - (1 - F.col("ln") / F.col("tn")) * right, all_), F.lit(0.0)), 9)
    best = p.groupBy(*by).agg(F.max(F.struct(reduction.alias("reduction"), (-F.col("v")).alias("m"))).alias("x"), F.max(all_).alias("all"))
    return best.select(*by, (-F.col("x.m")).alias("cut"), F.col("x.reduction").alias("reduction"), (F.col("x.reduction") * F.col("all")).alias("gain"))


def compatibility(df: DataFrame, group: list[str], labels: list[str]) -> DataFrame:
    """group, compat: the mean Jaccard similarity (1e-8 in the union) over all ordered pairs of a group's rows, a row with itself
    included; a pair with an unlabelled row (-1) counts -1.

    Similarities differ from 0 only between rows that share a label, so vectors meet by an index of their labels.
    """
    sup = F.col(labels[0]) >= 0
    size = df.groupBy(*group).agg(F.count("*").cast("double").alias("n"), F.count(F.when(sup, 1)).cast("double").alias("s"))
    v = df.where(sup).groupBy(*group, F.concat_ws("", *(F.col(c).cast("int") for c in labels)).alias("y")).agg(F.count("*").cast("double").alias("w"))
    v = cut(v.select(*group, "y", "w", F.explode(F.filter(F.sequence(F.lit(1), F.lit(len(labels))), lambda i: F.substr(F.col("y"), i, F.lit(1)) == "1")).alias("label")))
    held = v.groupBy(*group, "y").agg(F.count("*").cast("double").alias("k"), F.first("w").alias("w"))
    other = v.select(*group, F.col("y").alias("z"), "label")
    shared = v.select(*group, "y", "label").join(other, [*group, "label"]).groupBy(*group, "y", "z").agg(F.count("*").cast("double").alias("c"))
    pairs = shared.join(held, [*group, "y"]).join(held.select(*group, F.col("y").alias("z"), F.col("k").alias("kz"), F.col("w").alias("wz")), [*group, "z"])
    total = pairs.groupBy(*group).agg(F.sum(F.col("w") * F.col("wz") * F.col("c") / (F.col("k") + F.col("kz") - F.col("c") + 1e-8)).alias("t"))
    n, s = F.col("n"), F.col("s")
    return size.join(total, group, "left").select(*group, ((F.coalesce("t", F.lit(0.0)) - (n * n - s * s)) / (n * n)).alias("compat"))


def grow(df: DataFrame, key: str, cols: list[str], labels: list[str], stop_share: float = 0.2, depth: int = 16) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): nodes(node, level, col, cut, reduction, gain, compat), col null for a leaf; members(node, level, key) of every level.

    A node is a leaf if it has less than stop_share of all rows (the root excepted), fewer than two labelled rows, no column
    with a cut, or is at depth. Columns are taken in order: one replaces the best so far if it reduces variance more and the mean
    compatibility of its two sides (at 6 digits) is greater, the first having to be above -1. Heap numbers as in forests.
    """
    n, node = df.count(), ["node"]
    values = df.select(key, *cols, *labels)
    members = cut(df.select(F.lit(1).cast("long").alias("node"), key))
    nodes, every = [], [members.withColumn("level", F.lit(0))]
    for level in range(depth + 1):
        wide = members.join(values, key)
        size = wide.groupBy("node").agg(F.count("*").alias("n"), F.count(F.when(F.col(labels[0]) >= 0, 1)).alias("s"))
        stops = (F.col("s") < 2) | (F.lit(level > 0) & (F.col("n") < n * stop_share)) | F.lit(level == depth)
        size = cut(size.select("node", stops.alias("stops")))
        wide = cut(wide.join(size.where("NOT stops").select("node"), "node"))
        cuts = cut(own_cuts(wide, node, key, cols))
        sides = long_columns(wide, node, key, cols, labels).join(cuts.select("node", "col", "cut"), ["node", "col"]).withColumn("side", (F.col("v") > F.col("cut")).cast("int"))
        both = compatibility(sides, ["node", "col", "side"], labels).groupBy("node", "col").agg(F.round(F.avg("compat"), 6).alias("compat"))
        place = F.array_position(F.array(*map(F.lit, cols)), F.col("col"))
        ordered = cuts.join(both, ["node", "col"]).groupBy("node").agg(F.sort_array(F.collect_list(F.struct(place.alias("place"), "col", "cut", "reduction", "gain", "compat"))).alias("c"))  # a row for each column
        none = F.struct(F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("col"), F.lit(None).cast("double").alias("cut"), F.lit(0.0).alias("reduction"), F.lit(float("-inf")).alias("gain"), F.lit(-1.0).alias("compat"))
        best = ordered.select("node", F.aggregate("c", none, lambda s, x: F.when((x["gain"] > s["gain"]) & (x["compat"] > s["compat"]), x).otherwise(s)).alias("b")).where("b.col IS NOT NULL")
        best = cut(best.select("node", "b.col", "b.cut", "b.reduction", "b.gain", "b.compat"))
        nodes.append(size.select("node").join(best, "node", "left").withColumn("level", F.lit(level)))
        v = reduce(lambda a, c: F.when(F.col("col") == c, F.col(c).cast("double")).otherwise(a), cols, F.lit(None).cast("double"))
        members = cut(wide.join(best, "node").select((2 * F.col("node") + (v > F.col("cut")).cast("long")).alias("node"), key))
        if level == depth or members.isEmpty():
            break
        every.append(members.withColumn("level", F.lit(level + 1)))
    union = lambda x: cut(reduce(DataFrame.unionByName, x))
    return union(nodes), union(every)


def walk(rows: DataFrame, nodes: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """key, node: the leaf that each row reaches; v <= cut goes left."""
    at, done = rows.select(key, *cols).withColumn("node", F.lit(1).cast("long")), []
    inner = nodes.where("col IS NOT NULL").select("node", "col", "cut")
    v = reduce(lambda a, c: F.when(F.col("col") == c, F.col(c).cast("double")).otherwise(a), cols, F.lit(None).cast("double"))
    for _ in range(1 + int(nodes.agg(F.max("level")).first()[0])):
        here = at.join(inner, "node", "left")
        done.append(here.where("col IS NULL").select(key, "node"))
        at = cut(here.where("col IS NOT NULL").select(key, *cols, (2 * F.col("node") + (v > F.col("cut")).cast("long")).alias("node")))
    return reduce(DataFrame.unionAll, done)


def leaf_shares(members: DataFrame, nodes: DataFrame, df: DataFrame, key: str, labels: list[str]) -> DataFrame:
    """node, label, zeros, ones, prob: the labelled rows of each leaf; prob is 0 for a leaf without any."""
    own = members.join(nodes.where("col IS NULL").select("node"), "node").join(df.select(key, *labels), key)
    long = own.select("node", F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(c).alias("y")) for i, c in enumerate(labels)))).alias("s")).select("node", "s.*")
    out = long.groupBy("node", "label").agg(F.count(F.when(F.col("y") == 0, 1)).alias("zeros"), F.count(F.when(F.col("y") == 1, 1)).alias("ones"))
    return out.withColumn("prob", F.coalesce(F.try_divide(F.col("ones").cast("double"), F.col("zeros") + F.col("ones")), F.lit(0.0)))


def stochastic(leaves: DataFrame, key: str, prob: Column, seed: str, other: Column | None = None, accuracy: Column | None = None) -> DataFrame:
    """leaves and pred, probability: 1 where a hash draw r of the row and label has r >= 1 - prob. With the probability of another
    classifier and its accuracy, probability is 0.4 of that, drawn towards 0.5 by the accuracy, and 0.6 of prob, and pred
    is the other classifier's."""
    r = F.conv(F.substring(draw(seed, "label", key), 1, 8), 16, 10).cast("double") / 4294967296.0
    if other is None:
        return leaves.withColumns({"pred": (r >= 1 - prob).cast("int"), "probability": prob})
    blend = 0.4 * ((other - 0.5) * accuracy + 0.5) + 0.6 * prob
    return leaves.withColumns({"pred": (other >= 0.5).cast("int"), "probability": blend})
