"""Seeded two-way clustering of the rows of each group, and the score of the split that it makes.

Groups are the candidates of one level of a forest: all of them go through each step in one plan. Distances are
only taken to the two anchor rows of a group; what needs all pairs (label spread, silhouette, feature spread) is
summed in linear form by the similarity operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.expressions import cosine, draw, gower, total
from verdigris.functions.prefix import before
from verdigris.operators import similarity as S
from verdigris.sources.shared import cut

WEIGHTS = {"labels": 1.0, "count_balance": 1.0, "ratio_balance": 1.0, "example_balance": 1.0, "silhouette": 1.0, "independence": 1.0, "features": 1.0}


def anchors(sup: DataFrame, group: list[str], key: str, labels: list[str]) -> DataFrame:
    """group, a, b: the row whose largest label distance is largest, and the row farthest from it; ties to the greater key.

    Label distances depend on the label vectors only, so a vector stands for its rows. Vectors without a common label are at
    distance 1, the greatest; which have one is told by an index of the labels. So where any vector has such a partner, the
    vector of the greatest key that has one is a, and only its partners are looked up; else the index's pairs hold all distances.
    Within its own vector a row's partner is the least key; zero vectors are at distance 1 from each other, as from all.
    """
    v = cut(sup.groupBy(*group, *labels).agg(F.max(key).alias("k"), F.min(key).alias("k0"), F.count("*").alias("n")).withColumn("s", total([F.col(c).cast("double") for c in labels])))
    index = v.select(*group, "k", F.explode(F.array_compact(F.array(*(F.when(F.col(c) == 1, F.lit(i)) for i, c in enumerate(labels))))).alias("label"))
    shared = cut(index.withColumnRenamed("k", "ka").join(index.withColumnRenamed("k", "kb"), [*group, "label"]).groupBy(*group, "ka", "kb").agg(F.count("*").cast("double").alias("c")))
    partners = shared.groupBy(*group, F.col("ka").alias("k")).agg(F.count("*").alias("m"))
    size = v.groupBy(*group).agg(F.count("*").alias("vectors"))
    own = v.join(partners, [*group, "k"], "left").join(size, group)
    far = ((F.col("s") > 0) & (F.col("m") < F.col("vectors"))) | ((F.col("s") == 0) & ((F.col("vectors") > 1) | (F.col("n") > 1)))
    top = cut(own.where(far).groupBy(*group).agg(F.max(F.struct(F.col("k").alias("a"), "s", "n", "k0")).alias("x")).select(*group, "x.*"))
    other = v.select(*group, F.col("k").alias("b")).join(top.select(*group, "a"), group).where("a <> b")
    other = other.join(shared.select(*group, F.col("ka").alias("a"), F.col("kb").alias("b")), [*group, "a", "b"], "left_anti")
    itself = top.where("s = 0 AND n > 1").select(*group, "a", F.col("k0").alias("b"))
    apart = other.select(*group, "a", "b").unionByName(itself).groupBy(*group, "a").agg(F.max("b").alias("b"))
    # groups in which every two vectors have a common label
    rest = shared.join(top.select(*group), group, "left_anti")
    sides = [v.select(*group, F.col("k").alias(f"k{t}"), F.col("s").alias(f"s{t}"), F.col("k0").alias(f"l{t}"), F.col("n").alias(f"n{t}")) for t in "ab"]
    rest = rest.join(sides[0], [*group, "ka"]).join(sides[1], [*group, "kb"])
    same = F.col("ka") == F.col("kb")
    d = F.when(same & (F.col("na") == 1), 0.0).otherwise(F.round(1 - F.col("c") / (F.sqrt("sa") * F.sqrt("sb")), 9) + 0.0)
    near = rest.groupBy(*group).agg(F.max(F.struct(d.alias("d"), F.col("ka").alias("a"), F.when(same, F.col("la")).otherwise(F.col("kb")).alias("b"))).alias("x")).select(*group, "x.a", "x.b")
    # a group of one zero vector has no distance but 0
    alone = v.join(size.where("vectors = 1"), group).where("s = 0 AND n = 1").select(*group, F.col("k").alias("a"), F.col("k0").alias("b"))
    return apart.select(*group, "a", "b").unionByName(near).unionByName(alone)


def coin(seed: str, *cols: str) -> Column:
    """True for half of the groups, by a hash: whether the rows in the order of w from b are transferred, or from a."""
    return F.substring(draw(f"{seed}coin", *cols), 1, 1) < "8"


def seed(df: DataFrame, group: list[str], key: str, numeric: list[str], categorical: list[str], labels: list[str], sup: str = "sup", stops_only: bool = False, from_b: Column | bool = True, width: int | None = None) -> DataFrame:
    """group, key, cl, centre0, centre1: the supervised rows that each group's clusters are seeded with, and the centres.

    w = 0.7 + 0.3 feature distance + 0.7 label distance. The seed of cluster 1 is the row farthest from a; the rows in
    the order of w from b follow it one by one, until the mean w from a over the rows left exceeds the mean w from b
    over cluster 1, or two are left. Where from_b (of the group's columns, as of ``coin``) is false, the seed is the row farthest
    from b and the rows follow in the order of w from a; the means stay. The rows left are cluster 0; a row in both lists is of
    cluster 1. The centres are the last rows of the lists. stops_only: group, stop, how many rows were moved. Groups with
    fewer than two supervised rows are left out. width: the number of columns that count, where others are the same in all rows.

    The first crossing of the suffix mean and the prefix mean is found by sums in two levels, not by a window over a group.
    """
    from_b = F.lit(from_b) if isinstance(from_b, bool) else from_b
    own = df.where(sup).select(*group, key, *numeric, *categorical, *labels)
    ab = cut(anchors(own, group, key, labels).where("a <> b"))
    r = S.ranges(df, group, numeric).alias("r")
    on = lambda t: [F.col(f"x.{g}") == F.col(f"{t}.{g}") for g in group]
    pick = lambda side: ab.select(*group, F.col(side).alias(key)).join(own, [*group, key]).withColumnRenamed(key, f"k{side}")
    j = own.alias("x").join(pick("a").alias("a"), on("a")).join(pick("b").alias("b"), on("b")).join(r, on("r"))
    w = lambda t: F.round(0.7 + 0.3 * gower("x", t, "r", numeric, categorical, width=width) + 0.7 * cosine("x", t, labels), 9)
    j = j.select(*(F.col(f"x.{g}").alias(g) for g in group), F.col(f"x.{key}").alias(key), F.col("a.ka").alias("a"), F.col("b.kb").alias("b"), w("a").alias("wa"), w("b").alias("wb"))
    # the row that isn't listed, by which w the seed is the farthest, and in which order the others follow
    j = j.withColumn("_by_b", from_b).withColumns({"skip": F.when(F.col("_by_b"), F.col("b")).otherwise(F.col("a")), "near": F.when(F.col("_by_b"), F.col("a")).otherwise(F.col("b")), "far": F.when(F.col("_by_b"), F.col("wa")).otherwise(F.col("wb")), "wo": F.when(F.col("_by_b"), F.col("wb")).otherwise(F.col("wa"))})
    j = cut(j.select(*group, key, "skip", "near", "far", "wo", "wa", "wb"))
    first = j.where(F.col(key) != F.col("near")).groupBy(*group).agg(F.max(F.struct("far", F.col(key).alias("k"), "wb")).alias("s")).select(*group, F.col("s.k").alias("seed"), F.col("s.wb").alias("wseed"))
    listed = j.where(F.col(key) != F.col("skip"))
    whole = listed.groupBy(*group).agg(F.count("*").alias("n"), F.sum("wa").alias("ta"))
    rest = before(listed, group, "wo", key, {"i": F.lit(1), "sa": F.col("wa"), "sb": F.col("wb")}).join(whole, group).join(first, group)
    rest = rest.withColumns({"m0": (F.col("ta") - F.col("sa")) / (F.col("n") - F.col("i")), "m1": (F.col("wseed") + F.col("sb")) / (F.col("i") + 1)})
    done = (F.col("i") >= 1) & (F.col("i") <= F.col("n") - 2) & (F.round("m0", 6) > F.round("m1", 6))
    stop = rest.groupBy(*group).agg(F.coalesce(F.min(F.when(done, F.col("i"))), F.max(F.greatest(F.col("n") - 2, F.lit(0)))).alias("stop"))
    if stops_only:
        return stop.select(*group, F.col("stop").cast("int").alias("stop"))
    rest = rest.join(stop, group)
    seeded = rest.where(F.col("seed") == F.col("skip")).select(*group, F.col("seed").alias(key), F.lit(1).alias("cl"), F.lit(False).alias("centre0"), (F.col("stop") == 0).alias("centre1")).distinct()
    own_cl = F.when((F.col(key) == F.col("seed")) | (F.col("i") < F.col("stop")), 1).otherwise(0)
    last1 = F.when(F.col("stop") > 0, F.col("i") == F.col("stop") - 1).otherwise(F.col(key) == F.col("seed"))
    return rest.select(*group, key, own_cl.alias("cl"), (F.col("i") == F.col("n") - 1).alias("centre0"), last1.alias("centre1")).unionAll(seeded)


def assign(df: DataFrame, seeds: DataFrame, group: list[str], key: str, numeric: list[str], categorical: list[str], width: int | None = None) -> DataFrame:
    """df and cl: the nearer centre (ties to 0); seeded rows keep their cluster. Groups without seeds are left out."""
    cols = [*numeric, *categorical]
    c = [seeds.where(f"centre{k}").join(df, [*group, key]).select(*group, *cols).alias(t) for k, t in ((0, "a"), (1, "b"))]
    r, x = S.ranges(df, group, numeric).alias("r"), df.alias("x")
    on = lambda t: [F.col(f"x.{g}") == F.col(f"{t}.{g}") for g in group]
    j = x.join(c[0], on("a")).join(c[1], on("b")).join(r, on("r"))
    d = lambda t: F.round(gower("x", t, "r", numeric, categorical, width=width), 9)
    j = j.select("x.*", F.when(d("b") < d("a"), 1).otherwise(0).alias("_near"))
    kept = seeds.select(*group, key, F.col("cl").alias("_kept"))
    return j.join(kept, [*group, key], "left").withColumn("cl", F.coalesce("_kept", "_near")).drop("_kept", "_near")


def example_balance(df: DataFrame, group: list[str], labels: list[str]) -> DataFrame:
    """group, balance: mean over labels of the smaller over the larger count of positives and negatives, 0 if one-sided."""
    agg = df.groupBy(*group).agg(*(F.count(F.when(F.col(c) == v, 1)).alias(f"n{v}_{c}") for c in labels for v in (0, 1)))
    each = [F.coalesce(F.try_divide(F.least(f"n0_{c}", f"n1_{c}").cast("double"), F.greatest(f"n0_{c}", f"n1_{c}")), F.lit(0.0)) for c in labels]
    return agg.select(*group, (total(each) / float(len(labels))).alias("balance"))


def old_balance(df: DataFrame, group: list[str], labels: list[str]) -> DataFrame:
    """group, balance: mean over labels of the label's count over the largest label's count."""
    agg = df.groupBy(*group).agg(*(F.count(F.when(F.col(c) == 1, 1)).cast("double").alias(c) for c in labels))
    return agg.select(*group, F.coalesce(F.try_divide(total([F.col(c) for c in labels]) / float(len(labels)), F.greatest(*labels)), F.lit(0.0)).alias("balance"))


def option_scores(df: DataFrame, group: list[str], key: str, numeric: list[str], categorical: list[str], labels: list[str], least_rows: int = 1, p: dict[str, float] | None = None, legacy: bool = False, width: int | None = None, numbers: str | None = None, matrix: bool = False) -> DataFrame:
    """group, score and its terms for rows with cl and sup: the weighted sum of seven terms; splits that a side makes
    invalid (no more than two labelled rows, fewer than least_rows rows) are left out before the costly terms.

    legacy: worse example balance scores higher. Terms of weight 0 are not computed. width: the number of columns that
    count, numbers: the column of how many of the numeric ones do, where others are the same in all rows.
    matrix: the feature term is the mean of the sides' distance matrices, scaled by column; else their mean distance over each side's
    own value ranges, in linear time.
    """
    p = p or WEIGHTS
    whole = sum(p.values())
    side = [*group, "cl"]
    size = df.groupBy(*group).agg(*(F.count(F.when(c, 1)).cast("double").alias(k) for k, c in (("n0", F.col("cl") == 0), ("n1", F.col("cl") == 1), ("s0", (F.col("cl") == 0) & F.col("sup")), ("s1", (F.col("cl") == 1) & F.col("sup")))))
    size = size.where((F.col("s0") > 2) & (F.col("s1") > 2) & (F.col("n0") >= least_rows) & (F.col("n1") >= least_rows))
    size = cut(size)
    df = cut(df.join(size.select(*group), group, "left_semi"))
    out = size
    terms = {
        "count_balance": F.least("s0", "s1") / F.greatest("s0", "s1"),
        "ratio_balance": F.least(F.col("s0") / F.col("n0"), F.col("s1") / F.col("n1")) / F.greatest(F.col("s0") / F.col("n0"), F.col("s1") / F.col("n1")),
    }
    mean = lambda t, c: t.groupBy(*group).agg(F.avg(c).alias(f"_{c}"))
    sup = df.where("sup")
    if p["labels"]:
        # the plain mean of the two sides, whatever their sizes
        out = out.join(mean(S.label_distance_sums(sup, side, labels).withColumnRenamed("avg", "l"), "l"), group)
        terms["labels"] = 1 - F.col("_l")
    if p["example_balance"]:
        out = out.join(mean(example_balance(sup, side, labels), "balance"), group)
        terms["example_balance"] = 1 - F.col("_balance") if legacy else F.col("_balance")
    if p["silhouette"]:
        out = out.join(mean(S.silhouettes(df, group, key, numeric, categorical, width=width), "s"), group)
        terms["silhouette"] = (F.col("_s") + 1) / 2
    if p["features"]:
        f = S.intra_distance(df, group, key, numeric, categorical) if matrix else S.average_distance(df, side, key, numeric, categorical, width)
        out = out.join(mean(f, "avg"), group)
        terms["features"] = 1 - F.col("_avg")
    if p["independence"]:
        terms["independence"] = F.lit(1.0)
        if len(numeric) > 1:
            r = squared_correlations(df, group, numeric)
            out = out.join(r, group)
            k = F.lit(len(numeric)) if numbers is None else F.col("_k")
            if numbers is not None:
                out = out.join(df.groupBy(*group).agg(F.max(numbers).alias("_k")), group)
            pairs = k * (k - 1) / 2
            terms["independence"] = 1 - F.coalesce(F.try_divide(k + F.col("_r2") if legacy else F.col("_r2"), pairs), F.lit(0.0))
    score = total([F.lit(p[k] / whole) * terms[k] for k in p if p[k]])
    return out.select(*group, score.alias("score"), *(terms[k].alias(k) for k in p if p[k]))


def squared_correlations(df: DataFrame, group: list[str], numeric: list[str]) -> DataFrame:
    """group, _r2: sum of the squared correlations of the columns, by moments; a constant column correlates with none."""
    mean = df.groupBy(*group).agg(*(F.avg(c).alias(f"m_{c}") for c in numeric))
    d = df.join(mean, group).select(*group, *((F.col(c) - F.col(f"m_{c}")).alias(c) for c in numeric))
    pairs = [(a, b) for i, a in enumerate(numeric) for b in numeric[i + 1 :]]
    agg = d.groupBy(*group).agg(*(F.sum(F.col(c) * F.col(c)).alias(f"v_{c}") for c in numeric), *(F.sum(F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a, b in pairs))
    return agg.select(*group, total([F.coalesce(F.try_divide(F.col(f"c_{a}_{b}") * F.col(f"c_{a}_{b}"), F.col(f"v_{a}") * F.col(f"v_{b}")), F.lit(0.0)) for a, b in pairs]).alias("_r2"))
