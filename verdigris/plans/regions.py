"""Regions of a label along an attribute, and the relations of labels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdigris.functions.prefix import runs
from verdigris.plans.registry import query
from verdigris.sources import tables as T


def islands(df, group, key, x, flag):
    """group, island, lo, hi, n, flag: maximal runs of rows with one flag along x; bounds at the midpoints between runs,
    open (null) at the ends."""
    return _summed(runs(df, group, x, key, flag), group, key, x, flag)


def _summed(placed, group, key, x, flag):
    at = F.struct(x, key)
    g = placed.groupBy(*group, "island").agg(F.first(flag).alias(flag), F.count("*").alias("n"), F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.min_by("prev", at).alias("_p"), F.max_by("next", at).alias("_q"))
    return g.select(*group, "island", flag, "n", ((F.col("_p") + F.col("_lo")) / 2).alias("lo"), ((F.col("_hi") + F.col("_q")) / 2).alias("hi"), F.col("_lo").alias("least"))


_I = """z AS (SELECT yl.node, label, row_id, y, x1 FROM yl JOIN cm USING (row_id)),
i0 AS (SELECT *, CASE WHEN y <> lag(y) OVER o THEN 1 ELSE 0 END AS nw, lag(x1) OVER o AS pv, lead(x1) OVER o AS nx FROM z WINDOW o AS (PARTITION BY node, label ORDER BY x1, row_id)),
i1 AS (SELECT *, sum(nw) OVER (PARTITION BY node, label ORDER BY x1, row_id ROWS UNBOUNDED PRECEDING) AS island FROM i0),
isl AS (SELECT node, label, CAST(island AS INTEGER) AS island, any_value(y) AS y, count(*) AS n, (arg_min(pv, (x1, row_id)) + min(x1)) / 2 AS lo, (max(x1) + arg_max(nx, (x1, row_id))) / 2 AS hi, min(x1) AS least FROM i1 GROUP BY node, label, island)""".replace("arg_min(pv, (x1, row_id))", "first(pv ORDER BY x1, row_id)").replace("arg_max(nx, (x1, row_id))", "last(nx ORDER BY x1, row_id)")


def _long(spark, sf):
    df = T.customer_ml(spark, sf)
    return df.select("row_id", "node", "x1", F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(c).alias("y")) for i, c in enumerate(T.LABELS)))).alias("s")).select("row_id", "node", "x1", "s.*")


@query("g1_regions", f"WITH {_I} SELECT node, label, island, y, n, round(lo, 4) AS lo, round(hi, 4) AS hi FROM isl")
def g1(spark, sf):
    return islands(_long(spark, sf), ["node", "label"], "row_id", "x1", "y").select("node", "label", "island", "y", "n", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


@query("g2_region_weights", f"""WITH {_I} SELECT node, label, count(CASE WHEN y = 1 THEN 1 END) AS regions, max(CASE WHEN y = 1 THEN n END) AS largest,
 round(sum(CASE WHEN y = 1 THEN n END) / sum(n) / (count(CASE WHEN y = 1 THEN 1 END) + CASE WHEN last(y ORDER BY island) = 0 THEN 1 ELSE 0 END + 1e-6), 6) AS density,
 round(sum(CASE WHEN y = 1 THEN n / ((SELECT count(*) FROM cm WHERE cm.node = isl.node) + 1e-7) END) / (count(CASE WHEN y = 1 THEN 1 END) + 1e-7), 6) AS weight,
 round(first(coalesce(lo, least) ORDER BY island) FILTER (WHERE y = 1), 4) AS lo, round(last(coalesce(hi, lo, least) ORDER BY island) FILTER (WHERE y = 1), 4) AS hi FROM isl GROUP BY ALL HAVING max(y) = 1""")
def g2(spark, sf):
    """density: the regions' shares of the node's rows over the number of bags, of which an empty one follows a last
    region that ends before the last row; weight: the same over the regions alone. lo and hi: the least and greatest bound."""
    r = islands(_long(spark, sf), ["node", "label"], "row_id", "x1", "y")
    own = F.col("y") == 1
    g = r.groupBy("node", "label").agg(
        F.count(F.when(own, 1)).alias("regions"), F.max(F.when(own, F.col("n"))).alias("largest"), F.sum(F.when(own, F.col("n"))).alias("s"), F.sum("n").alias("t"), F.max_by("y", "island").alias("end"),
        F.min(F.when(own, F.struct("island", F.coalesce("lo", "least").alias("v")))).alias("a"), F.max(F.when(own, F.struct("island", F.coalesce("hi", "lo", "least").alias("v")))).alias("b"),
    ).where("regions > 0")
    bags = F.col("regions") + F.when(F.col("end") == 0, 1).otherwise(0) + 1e-6
    return g.select("node", "label", "regions", "largest", F.round(F.col("s") / F.col("t") / bags, 6).alias("density"), F.round(F.col("s") / (F.col("t") + 1e-7) / (F.col("regions") + 1e-7), 6).alias("weight"), F.round("a.v", 4).alias("lo"), F.round("b.v", 4).alias("hi"))


@query("g3_median_of_interest", f"""WITH {_I}, c AS (SELECT *, sum(CASE WHEN y = 1 THEN n ELSE 0 END) OVER w AS cn, sum(n) OVER w AS passed, sum(CASE WHEN y = 1 THEN n ELSE 0 END) OVER g AS tn, sum(n) OVER g AS total FROM isl WINDOW w AS (PARTITION BY node, label ORDER BY island), g AS (PARTITION BY node, label)),
m AS (SELECT *, row_number() OVER (PARTITION BY node, label ORDER BY island) AS r FROM c WHERE y = 1 AND 2 * cn > tn)
SELECT node, label, island, round(hi, 4) AS split, CAST(passed AS BIGINT) AS n_left, CAST(total - passed AS BIGINT) AS n_right FROM m WHERE r = 1""")
def g3(spark, sf):
    """The first region at which more than half of the label's rows are passed: its upper bound splits the node (null: it
    is open), the rows up to its last one go left."""
    r = islands(_long(spark, sf), ["node", "label"], "row_id", "x1", "y")
    g = Window.partitionBy("node", "label")
    w = g.orderBy("island").rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("y") == 1, F.col("n")).otherwise(0)
    r = r.withColumns({"cn": F.sum(own).over(w), "at": F.sum("n").over(w), "tn": F.sum(own).over(g), "rows": F.sum("n").over(g)})
    x = r.where("y = 1 AND 2 * cn > tn").groupBy("node", "label").agg(F.min(F.struct("island", "hi", "at", (F.col("rows") - F.col("at")).alias("right"))).alias("x"))
    return x.select("node", "label", "x.island", F.round("x.hi", 4).alias("split"), F.col("x.at").alias("n_left"), F.col("x.right").alias("n_right"))


@query("g4_distance_to_region_mean", f"""WITH {_I}, t AS (SELECT node, label, count(*) AS rows FROM z GROUP BY ALL),
p AS (SELECT i.node, i.label, i.island, any_value(t.rows) AS rows, max(CASE WHEN i.lo IS NULL AND i.hi IS NULL THEN 1 ELSE 0 END) AS everywhere, count(z.row_id) AS n,
 coalesce(avg(CASE WHEN z.row_id IS NULL THEN NULL WHEN i.lo IS NULL OR i.hi IS NULL THEN 0.5 ELSE coalesce(abs((x1 - i.lo) / nullif(i.hi - i.lo, 0) - 0.5), 0.5) END), 0.5) AS d
 FROM isl i JOIN t ON t.node = i.node AND t.label = i.label LEFT JOIN z ON z.node = i.node AND z.label = i.label AND (i.lo IS NULL OR x1 >= i.lo) AND (i.hi IS NULL OR x1 <= i.hi) WHERE i.y = 1 GROUP BY ALL)
SELECT node, label, round(CASE WHEN max(everywhere) = 1 THEN 0 ELSE avg(d) END, 6) AS d, round(CASE WHEN max(everywhere) = 1 THEN 1 ELSE avg(n / rows) END, 6) AS weight FROM p GROUP BY node, label""")
def g4(spark, sf):
    """|(x - lo) / width - 1/2| of the node's rows within a region's closed bounds (1/2 where a side is open or the width
    is 0), averaged by region, then over the regions; weight: the mean share of the rows. A region over everything gives
    0 and 1.

    Bounds are midpoints of neighbours, so a row of another run lies within only where it shares its x with a row of the
    region: the values of the region's own rows, joined with the count of all rows of each value, are all its points."""
    group = ["node", "label"]
    placed = runs(_long(spark, sf), group, "x1", "row_id", "y")
    regions = _summed(placed, group, "row_id", "x1", "y").where("y = 1")
    values = placed.where("y = 1").select(*group, "island", "x1").distinct().join(placed.groupBy(*group, "x1").agg(F.count("*").alias("c")), [*group, "x1"])
    far = F.coalesce(F.abs(F.try_divide(F.col("x1") - F.col("lo"), F.col("hi") - F.col("lo")) - 0.5), F.lit(0.5))
    p = values.join(regions, [*group, "island"]).groupBy(*group, "island").agg((F.sum(far * F.col("c")) / F.sum("c")).alias("d"), F.sum("c").alias("n"), F.max(F.col("lo").isNull() & F.col("hi").isNull()).alias("whole"))
    g = p.join(placed.groupBy(*group).agg(F.count("*").alias("t")), group).groupBy(*group).agg(F.avg("d").alias("d"), F.avg(F.col("n") / F.col("t")).alias("w"), F.max("whole").alias("whole"))
    return g.select(*group, F.round(F.when(F.col("whole"), 0.0).otherwise(F.col("d")), 6).alias("d"), F.round(F.when(F.col("whole"), 1.0).otherwise(F.col("w")), 6).alias("weight"))


_REL = """iv AS (SELECT node, label, min(CASE WHEN y = 1 THEN x3 END) AS lo, max(CASE WHEN y = 1 THEN x3 END) AS hi FROM yl JOIN cm USING (row_id, node) GROUP BY ALL),
rel AS (SELECT a.node, a.label AS a, b.label AS b, CASE WHEN a.label = b.label THEN 'self' WHEN a.lo IS NULL OR b.lo IS NULL THEN 'none' WHEN (a.lo <= b.lo AND a.hi >= b.hi) OR (a.lo >= b.lo AND a.hi <= b.hi) THEN 'parent-child' ELSE 'relative' END AS kind,
 a.label <> b.label AND a.lo <= b.lo AND a.hi >= b.hi AS over_b, a.label <> b.label AND a.lo >= b.lo AND a.hi <= b.hi AS under_b FROM iv a JOIN iv b ON a.node = b.node)"""


def relations(df):
    """node, a, b, kind, over_b, under_b: how the value ranges of two labels' positives lie to each other: self, none (a
    label without positives), parent-child (one contains the other; over_b: a is a parent, under_b: a child, both where
    they are equal), else relative: both ends in the same order, overlapping or not."""
    own = F.when(F.col("y") == 1, F.col("x3"))
    iv = df.groupBy("node", "label").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    a, b = iv.alias("a"), iv.alias("b")
    j = a.join(b, F.col("a.node") == F.col("b.node"))  # a row for each two labels of a node
    same, over, under = F.col("a.label") == F.col("b.label"), F.expr("a.lo <= b.lo AND a.hi >= b.hi"), F.expr("a.lo >= b.lo AND a.hi <= b.hi")
    kind = F.when(same, "self").when(F.expr("a.lo IS NULL OR b.lo IS NULL"), "none").when(over | under, "parent-child").otherwise("relative")
    return j.select(F.col("a.node").alias("node"), F.col("a.label").alias("a"), F.col("b.label").alias("b"), kind.alias("kind"), (~same & over).alias("over_b"), (~same & under).alias("under_b"))


def _ranges(spark, sf):
    df = T.customer_ml(spark, sf)
    return df.select("row_id", "node", "x3", F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(c).alias("y")) for i, c in enumerate(T.LABELS)))).alias("s")).select("row_id", "node", "x3", "s.*")


@query("g6_label_relations", f"WITH {_REL} SELECT node, a, b, kind FROM rel")
def g6(spark, sf):
    return relations(_ranges(spark, sf)).select("node", "a", "b", "kind")


@query("g7_label_graph", f"""WITH {_REL} SELECT node, a, count(*) AS degree, string_agg(CAST(b AS VARCHAR), ',' ORDER BY b) AS adjacent,
 coalesce(string_agg(CASE WHEN under_b THEN CAST(b AS VARCHAR) END, ',' ORDER BY b), '') AS parents, coalesce(string_agg(CASE WHEN over_b THEN CAST(b AS VARCHAR) END, ',' ORDER BY b), '') AS children FROM rel WHERE kind NOT IN ('self', 'none') GROUP BY ALL""")
def g7(spark, sf):
    """The labels that a label has an edge to, and which of them contain it or are contained."""
    e = relations(_ranges(spark, sf)).where("kind NOT IN ('self', 'none')")
    listed = lambda c: F.array_join(F.sort_array(F.collect_list(c)), ",")
    return e.groupBy("node", "a").agg(F.count("*").alias("degree"), listed(F.col("b")).alias("adjacent"), listed(F.when(F.col("under_b"), F.col("b"))).alias("parents"), listed(F.when(F.col("over_b"), F.col("b"))).alias("children"))
