"""Rule and leaf reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import metrics as M
from verdigris.operators import tabular
from verdigris.plans.metrics import pred
from verdigris.plans.registry import query
from verdigris.sources import tables as T

X = T.NUMERIC
_CF = "cf AS (SELECT tree, leaf, label, count(CASE WHEN prob >= 0.5 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN prob >= 0.5 AND y = 0 THEN 1 END) AS fp, count(CASE WHEN prob < 0.5 AND y = 1 THEN 1 END) AS fn, count(*) AS n FROM act GROUP BY ALL)"


def leaf_ranges(df, member, cols):
    """tree, leaf, col, lo, hi: least and greatest value of each column in each leaf."""
    j = member.join(df, "row_id")
    agg = j.groupBy("tree", "leaf").agg(*(F.struct(F.lit(c).alias("col"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c) for c in cols))
    return agg.select("tree", "leaf", F.explode(F.array(*cols)).alias("s")).select("tree", "leaf", "s.*")


@query("a10_leaf_ranges", "SELECT tree, leaf, col, min(v) AS lo, max(v) AS hi FROM (SELECT DISTINCT tree, leaf, row_id FROM act) JOIN xl USING (row_id) GROUP BY ALL")
def a10(spark, sf):
    return leaf_ranges(T.customer_ml(spark, sf), T.scores(spark, sf, 3).select("tree", "leaf", "row_id").distinct(), X)


@query("x1_activations", "SELECT row_id, tree, leaf, label, CAST(prob >= 0.5 AS INTEGER) AS pred, prob, y AS real, CAST(prob >= 0.5 AND y = 1 AS INTEGER) AS tp, CAST(prob < 0.5 AND y = 0 AS INTEGER) AS tn, CAST(prob >= 0.5 AND y = 0 AS INTEGER) AS fp, CAST(prob < 0.5 AND y = 1 AS INTEGER) AS fn FROM act")
def x1(spark, sf):
    d = T.scores(spark, sf, 3)
    p, y = F.col("prob") >= 0.5, F.col("y") == 1
    return d.select("row_id", "tree", "leaf", "label", p.cast("int").alias("pred"), "prob", F.col("y").alias("real"), *(c.cast("int").alias(k) for k, c in (("tp", p & y), ("tn", ~p & ~y), ("fp", p & ~y), ("fn", ~p & y))))


@query("x2_rule_quality", f"""WITH {_CF}, r AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS rc, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM cf)
SELECT concat_ws('_', tree, leaf) AS id, CAST(sum(n) AS BIGINT) AS n, round(avg(p), 6) AS macro_precision, round(avg(rc), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 6) AS micro_f1 FROM r GROUP BY tree, leaf""")
def x2(spark, sf):
    by = ["tree", "leaf"]
    c = M.confusion(T.scores(spark, sf, 3), pred(), [*by, "label"])
    r = M.rates(c, [*by, "label"]).groupBy(*by).agg(*(F.round(F.avg(k), 6).alias(f"macro_{k}") for k in ("precision", "recall", "f1")))
    pooled = c.groupBy(*by).agg(F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("n"), F.round(F.try_divide((2 * F.sum("tp")).cast("double"), F.sum(2 * F.col("tp") + F.col("fp") + F.col("fn"))), 6).alias("micro_f1"))
    return r.join(pooled, by).select(F.concat_ws("_", *by).alias("id"), "n", "macro_precision", "macro_recall", "macro_f1", "micro_f1")


@query("x5_label_distributions", """SELECT 'all' AS part, label, round(avg(y), 6) AS rate FROM yl GROUP BY label UNION ALL SELECT 'supervised', label, round(avg(CASE WHEN sup THEN y END), 6) FROM yl GROUP BY label
UNION ALL SELECT 'model', label, round(avg(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END), 6) FROM sc GROUP BY label""")
def x5(spark, sf):
    df = T.customer_ml(spark, sf)
    part = lambda d, name: d.select(F.lit(name).alias("part"), "label", F.round("rate", 6).alias("rate"))
    model = T.scores(spark, sf).groupBy("label").agg(F.avg(pred()).alias("rate"))
    return part(tabular.positive_rates(df, T.LABELS), "all").unionAll(part(tabular.positive_rates(df, T.MASKED), "supervised")).unionAll(part(model, "model"))


@query("x6_plot_distribution", "SELECT concat_ws('_', tree, leaf) AS id, label, round(avg(prob), 6) AS mean_prob, round(tree / max(tree) OVER (), 6) AS hue FROM act GROUP BY tree, leaf, label")
def x6(spark, sf):
    d = T.scores(spark, sf, 3)
    top = d.agg(F.max("tree").alias("top"))
    m = d.groupBy("tree", "leaf", "label").agg(F.round(F.avg("prob"), 6).alias("mean_prob")).join(F.broadcast(top))  # one row
    return m.select(F.concat_ws("_", "tree", "leaf").alias("id"), "label", "mean_prob", F.round(F.col("tree") / F.col("top"), 6).alias("hue"))


@query("x7_plot_ranges", """WITH r AS (SELECT tree, leaf, col, min(v) AS lo, max(v) AS hi FROM (SELECT DISTINCT tree, leaf, row_id FROM act) JOIN xl USING (row_id) GROUP BY ALL), g AS (SELECT col, min(v) AS l, max(v) AS h FROM xl GROUP BY col)
SELECT tree, leaf, col, round((lo - l) / (h - l), 6) AS lo, round((hi - l) / (h - l), 6) AS hi FROM r JOIN g USING (col)""")
def x7(spark, sf):
    df = T.customer_ml(spark, sf)
    r = leaf_ranges(df, T.scores(spark, sf, 3).select("tree", "leaf", "row_id").distinct(), X)
    g = r.groupBy("col").agg(F.min("lo").alias("l"), F.max("hi").alias("h"))
    s = lambda c: F.round(F.try_divide(F.col(c) - F.col("l"), F.col("h") - F.col("l")), 6).alias(c)
    return r.join(g, "col").select("tree", "leaf", "col", s("lo"), s("hi"))


@query("f9_forest_diversity", """WITH p AS (SELECT a.tree AS t, b.tree AS u, sqrt(sum((a.prob - b.prob) ** 2)) / sqrt(5) AS d FROM act a JOIN act b ON a.row_id = b.row_id AND a.label = b.label AND a.tree <> b.tree GROUP BY a.row_id, a.tree, b.tree),
m AS (SELECT t, u, avg(d) AS d FROM p GROUP BY t, u) SELECT round(avg(near), 6) AS diversity FROM (SELECT t, min(d) AS near FROM m GROUP BY t)""")
def f9(spark, sf):
    """Mean over trees of the distance to the nearest other tree; trees' distances are means over rows."""
    s = T.scores(spark, sf, 3).groupBy("row_id", "label").agg(F.collect_list(F.struct("tree", "prob")).alias("p"))  # the trees
    pair = F.explode("p").alias("a")
    j = s.select("row_id", "label", pair, "p").select("row_id", "label", "a", F.explode("p").alias("b")).where("a.tree <> b.tree")
    d = j.groupBy("row_id", F.col("a.tree").alias("t"), F.col("b.tree").alias("u")).agg((F.sqrt(F.sum(F.pow(F.col("a.prob") - F.col("b.prob"), F.lit(2)))) / F.sqrt(F.count("*"))).alias("d"))
    near = d.groupBy("t", "u").agg(F.avg("d").alias("d")).groupBy("t").agg(F.min("d").alias("near"))
    return near.agg(F.round(F.avg("near"), 6).alias("diversity"))
