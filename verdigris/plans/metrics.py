"""Metrics over hashed scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import metrics as M
from verdigris.operators import sampling
from verdigris.plans.registry import query
from verdigris.sources import tables as T



def pred():
    return F.when(F.col("prob") >= 0.5, 1).otherwise(0)


_T = """g AS (SELECT label, prob, sum(y) AS tp, count(*) AS n FROM sc GROUP BY ALL),
c AS (SELECT *, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn, sum(tp) OVER (PARTITION BY label) AS p, sum(n) OVER (PARTITION BY label) AS al FROM g WINDOW w AS (PARTITION BY label ORDER BY prob DESC))"""
_TM = _T.replace("label, prob, sum(y)", "0 AS label, prob, sum(y)")
_CF = "cf AS (SELECT label, count(CASE WHEN prob < 0.5 AND y = 0 THEN 1 END) AS tn, count(CASE WHEN prob < 0.5 AND y = 1 THEN 1 END) AS fn, count(CASE WHEN prob >= 0.5 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN prob >= 0.5 AND y = 0 THEN 1 END) AS fp FROM sc GROUP BY label)"


@query("m1_macro_ap", f"WITH {_T} SELECT round(avg(ap), 6) AS ap FROM (SELECT label, sum(tp / p * ctp / cn) AS ap FROM c GROUP BY label)")
def m1(spark, sf):
    return M.average_precision(T.scores(spark, sf), ["label"]).agg(F.round(F.avg("ap"), 6).alias("ap"))


@query("m2_label_ap", f"WITH {_T} SELECT label, round(sum(tp / p * ctp / cn), 6) AS ap FROM c GROUP BY label")
def m2(spark, sf):
    return M.average_precision(T.scores(spark, sf), ["label"]).select("label", F.round("ap", 6).alias("ap"))


@query("m2_precision_recall_curve", f"WITH {_T} SELECT label, prob, round(ctp / cn, 6) AS precision, round(ctp / p, 6) AS recall FROM c")
def m2_curve(spark, sf):
    return M.precision_recall(T.scores(spark, sf), ["label"]).select("label", "prob", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


@query("m3_micro_ap", f"WITH {_TM} SELECT round(sum(tp / p * ctp / cn), 6) AS ap FROM c")
def m3(spark, sf):
    return M.average_precision(T.scores(spark, sf), []).select(F.round("ap", 6).alias("ap"))


@query("m4_label_ranking_precision", """WITH p AS (SELECT a.row_id, a.label, count(CASE WHEN b.y = 1 THEN 1 END) / count(*) AS s FROM sc a JOIN sc b ON a.row_id = b.row_id AND b.prob >= a.prob WHERE a.y = 1 GROUP BY ALL)
SELECT round(avg(coalesce(s, 1)), 6) AS lrap FROM (SELECT DISTINCT row_id FROM sc) LEFT JOIN (SELECT row_id, CASE WHEN count(*) = 5 THEN 1 ELSE avg(s) END AS s FROM p GROUP BY row_id) USING (row_id)""")
def m4(spark, sf):
    return M.label_ranking_precision(T.scores(spark, sf)).select(F.round("lrap", 6).alias("lrap"))


@query("m5_subset_accuracy", "SELECT round(avg(ok), 6) AS accuracy FROM (SELECT row_id, min(CASE WHEN (prob >= 0.5) = (y = 1) THEN 1 ELSE 0 END) AS ok FROM sc GROUP BY row_id)")
def m5(spark, sf):
    return M.subset_accuracy(T.scores(spark, sf), pred()).select(F.round("accuracy", 6).alias("accuracy"))


@query("m6_hamming_loss", "SELECT round(avg(CASE WHEN (prob >= 0.5) <> (y = 1) THEN 1 ELSE 0 END), 6) AS loss FROM sc")
def m6(spark, sf):
    return M.hamming_loss(T.scores(spark, sf), pred()).select(F.round("loss", 6).alias("loss"))


@query("m7_rank_auc", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY prob DESC, label) AS k FROM sc), b AS (SELECT k, sum(y) AS tp, sum(1 - y) AS fp FROM r GROUP BY k),
c AS (SELECT k, sum(tp) OVER (ORDER BY k) / sum(tp) OVER () AS tpr, sum(fp) OVER (ORDER BY k) / sum(fp) OVER () AS fpr FROM b), d AS (SELECT (fpr - lag(fpr) OVER (ORDER BY k)) * (tpr + lag(tpr) OVER (ORDER BY k)) / 2 AS area FROM c)
SELECT round(sum(area), 6) AS auc FROM d""")
def m7(spark, sf):
    return M.rank_auc(T.scores(spark, sf)).select(F.round("auc", 6).alias("auc"))


@query("m8_report", f"WITH {_CF} SELECT label, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, tp + fn AS support FROM cf")
def m8(spark, sf):
    r = M.rates(M.confusion(T.scores(spark, sf), pred(), ["label"]), ["label"])
    return r.select("label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


@query("m9_confusion", f"WITH {_CF} SELECT label, tn, fn, tp, fp FROM cf")
def m9(spark, sf):
    return M.confusion(T.scores(spark, sf), pred(), ["label"])


@query("m10_fold_means", """WITH f AS (SELECT row_id, (row_number() OVER (PARTITION BY concat_ws('', y0, y1, y2, y3, y4) ORDER BY md5(concat_ws('|', 'fold', row_id)), row_id) - 1) % 5 AS fold FROM cm)
SELECT round(avg(l), 6) AS mean_loss FROM (SELECT fold, avg(CASE WHEN (prob >= 0.5) <> (y = 1) THEN 1 ELSE 0 END) AS l FROM sc JOIN f USING (row_id) GROUP BY fold)""")
def m10(spark, sf):
    f = sampling.folds(T.customer_ml(spark, sf), T.LABELS, 5, "fold")
    by = T.scores(spark, sf).join(f, "row_id").groupBy("fold").agg(F.avg((pred() != F.col("y")).cast("int")).alias("l"))
    return by.agg(F.round(F.avg("l"), 6).alias("mean_loss"))


@query("m11_roc_auc", f"WITH {_T} SELECT label, round(sum((n - tp) / (al - p) * (ctp - tp / 2) / p), 6) AS auc FROM c GROUP BY label")
def m11(spark, sf):
    return M.roc_auc(T.scores(spark, sf), ["label"]).select("label", F.round("auc", 6).alias("auc"))


@query("m11_roc_auc_micro", f"WITH {_TM} SELECT round(sum((n - tp) / (al - p) * (ctp - tp / 2) / p), 6) AS auc FROM c")
def m11_micro(spark, sf):
    return M.roc_auc(T.scores(spark, sf), []).select(F.round("auc", 6).alias("auc"))


@query("m12_pooled_rates", f"WITH {_CF} SELECT round(sum(tp) / sum(tp + fp), 6) AS precision, round(sum(tp) / sum(tp + fn), 6) AS recall, round(sum(tp + tn) / sum(tp + tn + fp + fn), 6) AS accuracy, round(2 * sum(tp) / sum(2 * tp + fp + fn), 6) AS f1 FROM cf")
def m12(spark, sf):
    c = M.confusion(T.scores(spark, sf), pred(), ["label"]).agg(*(F.sum(k).cast("double").alias(k) for k in ("tp", "tn", "fp", "fn")))
    tp, tn, fp, fn = (F.col(k) for k in ("tp", "tn", "fp", "fn"))
    return c.select(F.round(tp / (tp + fp), 6).alias("precision"), F.round(tp / (tp + fn), 6).alias("recall"), F.round((tp + tn) / (tp + tn + fp + fn), 6).alias("accuracy"), F.round(2 * tp / (2 * tp + fp + fn), 6).alias("f1"))
