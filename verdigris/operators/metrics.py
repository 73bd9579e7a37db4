"""Multi-label ranking and classification metrics over rows (row_id, label, y, prob)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.prefix import before


def thresholds(df: DataFrame, group: list[str]) -> DataFrame:
    """group, prob, tp, n, and their sums down to each distinct score (ctp, cn) and over all (p, all): a row for each
    distinct score, accumulated in two levels."""
    own = group or ["_all"]
    df = df if group else df.withColumn("_all", F.lit(0))
    g = df.groupBy(*own, "prob").agg(F.sum("y").cast("double").alias("tp"), F.count("*").cast("double").alias("n")).withColumn("_x", -F.col("prob"))
    c = before(g, own, "_x", "prob", {"btp": F.col("tp"), "bn": F.col("n")})
    whole = g.groupBy(*own).agg(F.sum("tp").alias("p"), F.sum("n").alias("all"))
    return c.join(whole, own).select(*group, "prob", "tp", "n", (F.col("btp") + F.col("tp")).alias("ctp"), (F.col("bn") + F.col("n")).alias("cn"), "p", "all")


def average_precision(df: DataFrame, group: list[str]) -> DataFrame:
    """group, ap: sum over score thresholds of the recall gained times the precision there; 0 without positives."""
    t = thresholds(df, group)
    return t.groupBy(*group).agg(F.coalesce(F.sum(F.try_divide(F.col("tp"), F.col("p")) * F.col("ctp") / F.col("cn")), F.lit(0.0)).alias("ap"))


def precision_recall(df: DataFrame, group: list[str]) -> DataFrame:
    t = thresholds(df, group)
    return t.select(*group, "prob", (F.col("ctp") / F.col("cn")).alias("precision"), F.coalesce(F.try_divide(F.col("ctp"), F.col("p")), F.lit(0.0)).alias("recall"))


def roc_auc(df: DataFrame, group: list[str]) -> DataFrame:
    """group, auc: trapezoids over score thresholds, from (0, 0); null if one class is missing."""
    t = thresholds(df, group)
    fp, neg = F.col("n") - F.col("tp"), F.col("all") - F.col("p")
    return t.groupBy(*group).agg(F.sum(F.try_divide(fp, neg) * F.try_divide(F.col("ctp") - F.col("tp") / 2, F.col("p"))).alias("auc"))


def label_ranking_precision(df: DataFrame) -> DataFrame:
    """lrap: mean over rows of the mean, over true labels, of the share of true labels among those scored as high."""
    a = df.groupBy("row_id").agg(F.collect_list(F.struct("y", "prob")).alias("l"))  # the labels of one row
    true = F.filter("l", lambda x: x["y"] == 1)
    each = F.transform(true, lambda t: F.size(F.filter(true, lambda x: x["prob"] >= t["prob"])) / F.size(F.filter("l", lambda x: x["prob"] >= t["prob"])))
    score = F.when((F.size(true) == 0) | (F.size(true) == F.size("l")), 1.0).otherwise(F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(true))
    return a.agg(F.avg(score).alias("lrap"))


def subset_accuracy(df: DataFrame, pred: Column) -> DataFrame:
    return df.groupBy("row_id").agg(F.min((pred == F.col("y")).cast("int")).alias("ok")).agg(F.avg("ok").alias("accuracy"))


def hamming_loss(df: DataFrame, pred: Column) -> DataFrame:
    return df.agg(F.avg((pred != F.col("y")).cast("int")).alias("loss"))


def rank_auc(df: DataFrame) -> DataFrame:
    """auc: each row's k best labels count as positive, k = 1 ..; rates pooled over rows, trapezoids from k = 1."""
    r = df.withColumn("k", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("prob"), "label")))
    by = r.groupBy("k").agg(F.sum("y").cast("double").alias("tp"), F.sum(1 - F.col("y")).cast("double").alias("fp"))  # a row for each label
    w, every = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    c = by.select("k", (F.sum("tp").over(w) / F.sum("tp").over(every)).alias("tpr"), (F.sum("fp").over(w) / F.sum("fp").over(every)).alias("fpr"))
    o = Window.orderBy("k")
    return c.withColumn("area", (F.col("fpr") - F.lag("fpr").over(o)) * (F.col("tpr") + F.lag("tpr").over(o)) / 2).agg(F.sum("area").alias("auc"))


def confusion(df: DataFrame, pred: Column, group: list[str]) -> DataFrame:
    n = lambda p, y: F.count(F.when((pred == p) & (F.col("y") == y), 1))
    return df.groupBy(*group).agg(n(0, 0).alias("tn"), n(0, 1).alias("fn"), n(1, 1).alias("tp"), n(1, 0).alias("fp"))


def rates(c: DataFrame, group: list[str]) -> DataFrame:
    """group, precision, recall, f1, support from counts; 0 where a rate is undefined."""
    z = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(*group, z(tp, tp + fp).alias("precision"), z(tp, tp + fn).alias("recall"), z(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def write_report(df: DataFrame, pred: Column, path: str) -> None:
    """The report as JSON lines: a row for each label."""
    rates(confusion(df, pred, ["label"]), ["label"]).coalesce(1).write.mode("errorifexists").json(path)
