"""Deterministic samples: a hash of the seed and the key takes the place of a random order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.functions.expressions import draw


def column_draws(spark: SparkSession, cols: list[str], n_attr: int, iterations: int, seed: str, linear: bool = False) -> DataFrame:
    """iter, col: for each iteration a sample of ceil(min(columns, log2 n_attr)) columns, or n_attr if linear."""
    k = math.ceil(min(len(cols), n_attr if linear else int(math.log2(n_attr))))
    rows = spark.range(iterations).select(F.col("id").alias("iter"), F.explode(F.array(*map(F.lit, cols))).alias("col"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("iter").orderBy(draw(seed, "iter", "col"), "col")))
    return ranked.where(F.col("r") <= k).select("iter", "col")


def group_column_draws(columns: DataFrame, group: list[str], n_attr: int, iterations: int, seed: str, linear: bool = False) -> DataFrame:
    """group, iter, col: the same sample for each group of columns (group, col), of the columns that it has."""
    rows = columns.select(*group, F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))).alias("iter"), "col")
    own = Window.partitionBy(*group, "iter")  # the columns of a table
    ranked = rows.withColumns({"r": F.row_number().over(own.orderBy(draw(seed, *group, "iter", "col"), "col")), "n": F.count("*").over(own)})
    return ranked.where(F.col("r") <= F.ceil(F.least(F.col("n"), F.lit(n_attr if linear else int(math.log2(n_attr)))))).select(*group, "iter", "col")


def _first(df: DataFrame, stratum: list[str], key: str, seed: str | Column, tag: list) -> DataFrame:
    """df with r: the row's place in its stratum by hash, counted in two levels so that no stratum is sorted in one task."""
    from verdigris.functions.prefix import BINS, before

    seed = seed if isinstance(seed, Column) else F.lit(seed)
    out = df.withColumn("_h", F.md5(F.concat_ws("|", seed, *tag, key).cast("binary"))).withColumn("_x", F.conv(F.substring("_h", 1, 12), 16, 10).cast("double"))
    out = out.withColumn("_k", F.concat_ws("|", "_h", F.lpad(F.col(key).cast("string"), 20, "0")))
    even = F.floor(F.col("_x") / float(1 << 48) * BINS)  # hashes are spread evenly
    return before(out, stratum, "_x", "_k", {"r": F.lit(1)}, at=even).withColumn("r", F.col("r") + 1).drop("_h", "_x", "_k")


def inverse_frequency_bags(rows: DataFrame, labels: list[str], share: float, key: str = "row_id") -> DataFrame:
    """tree, key: the rows of each tree's bag, all in one plan: of each label's positives the more the rarer it is, of labelled and
    unlabelled rows a share. rows: a row for each tree that may draw it, with tree and the tree's seed."""
    long = rows.select("tree", "seed", key, F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(c).alias("y")) for i, c in enumerate(labels)))).alias("s")).select("tree", "seed", key, "s.*").where("y = 1")
    any_positive = sum((F.col(c) for c in labels[1:]), F.col(labels[0])) > 0
    total = rows.groupBy("tree").agg(F.count("*").alias("n"), F.count(F.when(any_positive, 1)).alias("pos"))
    quota = long.groupBy("tree", "label").agg(F.count("*").alias("nc")).join(total, "tree")
    quota = quota.select("tree", "label", F.floor(F.least(F.floor((1 - F.col("nc") / F.col("pos")) * F.col("n")), F.col("nc")) * share + 1e-9).alias("k"))
    positive = _first(long, ["tree", "label"], key, F.col("seed"), ["label"]).join(F.broadcast(quota), ["tree", "label"]).where("r <= k").select("tree", key)  # a row for each tree and label
    kind = F.when(F.col(labels[0]) >= 0, "sup").otherwise("unsup")
    rest = rows.select("tree", "seed", key, kind.alias("kind"))
    size = rest.groupBy("tree", "kind").agg(F.floor(F.count("*") * share + 1e-9).alias("k"))
    rest = _first(rest, ["tree", "kind"], key, F.col("seed"), ["kind"]).join(F.broadcast(size), ["tree", "kind"]).where("r <= k").select("tree", key)  # two rows for each tree
    return positive.unionAll(rest).distinct()


def inverse_frequency_bag(df: DataFrame, labels: list[str], share: float, seed: str, key: str = "row_id") -> DataFrame:
    """The rows of one such bag."""
    return inverse_frequency_bags(df.select(key, *labels, F.lit(0).alias("tree"), F.lit(seed).alias("seed")), labels, share, key).select(key)


def hold_out(df: DataFrame, labels: list[str], share: float, seed: str, key: str = "row_id") -> DataFrame:
    """key, part: of each label set the share that is hashed least is the test part (quotas; not iterative stratification)."""
    rows = df.select(key, F.concat_ws("", *labels).alias("set"))
    size = rows.groupBy("set").agg(F.floor(F.count("*") * share).alias("k"))
    return _first(rows, ["set"], key, seed, []).join(size, "set").select(key, F.when(F.col("r") <= F.col("k"), "test").otherwise("train").alias("part"))


def folds(df: DataFrame, labels: list[str], k: int, seed: str, key: str = "row_id") -> DataFrame:
    """key, fold: label sets are dealt over the folds in turn."""
    rows = df.select(key, F.concat_ws("", *labels).alias("set"))
    return _first(rows, ["set"], key, seed, []).select(key, ((F.col("r") - 1) % k).cast("int").alias("fold"))
