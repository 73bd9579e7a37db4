"""Projections, encodings, masks, set operations and plain aggregates over feature and label tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from verdigris.sources.shared import cut
from pyspark.sql.types import NumericType, StringType

from verdigris.functions.prefix import before


def features(df: DataFrame, labels: list[str]) -> DataFrame:
    """All columns but the labels, in order."""
    return df.select(*[c for c in df.columns if c not in labels])


def downcast(df: DataFrame, labels: list[str], numeric: list[str]) -> DataFrame:
    return df.withColumns({**{c: F.col(c).cast("byte") for c in labels}, **{c: F.col(c).cast("float") for c in numeric}})


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, StringType)]


def categorical_positions(df: DataFrame, wanted: list[str | int]) -> list[int]:
    """Places within ``wanted`` (names, or positions in df) of the categorical columns."""
    kinds = set(categorical_columns(df))
    return [i for i, c in enumerate(wanted) if (df.columns[c] if isinstance(c, int) else c) in kinds]


def distinct_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """col, n_distinct: exact, one pass; each column is grouped on its own values, so no distinct set meets in one task."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("string").alias("v")) for c in cols))).alias("x")).select("x.col", "x.v")
    return long.where("v IS NOT NULL").distinct().groupBy("col").agg(F.count("*").alias("n_distinct"))


def low_cardinality_to_string(df: DataFrame, cols: list[str], below: int) -> DataFrame:
    """Numeric columns with fewer than ``below`` distinct values become strings (a categorical feature)."""
    few = {r["col"] for r in distinct_counts(df, cols).where(F.col("n_distinct") < below).collect()}  # a row for each column at most
    return df.withColumns({c: F.col(c).cast("string") for c in cols if c in few})


def encoding(df: DataFrame, col: str) -> DataFrame:
    """value, code: the column's categories in order, from 0. Codes come from the distinct values, not the rows: these are range
    partitioned, numbered within their partition, and moved on by the sizes of the partitions before it."""
    values = df.select(F.col(col).alias("value")).where("value IS NOT NULL").distinct()
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an id is the partition's number and, in its lower 33 bits, the row's
    placed = cut(values.repartitionByRange(n, "value").sortWithinPartitions("value").select("value", F.monotonically_increasing_id().alias("_i")))
    placed = placed.select("value", F.shiftright("_i", 33).alias("_p"), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)).alias("_r"))
    size = placed.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each partition
    so_far = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(F.broadcast(size.select("_p", so_far.alias("_o"))), "_p").select("value", (F.col("_o") + F.col("_r")).cast("float").alias("code"))


def encode(df: DataFrame, col: str, codes: DataFrame) -> DataFrame:
    """The column as its code; a value that the encoding does not know is null."""
    return df.join(codes.withColumnRenamed("value", "_v"), F.col(col) == F.col("_v"), "left").drop(col, "_v").withColumnRenamed("code", col)


def mask(df: DataFrame, labels: list[str], unlabelled: Column) -> DataFrame:
    """Labels of the rows that the condition names become -1."""
    return df.withColumns({c: F.when(unlabelled, F.lit(-1)).otherwise(F.col(c)) for c in labels})


def supervised(df: DataFrame, first_label: str) -> DataFrame:
    return df.where(F.col(first_label) != -1)


def varying_columns(df: DataFrame, group: list[str], cols: list[str]) -> DataFrame:
    """group, col: the columns with more than one value in the group; least and greatest tell, nothing is made distinct."""
    agg = df.groupBy(*group).agg(*(F.coalesce(F.max(c) > F.min(c), F.lit(False)).alias(c) for c in cols))
    long = agg.select(*group, F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).alias("varies")) for c in cols))).alias("x"))
    return long.where("x.varies").select(*group, "x.col")


def one_hot(df: DataFrame, col: str, key: str) -> DataFrame:
    """key and label_0.. for each value of the column, in the order of the value's first row."""
    order = [r[0] for r in df.groupBy(col).agg(F.min(key).alias("m")).orderBy("m").select(col).collect()]  # the classes
    return df.select(key, *((F.col(col) == v).cast("int").alias(f"label_{i}") for i, v in enumerate(order)))


def min_max(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    span = df.agg(*(F.min(c).alias(f"min_{c}") for c in cols), *(F.max(c).alias(f"max_{c}") for c in cols))
    out = df.join(F.broadcast(span))  # one row
    return out.select(key, *(F.try_divide(F.col(c) - F.col(f"min_{c}"), F.col(f"max_{c}") - F.col(f"min_{c}")).alias(c) for c in cols))


def positive_rates(df: DataFrame, labels: list[str]) -> DataFrame:
    """label, rate among rows that have it, n of those rows."""
    parts = F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(c).alias("y")) for i, c in enumerate(labels)))).alias("x")
    return df.select(parts).select("x.*").groupBy("label").agg(F.avg(F.when(F.col("y") >= 0, F.col("y"))).alias("rate"), F.count(F.when(F.col("y") >= 0, 1)).alias("n"))


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, r for each pair of columns: from moments, in one aggregation; null where a column is constant."""
    n = F.count("*").cast("double")
    moments = df.agg(n.alias("n"), *(F.avg(c).alias(f"m_{c}") for c in cols))
    centred = df.join(F.broadcast(moments)).select(*((F.col(c) - F.col(f"m_{c}")).alias(c) for c in cols))  # one row
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    agg = centred.agg(*(F.sum(F.col(c) * F.col(c)).alias(f"v_{c}") for c in cols), *(F.sum(F.col(a) * F.col(b)).alias(f"c_{a}_{b}") for a, b in pairs))
    rows = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.try_divide(F.col(f"c_{a}_{b}"), F.sqrt(F.col(f"v_{a}")) * F.sqrt(F.col(f"v_{b}"))).alias("r")) for a, b in pairs))).alias("x")
    return agg.select(rows).select("x.*")


def average_ranks(df: DataFrame, cols: list[str], key: str) -> DataFrame:
    """key and each column's rank (of its value as a double), ties at their average: ranks come from the distinct values'
    counts, summed in two levels, for all columns at once. A null has no rank; a null key is a row of its own kind."""
    long = df.select(F.col(key).alias("_k"), F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols))).alias("_s")).select("_k", "_s.*")
    counts = long.where("v IS NOT NULL").groupBy("col", "v").agg(F.count("*").alias("n"))
    ranks = before(counts, ["col"], "v", "v", {"below": F.col("n")}).select("col", "v", (F.col("below") + (F.col("n") + 1) / 2.0).alias("r"))
    each = long.join(ranks, ["col", "v"], "left")
    return each.groupBy("_k").agg(*(F.max(F.when(F.col("col") == c, F.col("r"))).alias(c) for c in cols)).withColumnRenamed("_k", key)
