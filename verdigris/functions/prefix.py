"""Sums over all smaller values of a group, in two levels.

A window over a whole group sorts the group in one task. Here values fall into bins between quantiles of their group,
so that a long tail doesn't leave most rows in one; rows of one value share a bin. Approximate quantiles depend on the order in which
parts arrive, so they are computed once, and rows and sums use the same ones. Sums of the bins are accumulated over bins (groups x bins rows), rows within a bin by a window of the bin alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.sources.shared import cut

BINS = 512


def _binned(df: DataFrame, group: list[str], x: str, bins: int, at: Column | None = None) -> DataFrame:
    """df and _bin: bins of about as many rows of each group, by approximate quantiles of x (equal ones are one bound), or by at."""
    if at is not None:
        return df.withColumn("_bin", at)
    depth = max(1, (bins - 1).bit_length())
    share = [i / (1 << depth) for i in range(1, 1 << depth)]
    bounds = cut(df.groupBy(*group).agg(F.percentile_approx(F.col(x).cast("double"), share, 4 * bins).alias("_bounds")))
    # how many bounds are below x, bit by bit
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(depth))))
    at = F.aggregate(steps, F.lit(0), lambda s, k: s + F.when(F.element_at("_bounds", s + k) < F.col(x), k).otherwise(0))
    return df.join(bounds, group).withColumn("_bin", at).drop("_bounds")


def before(df: DataFrame, group: list[str], x: str, key: str, sums: dict[str, Column], bins: int = BINS, following: str | None = None, at: Column | None = None) -> DataFrame:
    """df and, for each of sums, its sum over the rows of the group that come earlier by (x, key); 0 for none.
    following: the name of one more column, the x of the next row; null for the last. at: the bin of a row, where one is known
    that never falls as x grows."""
    rows = _binned(df, group, x, bins, at).withColumns({f"_{k}": v for k, v in sums.items()})
    by_bin = Window.partitionBy(*group).orderBy("_bin")
    earlier = by_bin.rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy(*group, "_bin").agg(*(F.sum(f"_{k}").alias(f"_t{k}") for k in sums), F.min(x).alias("_least"))
    whole = whole.select(*group, "_bin", *(F.coalesce(F.sum(f"_t{k}").over(earlier), F.lit(0)).alias(f"_b{k}") for k in sums), *([F.lead("_least").over(by_bin).alias("_later")] if following else []))
    order = Window.partitionBy(*group, "_bin").orderBy(x, key)
    within = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_w{k}": F.coalesce(F.sum(f"_{k}").over(within), F.lit(0)) for k in sums})
    if following:
        rows = rows.withColumn("_lead", F.lead(x).over(order))
    out = rows.join(whole, [*group, "_bin"]).withColumns({k: F.col(f"_b{k}") + F.col(f"_w{k}") for k in sums})
    if following:
        out = out.withColumn(following, F.coalesce("_lead", "_later"))
    return out.select(*df.columns, *sums, *([following] if following else []))


def runs(df: DataFrame, group: list[str], x: str, key: str, flag: str, bins: int = BINS) -> DataFrame:
    """df, island, prev, next: the number (from 0) of the maximal run of equal flags along (x, key) that a row is in,
    and the x of its neighbours, null at the ends. flag has no nulls. In two levels, as above: changes within a bin are
    counted there, those between bins from the first and last flag of each."""
    order, by_bin = Window.partitionBy(*group, "_bin").orderBy(x, key), Window.partitionBy(*group).orderBy("_bin")
    new = F.coalesce((F.col(flag) != F.lag(flag).over(order)).cast("int"), F.lit(0))
    rows = _binned(df, group, x, bins).withColumns({"_new": new, "_p": F.lag(x).over(order), "_q": F.lead(x).over(order)})
    rows = rows.withColumn("_inner", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(x, key)
    whole = rows.groupBy(*group, "_bin").agg(F.sum("_new").alias("_n"), F.min_by(flag, at).alias("_first"), F.max_by(flag, at).alias("_last"), F.min(x).alias("_least"), F.max(x).alias("_most"))
    whole = whole.withColumn("_turn", F.coalesce((F.col("_first") != F.lag("_last").over(by_bin)).cast("int"), F.lit(0)))
    so_far = F.sum(F.col("_n") + F.col("_turn")).over(by_bin.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    whole = whole.select(*group, "_bin", so_far.alias("_so_far"), F.lag("_most").over(by_bin).alias("_bp"), F.lead("_least").over(by_bin).alias("_bq"))
    out = rows.join(whole, [*group, "_bin"])
    return out.select(*df.columns, (F.col("_so_far") + F.col("_inner")).cast("int").alias("island"), F.coalesce("_p", "_bp").alias("prev"), F.coalesce("_q", "_bq").alias("next"))
