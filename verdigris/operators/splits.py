"""Threshold split searches over sorted columns: variance reduction, running means, purity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.functions.expressions import total
from verdigris.functions.prefix import before


def long_columns(df: DataFrame, group: list[str], key: str, cols: list[str], keep: list[str]) -> DataFrame:
    """group, col, key, v, kept columns: a row for each column of each row."""
    return df.select(*group, key, *keep, F.explode(F.array(*(F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols))).alias("_s")).select(*group, "_s.col", key, "_s.v", *keep)


def variance_reduction(df: DataFrame, group: list[str], key: str, cols: list[str], target: str) -> DataFrame:
    """group, col, cut, gain: the best cut v <= cut of each column by the reduction of the target's variance; both
    sides have two rows or more; ties to the least cut."""
    long = long_columns(df, group, key, cols, [target])
    by = [*group, "col"]
    # cuts fall between distinct values: rows of one value are summed first
    values = long.groupBy(*by, "v").agg(F.count("*").cast("double").alias("n"), F.sum(target).cast("double").alias("s"), F.sum(F.col(target) * F.col(target)).cast("double").alias("q"))
    whole = values.groupBy(*by).agg(*(F.sum(c).alias(f"t{c}") for c in ("n", "s", "q")))
    p = before(values, by, "v", "v", {"bn": F.col("n"), "bs": F.col("s"), "bq": F.col("q")}).join(whole, by)
    p = p.select(*by, "v", *((F.col(f"b{c}") + F.col(c)).alias(f"l{c}") for c in "nsq"), "tn", "ts", "tq").where("ln > 1 AND tn - ln > 1")
    var = lambda n, s, q: q / n - (s / n) * (s / n)
    left, right, all_ = var(F.col("ln"), F.col("ls"), F.col("lq")), var(F.col("tn") - F.col("ln"), F.col("ts") - F.col("ls"), F.col("tq") - F.col("lq")), var(F.col("tn"), F.col("ts"), F.col("tq"))
    gain = F.round(all_ - F.col("ln") / F.col("tn") * left - (1 - F.col("ln") / F.col("tn")) * right, 6)
    return p.groupBy(*by).agg(F.max(F.struct(gain.alias("gain"), (-F.col("v")).alias("m"))).alias("x")).select(*by, (-F.col("x.m")).alias("cut"), F.col("x.gain").alias("gain"))


def running_means(df: DataFrame, group: list[str], key: str, cols: list[str], legacy: bool = False) -> DataFrame:
    """group, col, cut, quality: the unsupervised cut of each column, by the means of the rows on both sides.

    A value's pull towards a mean is (distance to the other mean - distance to it) over the larger of the two. Cuts go
    after the second row to before the last but one, in the order of (value, key); the cut taken has the greatest q1,
    the pulls of the side's first and boundary rows, weighted by the sides' rows; ties to the first cut. quality is the
    mean pull of all rows to their side's mean. Columns without a cut of positive q1 (constant ones, fewer than four
    rows) are left out. legacy: the left sum lags a row and holds the second value twice, as in the original.
    """
    by = [*group, "col"]
    long = long_columns(df, group, key, cols, [])
    placed = before(long, by, "v", key, {"i": F.lit(1), "s": F.col("v")}, following="nx")
    whole = long.groupBy(*by).agg(F.count("*").alias("n"), F.sum("v").alias("t"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    p = placed.join(whole, by).where("i >= 1 AND i <= n - 3").withColumn("k", F.col("i") + 1)
    if legacy:
        second = placed.where("i = 1").select(*by, F.col("v").alias("second"))
        p = p.join(second, by).withColumn("left", F.col("s") + F.col("second"))
    else:
        p = p.withColumn("left", F.col("s") + F.col("v"))
    p = p.withColumns({"lm": F.col("left") / F.col("k"), "rm": (F.col("t") - F.col("left")) / (F.col("n") - F.col("k"))})

    def pull(x: str, near: str, far: str):
        a, b = F.abs(F.col(x) - F.col(far)), F.abs(F.col(x) - F.col(near))
        return F.coalesce(F.try_divide(a - b, F.greatest(a, b)), F.lit(0.0))

    left, right = pull("lo", "lm", "rm") + pull("v", "lm", "rm"), pull("nx", "rm", "lm") + pull("hi", "rm", "lm")
    q1 = F.round((F.col("k") * left + (F.col("n") - F.col("k")) * right) / 2 / F.col("n"), 9)
    cuts = p.select(*by, q1.alias("q1"), "k", F.col("v").alias("cut"), "lm", "rm").where("q1 > 0")
    cuts = cuts.groupBy(*by).agg(F.max(F.struct("q1", (-F.col("k")).alias("m"), "cut", "lm", "rm")).alias("x")).select(*by, "x.cut", "x.lm", "x.rm")
    own = F.when(F.col("v") <= F.col("cut"), pull("v", "lm", "rm")).otherwise(pull("v", "rm", "lm"))
    return long.join(cuts, by).groupBy(*by).agg(F.first("cut").alias("cut"), F.round(F.avg(own), 6).alias("quality"))


def purity(df: DataFrame, group: list[str], key: str, col: str, cuts: DataFrame, labels: list[str], by_size: bool = False) -> DataFrame:
    """group, cut, purity, n_left, n_right, last (the greatest row at or below the cut), symmetry (difference of the
    sides over all rows): mean over labels and sides of |zeros - ones| / (n + 1e-6) at each cut of a group; by_size
    scales it by the right side's share. cuts: group, cut; few for each group, so each row is counted once for each cut
    and summed at once."""
    j = df.join(cuts, group).withColumn("_l", F.col(col) <= F.col("cut"))
    agg = j.groupBy(*group, "cut").agg(
        F.count(F.when(F.col("_l"), 1)).alias("n_left"), F.count(F.when(~F.col("_l"), 1)).alias("n_right"),
        F.max(F.when(F.col("_l"), F.struct(F.col(col), F.col(key).alias("k")))).alias("_last"),
        *(F.count(F.when(F.col("_l") & (F.col(c) == v), 1)).cast("double").alias(f"l{v}_{c}") for c in labels for v in (0, 1)),
        *(F.count(F.when(~F.col("_l") & (F.col(c) == v), 1)).cast("double").alias(f"r{v}_{c}") for c in labels for v in (0, 1)),
    )
    side = lambda s, n, c: F.abs(F.col(f"{s}0_{c}") - F.col(f"{s}1_{c}")) / (F.col(n) + 1e-6)
    value = total([side(s, n, c) for c in labels for s, n in (("l", "n_left"), ("r", "n_right"))]) / (2.0 * len(labels))
    if by_size:
        value = value * (F.col("n_right") + 1e-6) / (F.col("n_left") + F.col("n_right") + 2e-6)
    return agg.select(*group, "cut", value.alias("purity"), "n_left", "n_right", F.col("_last.k").alias("last"), (F.abs(F.col("n_left") - F.col("n_right")) / (F.col("n_left") + F.col("n_right"))).alias("symmetry"))


def purity_at_values(df: DataFrame, group: list[str], key: str, col: str, labels: list[str]) -> DataFrame:
    """group, cut, purity at every value of the column, from prefix sums of the label counts."""
    v = df.groupBy(*group, F.col(col).alias("cut")).agg(F.count("*").cast("double").alias("n"), *(F.sum(c).cast("double").alias(c) for c in labels))
    whole = v.groupBy(*group).agg(F.sum("n").alias("t_n"), *(F.sum(c).alias(f"t_{c}") for c in labels))
    p = before(v, group, "cut", "cut", {f"b_{c}": F.col(c) for c in ("n", *labels)}).join(whole, group)
    left, right = (lambda c: F.col(f"b_{c}") + F.col(c)), (lambda c: F.col(f"t_{c}") - F.col(f"b_{c}") - F.col(c))
    side = lambda f, c: F.abs(f("n") - 2 * f(c)) / (f("n") + 1e-6)
    return p.select(*group, "cut", (total([side(f, c) for c in labels for f in (left, right)]) / (2.0 * len(labels))).alias("purity"))


def equal_width_cuts(df: DataFrame, group: list[str], col: str, steps: int = 20) -> DataFrame:
    """group, cut: least value + i * width / steps for i = 1 .. steps - 1."""
    r = df.groupBy(*group).agg(F.min(col).alias("lo"), F.max(col).alias("hi"))
    return r.select(*group, F.explode(F.sequence(F.lit(1), F.lit(steps - 1))).alias("i"), "lo", "hi").select(*group, (F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / float(steps)).alias("cut"))


def rank_step_cuts(df: DataFrame, group: list[str], key: str, col: str, steps: int = 10) -> DataFrame:
    """group, cut: the values of the sorted column at ranks 0, s, 2 s, .. with s = floor(rows / steps), 1 at least."""
    n = df.groupBy(*group).agg(F.count("*").alias("n"))
    placed = before(df.select(*group, key, col), group, col, key, {"k": F.lit(1)}).join(n, group)
    step = F.greatest(F.floor(F.col("n") / steps), F.lit(1))
    return placed.where(F.col("k") % step == 0).select(*group, F.col(col).alias("cut")).distinct()


def best(cuts: DataFrame, group: list[str], by: str, later: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """The cut with the largest value of ``by`` (6 digits) in each group, and its columns in keep; ties to the least cut,
    or to the greatest with later."""
    place = F.col("cut") if later else -F.col("cut")
    x = cuts.groupBy(*group).agg(F.max(F.struct(F.round(by, 6).alias("b"), place.alias("m"), "cut", *keep)).alias("x"))
    return x.select(*group, "x.cut", F.col("x.b").alias(by), *(f"x.{c}" for c in keep))
