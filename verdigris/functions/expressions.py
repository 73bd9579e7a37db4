"""Column expressions that several operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def r6(c: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(c, digits) + F.lit(0.0)


def gower(a: str, b: str, ranges: str, numeric: list[str], categorical: list[str], legacy_bias: bool = False, width: int | None = None) -> Column:
    """Mixed distance of rows a and b: range-scaled differences and mismatches, averaged over the columns.

    ranges: alias of a row with min_<col> and max_<col>. legacy_bias adds 1/n where no column is categorical.
    width: the number of columns that count, where others are the same in all rows.
    """
    n = width or len(numeric) + len(categorical)
    parts = [F.abs(F.col(f"{a}.{c}") - F.col(f"{b}.{c}")) / (F.col(f"{ranges}.max_{c}") - F.col(f"{ranges}.min_{c}") + 1e-12) for c in numeric]
    parts += [(~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))).cast("double") for c in categorical]
    return (total(parts) + F.lit(1.0 if legacy_bias and not categorical else 0.0)) / F.lit(float(n))


def max_scaled(a: str, b: str, ranges: str, numeric: list[str], categorical: list[str]) -> Column:
    """The array variant: values over the column's max, range abs(1 - min / max); a column with max 0 is ignored."""
    parts = []
    for c in numeric:
        lo, hi = F.col(f"{ranges}.min_{c}"), F.col(f"{ranges}.max_{c}")
        scale = F.abs(F.lit(1.0) - F.try_divide(lo, hi))
        d = F.try_divide(F.abs(F.try_divide(F.col(f"{a}.{c}"), hi) - F.try_divide(F.col(f"{b}.{c}"), hi)), scale)
        parts.append(F.when(hi == 0, 0.0).otherwise(F.coalesce(d, F.lit(0.0))))
    parts += [(~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))).cast("double") for c in categorical]
    return total(parts) / F.lit(float(len(parts)))


def euclidean(a: str, b: str, cols: list[str]) -> Column:
    return F.sqrt(total([F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), F.lit(2.0)) for c in cols]))


def dot(a: str, b: str, cols: list[str]) -> Column:
    return total([(F.col(f"{a}.{c}") * F.col(f"{b}.{c}")).cast("double") for c in cols])


def cosine(a: str, b: str, cols: list[str]) -> Column:
    """1 - cosine; 1 where a vector is zero."""
    return F.lit(1.0) - F.coalesce(F.try_divide(dot(a, b, cols), F.sqrt(dot(a, a, cols)) * F.sqrt(dot(b, b, cols))), F.lit(0.0))


def rbf(a: str, b: str, cols: list[str], gamma: float) -> Column:
    return F.exp(F.lit(-gamma) * total([F.pow(F.col(f"{a}.{c}") - F.col(f"{b}.{c}"), F.lit(2.0)) for c in cols]))


METRICS = {"euclidean": lambda a, b, r, num, cat: euclidean(a, b, num), "gower": gower, "cosine": lambda a, b, r, num, cat: cosine(a, b, num)}


def metric(name: str):
    """The expression builder of a metric; an unknown name is an error."""
    return METRICS[name]


def draw(seed: str, *cols: str) -> Column:
    """A deterministic random order: md5 hex of the seed and the columns."""
    return F.md5(F.concat_ws("|", F.lit(seed), *cols).cast("binary"))


def weights(p: list[float]) -> list[float]:
    """Weights over their sum."""
    return [x / sum(p) for x in p]
