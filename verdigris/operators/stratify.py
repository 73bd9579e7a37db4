"""Iterative stratification of multi-label rows into parts of given shares.

Label by label, the one with the fewest open rows first: its rows go to the parts that still want most of that label, and what
they hold of other labels is taken off what the parts want of those. What a part is given of a label follows from what
it wants and the number of open rows alone, so a round needs counts by label set only; within a round the parts take turns in proportion, so
every label set is spread over them. Rows are dealt once at the end, by their place in their set.

The state is the table of open label sets with their counts, distributed; to the driver come a number for each label, and for each part
and label. There is a round for each label.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.prefix import before
from verdigris.operators.sampling import _first
from verdigris.sources.shared import cut


def quotas(wanted: list[float], rows: int, total: list[float]) -> list[int]:
    """How many of rows each part gets, each row going to the part that wants most then; ties to the one that wants most rows in
    all, then to the first."""
    order = sorted(range(len(wanted)), key=lambda m: -wanted[m])
    level = 0.0
    for k in range(1, len(order) + 1):  # the level to which the first k parts sink
        level = (sum(wanted[m] for m in order[:k]) - rows) / k
        if k == len(order) or level >= wanted[order[k]]:
            break
    got = [max(0, int(w - level - 1e-9)) for w in wanted]
    while sum(got) < rows:
        m = max(range(len(wanted)), key=lambda m: (round(wanted[m] - got[m], 9), round(total[m] - got[m], 9), -m))
        got[m] += 1
    return got


def _share(start: Column, n: Column, quota: list[int]) -> list[Column]:
    """How many of the places start .. start + n - 1 each part gets."""
    end, left, out = start + n, sum(quota), []
    for q in quota[:-1]:
        upto = lambda p, q=q, left=left: F.floor(p * q / F.lit(left)) if left else F.lit(0)
        out.append(upto(end) - upto(start))
        start, end, left = start - upto(start), end - upto(end), left - q
    return [*out, end - start]


def parts(df: DataFrame, labels: list[str], shares: list[float], seed: str, key: str = "row_id") -> DataFrame:
    """key, part (0 ..) of each row: the labels' rows and all rows in the given shares, as near as whole rows allow.

    A label is positive where it is 1. Rows without labels come last and fill up the parts. Repeated keys are different
    rows. An empty table gives no rows.
    """
    named = df.select(key, F.concat_ws("", *((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int") for c in labels)).alias("set"))
    sets = cut(named.groupBy("set").agg(F.count("*").alias("n")))
    has = lambda i: F.substring("set", i + 1, 1) == "1"
    counts = lambda t: t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), *(F.coalesce(F.sum(F.when(has(i), F.col("n"))), F.lit(0)).alias(f"l{i}") for i in range(len(labels)))).first()
    first = counts(sets)
    if not first["all"]:
        return named.select(key, F.lit(0).alias("part"))
    wanted = {i: [s * first[f"l{i}"] for s in shares] for i in range(len(labels))}
    total = [s * first["all"] for s in shares]
    open_, dealt = sets, []
    while True:
        now = counts(open_)
        left = [(now[f"l{i}"], i) for i in range(len(labels)) if now[f"l{i}"]]
        if not now["all"]:
            break
        rows, label = min(left) if left else (now["all"], None)
        quota = quotas(wanted[label] if left else total, rows, total)
        own = open_.where(has(label)) if left else open_
        # sets that share labels stand side by side; the places of a set follow from the rows of those before it
        own = own.withColumn("_x", F.conv(F.substring("set", 1, 52), 2, 10).cast("double"))
        placed = cut(before(own.withColumn("_g", F.lit(0)), ["_g"], "_x", "set", {"start": F.col("n")}).drop("_x", "_g"))
        dealt.append(placed.select("set", "start", F.array(*(F.lit(q).cast("long") for q in quota)).alias("quota")))
        share = _share(F.col("start"), F.col("n"), quota)
        took = placed.agg(*(F.sum(s).alias(f"t{m}") for m, s in enumerate(share)), *(F.coalesce(F.sum(F.when(has(i), s)), F.lit(0)).alias(f"t{m}_{i}") for m, s in enumerate(share) for i in range(len(labels)))).first()
        for m in range(len(shares)):
            total[m] -= took[f"t{m}"]
            for i in range(len(labels)):
                wanted[i][m] -= took[f"t{m}_{i}"]
        if not left:
            break
        open_ = cut(open_.where(~has(label)))
    # a set is dealt in one round; its rows take its places in the order of their hash
    known = cut(reduce(DataFrame.unionAll, dealt))
    rows = _first(named, ["set"], key, seed, []).join(known, "set").withColumn("place", F.col("start") + F.col("r") - 1)
    k = len(shares)
    part, left, place = F.lit(k - 1), F.aggregate("quota", F.lit(0).cast("long"), lambda s, q: s + q), F.col("place")
    took = []
    for m in range(k - 1):
        q = F.element_at("quota", m + 1)
        upto = F.coalesce(F.floor(F.try_divide(place * q, left)), F.lit(0))
        took.append(F.coalesce(F.floor(F.try_divide((place + 1) * q, left)), F.lit(0)) > upto)
        place, left = place - upto, left - q
    for m in reversed(range(k - 1)):
        part = F.when(took[m], m).otherwise(part)
    return rows.select(key, part.cast("int").alias("part"))
