"""The nearest-member index against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import nearest as N


def brute(members, queries, spans, digits=None):
    """(key, group) to (distance, nearest); rows are (key, group, numbers, categories)."""
    out = {}
    for k, g, x, c in queries:
        best = None
        for m, h, y, e in members:
            if h == g:
                d = 0.0
                for a, b, s in zip(x, y, spans[g], strict=True):
                    d += abs(a - b) / s
                for a, b in zip(c, e, strict=True):
                    d += a != b
                d = d if digits is None else round(d, digits)
                best = min(best, (d, m)) if best else (d, m)
        if best:
            out[k, g] = best
    return out


def invented(rng, n, groups, tied):
    number = (lambda: float(rng.randrange(4))) if tied else (lambda: rng.lognormvariate(0, 2))
    return [(i, rng.choice(groups), [number(), number()], [rng.choice(["a", "b", None, "c"])]) for i in range(n)]


@pytest.mark.parametrize(("shard", "leaf", "queries", "tied"), [(65_536, 32, 262_144, False), (40, 4, 25, False), (40, 4, 25, True), (7, 1, 5, True)])
def test_against_all_pairs(spark, monkeypatch, shard, leaf, queries, tied):
    for name, v in (("SHARD", shard), ("LEAF", leaf), ("QUERIES", queries)):
        monkeypatch.setattr(N, name, v)
    rng = random.Random(shard)
    members, asked = invented(rng, 300, [1, 1, 1, 2, 3], tied), invented(rng, 120, [1, 1, 2, 3, 4], tied)
    frame = lambda rows: spark.createDataFrame([(k, g, *x, *c) for k, g, x, c in rows], "k long, g long, x1 double, x2 double, c1 string")
    got = N.nearest(frame(members), frame(asked), ["g"], "k", ["x1", "x2"], ["c1"], digits=9).collect()
    every = members + asked
    spans = {g: [max(r[2][i] for r in every if r[1] == g) - min(r[2][i] for r in every if r[1] == g) + 1e-12 for i in (0, 1)] for g in (1, 2, 3, 4)}
    want = brute(members, asked, spans, 9)
    assert {(r.k, r.g): r.nearest for r in got} == {k: m for k, (_, m) in want.items()}
    assert all(abs(r.d - want[r.k, r.g][0]) < 1e-8 for r in got)


def test_only_numbers_or_only_categories(spark):
    rows = [(f"k{i}", i % 3, float(i % 5), "xy"[i % 2]) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, g int, x double, c string")
    asked = df.withColumn("k", F.concat(F.lit("q"), "k"))
    for num, cat, at in ((["x"], [], 2), ([], ["c"], 3)):
        got = {r.k: (r.nearest, r.d) for r in N.nearest(df, asked, ["g"], "k", num, cat).collect()}
        assert got == {"q" + r[0]: (min(m[0] for m in rows if m[1] == r[1] and m[at] == r[at]), 0.0) for r in rows}
    assert N.nearest(df.limit(0), asked, ["g"], "k", ["x"], ["c"]).count() == 0 == N.nearest(df, asked.limit(0), ["g"], "k", ["x"], ["c"]).count()


def test_few_members_are_looked_at():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(6000, 3)), rng.normal(size=(500, 3))
    c = [[v] for v in rng.integers(0, 25, 6000).astype(str)]
    span = np.ptp(x, axis=0)
    place, d, looked = N.Index(list(range(6000)), x, c, span).search(q, [[v] for v in rng.integers(0, 25, 500).astype(str)], np.full(500, np.inf), None)
    assert (place >= 0).all() and looked.mean() < 0.05 * 6000


def test_queries_on_the_index(spark):
    """The nearest-row searches look at under 5 % of all pairs on the larger table."""
    from verdigris.sources import tables as T

    df = T.customer_ml(spark, "/root/testdata/sf0.1").select("row_id", "node", "sup", *T.NUMERIC, *T.CATEGORICAL)
    found = N.nearest(df.where("sup"), df.where("NOT sup"), ["node"], "row_id", T.NUMERIC, T.CATEGORICAL).agg(F.sum("looked").alias("n"), F.count("*").alias("q")).first()
    per = df.where("sup").groupBy("node").count().agg(F.avg("count")).first()[0]
    assert found.q == df.where("NOT sup").count() and found.n < 0.05 * found.q * per, found.n / (found.q * per)


def test_equal_members_are_looked_at_once():
    """Copies of a member don't make its leaves more, and a bound of 0 doesn't ask them all."""
    rng = np.random.default_rng(2)
    x = np.repeat(rng.normal(size=(30, 3)), 200, axis=0)
    c = [["a"]] * len(x)
    order = rng.permutation(len(x))
    place, d, looked = N.Index(order.tolist(), x, c, np.ptp(x, axis=0)).search(x[::50], c[::50], np.full(120, np.inf), 9)
    assert (d == 0).all() and looked.mean() <= 32


def test_other_shards_follow_from_boxes(spark, monkeypatch):
    """Every other shard is told by one look at the group's boxes, not by a walk down a tree of them: no plan for a level."""
    monkeypatch.setattr(N, "SHARD", 10)
    cuts = []
    monkeypatch.setattr(N, "cut", lambda df, own=N.cut: cuts.append(1) or own(df))
    rows = [(i, float(i % 97), float(i % 89), "ab"[i % 2]) for i in range(2_000)]
    df = spark.createDataFrame(rows, "k long, x1 double, x2 double, c string")
    df = df.withColumn("g", F.lit(1))
    got = N.nearest(df.where("k % 3 = 0"), df.where("k % 3 = 1"), ["g"], "k", ["x1", "x2"], ["c"])
    members, asked = [r for r in rows if r[0] % 3 == 0], [r for r in rows if r[0] % 3 == 1]
    found = {r.k: r.d for r in got.collect()}
    for q in asked:
        least = min(abs(q[1] - m[1]) / (96 + 1e-12) + abs(q[2] - m[2]) / (88 + 1e-12) + (q[3] != m[3]) for m in members)
        assert abs(found[q[0]] - least) < 1e-9
    assert len(cuts) <= 20
