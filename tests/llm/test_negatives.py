import math
import random

import duckdb
import numpy as np
import pytest
from verdigris.llm import negatives as N
from pyspark.sql import functions as F


def brute(rows, anchors=50, k=5, m=3):
    """Every anchor with every row (id, label, vector)."""
    part = list({(i, y, tuple(v)): None for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)})
    part = [(i, y, [math.floor(256 * x) for x in v]) for i, y, v in part]
    dot = lambda a, b: max(-N.LIMIT, min(N.LIMIT, sum(x * y for x, y in zip(a, b))))
    out = []
    for a in part:
        if a[0] % anchors:
            continue
        near = sorted((-dot(a[2], b[2]), b[0]) for b in part if b is not a and b[1] == a[1])[:k]
        for s, p in near:
            s = -s
            far = sorted((-dot(a[2], b[2]), b[0]) for b in part if b[1] != a[1] and 50 * s <= 100 * dot(a[2], b[2]) <= 95 * s)[:m]
            out += [(a[0], p, r + 1, n, s, -t) for r, (t, n) in enumerate(far)]
    return sorted(out)


def mined(spark, rows):
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    return sorted(map(tuple, N.mined(N.valid(table.withColumn("q", F.lit(1))), F.col("id") % 50 == 0).collect()))


def crowd(seed, n=700, dims=6):
    """Vectors of which a third are one and the same, of many labels, and ids far apart."""
    rng = random.Random(seed)
    one = [rng.uniform(-1, 1) for _ in range(dims)]
    rows = []
    for i in range(n):
        v = one if rng.random() < 0.35 else [rng.uniform(-1, 1) for _ in range(dims)]
        rows.append((i * 25 - 3000 + (0 if i % 50 else 2**61 - (2**61 % 50)), rng.randrange(3), [float(np.float32(x)) for x in v]))
    return rows


@pytest.mark.parametrize(("settled", "bits", "bytes_"), [(64, 8, 32 << 20), (0, 2, 4_000)])
def test_against_brute_force(spark, monkeypatch, settled, bits, bytes_):
    """Also where every window is refined to a single place, through the digits of the ids."""
    monkeypatch.setattr(N, "SETTLED", settled)
    monkeypatch.setattr(N, "DIGIT_BITS", bits)
    monkeypatch.setattr(N, "PART_BYTES", bytes_)
    rows = crowd(bits, 300)
    if not settled:
        rows = [(i % 900 * 50 if i < 2**60 else i, *r) for i, *r in rows]  # ids that few digits hold, some of them twice
    got = mined(spark, rows)
    assert got == brute(rows) and len(got) > 100


def test_refining_by_counts():
    """Digits alone find the k-th place of any list of (score, id)."""
    rng = random.Random(1)
    for _ in range(300):
        n = rng.choice([0, 1, 2, 5, 200])
        rows = [(rng.choice([0, 7, 7, 7, rng.randrange(-500, 500), rng.randrange(-(2**61), 2**61)]), rng.randrange(-(2**63), 2**63)) for _ in range(n)]
        w = N.begun(1, 2, -N.LIMIT, N.LIMIT, (-(2**63), 2**63 - 1), 3)
        passes = 0
        while w[-1]:
            _, _, lo, top, high, first, last, by_id, shift, need, _ = w
            counts = {}
            for s, i in rows:
                if lo <= s <= high and (not by_id or first <= i <= last):
                    d = ((i - first) if by_id else (high - s)) >> shift
                    counts[d] = counts.get(d, 0) + 1
            w, passes = N.refined(*w[:-1], counts), passes + 1
        _, _, lo, top, high, first, last, by_id, *_ = w
        kept = [(s, i) for s, i in rows if lo <= s and (s > high or not by_id or i <= last)]
        best = sorted(rows, key=lambda r: (-r[0], r[1]))[:3]
        assert set(best) <= set(kept) and len(kept) <= N.SETTLED + 3 and passes <= 16


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.25]), (2, 2, [0.75, 0.25]), (3, 2, [0.75, 0.25]), (4, None, [1.0, 1.0]), (None, 2, [0.75, 0.25]), (5, 2, None), (6, 2, [0.75, None]), (7, 2, [nan, 1.0]), (8, 2, [inf, 1.0]), (9, 2, []), (10, 2, [0.8]), (11, 1, [1.0, 0.25, 9.0]), (12, 2, [0.7, 0.2]), (13, 3, [3e30, -2e30]), (50, 3, [1e30, 1.0]), (100, 9, [1.0])]
    got = mined(spark, rows)
    assert got == brute(rows) and {r[0] for r in got} == {0}
    assert N.mined(N.valid(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")), F.lit(True)).count() == 0


def test_exact_scores():
    rng = np.random.default_rng(3)
    x, y = np.floor(rng.normal(size=(5, 9)) * 300), np.floor(rng.normal(size=(4, 9)) * 300)
    x[1, 2], y[2, 3], x[3, 3] = 2.0**60, 2.0**55, 2.0**10
    whole = [[sum(int(a) * int(b) for a, b in zip(r, s, strict=True)) for s in y] for r in x]
    assert N.scored(x, y).tolist() == [[max(-N.LIMIT, min(N.LIMIT, v)) for v in r] for r in whole]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = c.sql(N.ORACLE)
    got = N.op13_negatives(spark, sf).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 20
