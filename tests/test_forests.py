"""Leaf forests, stratified parts, threshold trees and training against plain versions."""

import csv
import glob
import hashlib
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.operators import clustering, candidates, forest, large_nodes, leaf_forests, nearest, sampling, similarity, spectral, stratify, threshold_trees, training
from verdigris.sources import tables


def md5(*x):
    return hashlib.md5("|".join(map(str, x)).encode()).hexdigest()


def plain_forest(rows, cols, trees, depth, balanced=False, seed="leaf"):
    """rows: (key, numbers, y) of one leaf and label 0; a function from numbers to a probability, and the gain by column."""
    lo, hi = [min(r[1][c] for r in rows) for c in range(cols)], [max(r[1][c] for r in rows) for c in range(cols)]
    bins = lambda x: [min(max(math.floor((x[c] - lo[c]) / (hi[c] - lo[c]) * leaf_forests.BINS) if hi[c] > lo[c] else 0, 0), leaf_forests.BINS - 1) for c in range(cols)]
    n, ones = len(rows), sum(r[2] for r in rows)
    grown = []
    for t in range(trees):
        drawn = []
        for k, x, y in rows:
            u = int(md5(seed, t, 0, k)[:8], 16) / 2**32
            w = float(sum(u >= p for p in leaf_forests.POISSON)) * (n / (2.0 * (ones if y else n - ones)) if balanced else 1)
            if w:
                drawn.append((bins(x), y, w))

        def node(own, place, left):
            tw, t1 = sum(w for *_, w in own), sum(w for _, y, w in own if y)
            p = t1 / tw
            gini = lambda a, b: 2 * (b / a) * (1 - b / a)
            best = None
            if left and 1e-12 < p < 1 - 1e-12 and tw >= 2:
                for c in sorted(sorted(range(cols), key=lambda c: (md5(f"{seed}col", 0, t, place, c), c))[: max(1, int(math.sqrt(cols) + 0.5))]):
                    for at in sorted({b[c] for b, *_ in own}):
                        lw, l1 = sum(w for b, _, w in own if b[c] <= at), sum(w for b, y, w in own if y and b[c] <= at)
                        if tw - lw > 1e-9:
                            g = round(tw * gini(tw, t1) - lw * gini(lw, l1) - (tw - lw) * gini(tw - lw, t1 - l1), 9)
                            if g > 1e-9 and (best is None or g > best[0]):
                                best = (g, c, at)
            if best is None:
                return p
            side = lambda s: [r for r in own if (r[0][best[1]] > best[2]) == s]
            return (best, node(side(False), 2 * place, left - 1), node(side(True), 2 * place + 1, left - 1))

        grown.append(node(drawn, 1, depth))

    def prob(x):
        def down(m, b):
            return m if isinstance(m, float) else down(m[2] if b[m[0][1]] > m[0][2] else m[1], b)

        return sum(down(m, bins(x)) for m in grown) / trees

    def gains(m):
        return {} if isinstance(m, float) else {k: sum(d.get(k, 0) for d in ({m[0][1]: m[0][0]}, gains(m[1]), gains(m[2]))) for k in {m[0][1], *gains(m[1]), *gains(m[2])}}

    each = [gains(m) for m in grown]
    share = {c: sum(g.get(c, 0) / sum(g.values()) for g in each if g) / max(1, sum(map(bool, each))) for c in range(cols)}
    return prob, share


def test_leaf_forests_in_parts(spark, monkeypatch):
    """A row stays one row whatever the trees and labels, and a group's parts add up to the same forests and answers."""
    rng = random.Random(5)
    df = spark.createDataFrame([("g", i, rng.random(), rng.random(), int(rng.random() < 0.4)) for i in range(90)], "g string, k long, a double, b double, y int")
    seen = []
    for part in (1 << 20, 16):
        monkeypatch.setattr(leaf_forests, "PART", part)
        kept = []
        monkeypatch.setattr(leaf_forests, "cut", lambda t, kept=kept: kept.append(t.checkpoint()) or kept[-1])
        model = leaf_forests.fit(df, ["g"], "k", ["a", "b"], ["y"], 6, 2)
        assert [t.count() for t in kept if "_w" in t.columns] == [90]
        seen.append((sorted(map(tuple, model["nodes"].collect()), key=repr), sorted(map(tuple, leaf_forests.predictions(model, df, ["g"], "k", ["a", "b"]).collect()))))
    assert seen[0] == seen[1] and len(seen[0][1]) == 90


@pytest.mark.parametrize("balanced", [False, True])
def test_leaf_forests(spark, balanced):
    rng = random.Random(3)
    rows = [(i, [rng.random(), rng.gauss(0, 3), float(rng.randrange(3))], 0) for i in range(60)]
    rows = [(i, x, int(x[0] + 0.1 * x[1] > rng.random())) for i, x, _ in rows]
    df = spark.createDataFrame([("g", i, *x, y, 1) for i, x, y in rows], "g string, k long, a double, b double, c double, y int, z int")
    new = [(100 + i, [rng.random() * 1.4 - 0.2, rng.gauss(0, 4), 1.0]) for i in range(25)]
    ask = spark.createDataFrame([("g", i, *x) for i, x in new], "g string, k long, a double, b double, c double")
    cols = ["a", "b", "c"]
    model = leaf_forests.fit(df, ["g"], "k", cols, ["y", "z"], 5, 3, balanced)
    prob, share = plain_forest(rows, 3, 5, 3, balanced)
    for first in (False, True):
        got = {(r.k, r.label): r for r in leaf_forests.predictions(model, ask, ["g"], "k", cols, first).collect()}
        ones = sum(r[2] for r in rows) / len(rows)
        for i, x in new:
            p = prob(x)
            assert math.isclose(got[i, 0].prob, p, abs_tol=1e-9) and (got[i, 1].prob, got[i, 1].pred) == (1.0, 1)
            assert got[i, 0].pred == (int(not round(1 - p, 9) > round(0.95 * (1 - ones), 9)) if first else int(round(p, 9) > round(0.95 * ones, 9)))
    imp = {r.col: r.importance for r in leaf_forests.importances(model, ["g"], cols).where("label = 0").collect()}
    assert all(math.isclose(imp.get(c, 0.0), share[i], abs_tol=1e-9) for i, c in enumerate(cols)) and math.isclose(sum(imp.values()), 1)


def test_supervised_fill(spark):
    rows = [("g", i, float(i), float(i % 7), int(i >= 30) if i % 3 else -1) for i in range(60)] + [("h", 99, 1.0, 1.0, -1)]
    df = spark.createDataFrame(rows, "g string, k long, a double, b double, y int")
    got = {r.k: r.y for r in leaf_forests.supervised_fill(df, ["g"], "k", ["a", "b"], ["y"]).collect()}
    prob, _ = plain_forest([(k, [a, b], y) for g, k, a, b, y in rows if y >= 0], 2, 7, 4, seed="fill")
    assert got == {k: y if y >= 0 else int(round(prob([a, b]), 9) > 0.5) for g, k, a, b, y in rows if g == "g"}


@pytest.mark.parametrize("shares", [[0.7, 0.3], [0.2] * 5, [0.5, 0.25, 0.25]])
def test_stratified_parts(spark, shares):
    """Quotas are those of the plain algorithm, and every label is split as near as whole rows allow."""
    rng = random.Random(len(shares))
    rows = [(i, int(rng.random() < 0.5), int(rng.random() < 0.2), int(rng.random() < 0.05), int(rng.random() < 0.01)) for i in range(1500)]
    df = spark.createDataFrame(rows, "row_id long, a int, b int, c int, d int")
    got = {r.row_id: r.part for r in stratify.parts(df, ["a", "b", "c", "d"], shares, "s").collect()}
    assert set(got) == set(range(1500))
    for label in (1, 2, 3, 4, None):
        own = [r for r in rows if label is None or r[label]]
        for m, s in enumerate(shares):
            assert abs(sum(got[r[0]] == m for r in own) - s * len(own)) <= 2, (label, m)


def test_quotas_follow_the_plain_algorithm():
    rng = random.Random(5)
    for _ in range(300):
        k = rng.choice([2, 3, 5])
        wanted, total = [rng.uniform(-3, 40) for _ in range(k)], [rng.uniform(0, 99) for _ in range(k)]
        n = rng.randrange(0, 60)
        w, t = list(wanted), list(total)
        for _ in range(n):
            m = max(range(k), key=lambda m: (round(w[m], 9), round(t[m], 9), -m))
            w[m], t[m] = w[m] - 1, t[m] - 1
        got = stratify.quotas(wanted, n, total)
        assert sum(got) == n and max(abs(a - (x - y)) for a, x, y in zip(got, wanted, w)) < 1e-6


def test_threshold_tree(spark):
    """Two columns, the second of which splits better and gives sides that agree more."""
    rows = [(i, float(i % 5), float(i), *((1, 0) if i < 20 else (0, 1))) for i in range(40)]
    df = spark.createDataFrame(rows, "k long, p double, q double, y0 int, y1 int")
    nodes, members = threshold_trees.grow(df, "k", ["p", "q"], ["y0", "y1"], 0.4, 3)
    n = {r.node: r for r in nodes.collect()}
    assert set(n) == {1, 2, 3, 4, 5, 6, 7} or set(n) == {1, 2, 3}
    assert n[1].col == "q" and n[1].cut == 19.0 and math.isclose(n[1].compat, 1.0, abs_tol=1e-6)
    leaf = {r.k: r.node for r in threshold_trees.walk(df, nodes, "k", ["p", "q"]).collect()}
    assert len(leaf) == 40 and {k for k, v in leaf.items() if bin(v)[3] == "0"} == set(range(20))
    share = {(r.node, r.label): r.prob for r in threshold_trees.leaf_shares(members, nodes, df, "k", ["y0", "y1"]).collect()}
    assert all(share[leaf[k], 0] == (k < 20) for k in range(40))
    flat = spark.createDataFrame([(i, 1.0, -1) for i in range(4)], "k long, p double, y int")
    nodes, _ = threshold_trees.grow(flat, "k", ["p"], ["y"])
    assert [(r.node, r.col) for r in nodes.collect()] == [(1, None)]


def test_stochastic_blend(spark):
    leaf = spark.createDataFrame([(1, 0, 1.0), (1, 1, 0.0)], "k long, label int, prob double")
    assert {(r.label, r.pred, r.probability) for r in threshold_trees.stochastic(leaf, "k", F.col("prob"), "s").collect()} == {(0, 1, 1.0), (1, 0, 0.0)}
    got = {r.label: (r.pred, round(r.probability, 9)) for r in threshold_trees.stochastic(leaf, "k", F.col("prob"), "s", F.lit(0.75), F.lit(0.5)).collect()}
    assert got == {0: (1, round(0.4 * 0.625 + 0.6, 9)), 1: (1, round(0.4 * 0.625, 9))}


def test_training(spark, tmp_path):
    """Fit, predict, explain, report, save; cross validation trains without the fold's rows."""
    num, cat, labels = tables.NUMERIC, tables.CATEGORICAL, tables.MASKED
    full = tables.customer_ml(spark, "/root/testdata/sf0.001").select("row_id", *num, *cat, *labels, *tables.LABELS)
    f = training.Forest("row_id", num, cat, labels, forest.Config(trees=2, depth=1, iterations=4, groups=2, least_share=0.01), reps=1, leaf_trees=2, leaf_depth=1)
    assert f.get_params()["depth"] == 1 and f.set_params(depth=3, reps=2).get_params()["reps"] == 2 and f.config.depth == 1
    with pytest.raises(ValueError):
        f.set_params(no_such=1)
    f.fit(full)
    n = full.count()
    pred = f.predict_with_proba(full).cache()
    assert pred.count() == n * 5 and pred.where("prob < 0 OR prob > 1 OR (vote >= 0.5) <> (pred = 1)").count() == 0
    assert sorted(map(tuple, f.predict(full).collect())) == sorted((r.row_id, r.label, r.pred) for r in pred.collect())
    truth = full.drop(*labels).withColumnsRenamed(dict(zip(tables.LABELS, labels)))
    act = f.activations(truth).cache()
    assert act.count() == n * 5 * 2 and act.where("tp + tn + fp + fn <> 1").count() == 0
    rules = {r.id: r for r in f.rules().collect()}
    assert {r.id for r in f.rule_quality(act).collect()} <= set(rules) and all((r.probs is not None) == r.is_leaf for r in rules.values())
    text = f.tree_text().orderBy("tree", "place").collect()
    assert len(text) == len(rules) and text[0].line.endswith(f"({rules['0_1'].n} rows)")
    assert f.explanations(full.limit(5)).count() > 0
    scored = pred.join(f.long_labels(truth), ["row_id", "label"])
    training.write_report(str(tmp_path / "report"), f, scored)
    lines = [json.loads(x) for p in glob.glob(f"{tmp_path}/report/*.json") for x in open(p)]
    assert {"depth", "macro_ap", "tp"} <= {x["name"] for x in lines} and sum(x["value"] for x in lines if x["name"] in ("tp", "tn", "fp", "fn")) == n * 5
    r = training.report(scored)
    training.write_summary(str(tmp_path / "summary"), [({"depth": 2, "bag": 1}, r), ({"depth": 3, "bag": 1}, r)])
    table = [x for p in sorted(glob.glob(f"{tmp_path}/summary/*.csv")) for x in csv.DictReader(open(p))]
    assert {x["depth"] for x in table} == {"2", "3"} and "bag" not in table[0]
    f.save(str(tmp_path / "model"))
    assert spark.read.parquet(f"{tmp_path}/model/members").count() == f.fitted["members"].count()


def test_cross_validation(spark):
    num, cat, labels = tables.NUMERIC, tables.CATEGORICAL, tables.MASKED
    full = tables.customer_ml(spark, "/root/testdata/sf0.001").select("row_id", *num, *cat, *labels, *tables.LABELS)
    folds = full.select("row_id", (F.col("row_id") % 2).cast("int").alias("fold"))
    f = training.Forest("row_id", num, cat, labels, forest.Config(trees=1, depth=1, iterations=3, groups=2, least_share=0.01), reps=1, leaf_trees=2, leaf_depth=1)
    got = training.cross_validated(full, folds, 2, f, tables.LABELS)
    assert got.count() == full.count() * 5 and got.where("fold <> row_id % 2").count() == 0
    best = training.searched(full, folds, 2, f, tables.LABELS, [{"depth": 1}], lambda s: float(s.agg(F.avg((F.col("pred") == F.col("y")).cast("int"))).first()[0]))
    assert best[0][0] == {"depth": 1} and 0.3 < best[0][1] <= 1


def test_label_pairs_of_many_labels(spark):
    """174 labels: the index's pairs and the counts by size make up all pairs; no pair is found by comparing all."""
    rng = np.random.default_rng(2)
    y = (rng.random((90, 174)) < 0.02).astype(int)
    labels = [f"l{i}" for i in range(174)]
    df = spark.createDataFrame([(i, "g", *map(int, r)) for i, r in enumerate(y)], ", ".join(["k long", "g string", *(f"{c} int" for c in labels)]))
    v = sorted({"".join(map(str, r)) for r in y})
    want = {(a, b): sum(p == q == "1" for p, q in zip(a, b)) for i, a in enumerate(v) for b in v[i:]}
    pairs = similarity.shared_labels(df, labels)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {(r.a, r.b): r for r in pairs.collect()}
    assert {k: r.shared for k, r in got.items()} == {k: s for k, s in want.items() if s or k[0] == k[1]}
    agree = lambda a, b: sum(p == q for p, q in zip(a, b)) / 174
    assert all(math.isclose(r.matching, agree(*k)) for k, r in got.items())
    apart = {}
    for (a, b), s in want.items():
        if not s and a != b:
            k = (*sorted((a.count("1"), b.count("1"))), round(agree(a, b), 9))
            apart[k] = apart.get(k, 0) + 1
    assert {(r.sa, r.sb, round(r.matching, 9)): r.pairs for r in similarity.matching_apart(df, labels).collect()} == apart
    ab = clustering.anchors(df, ["g"], "k", labels).collect()
    assert [(r.a, r.b) for r in ab] == [candidates.anchors(np.arange(90), y.astype(float))]


@pytest.mark.parametrize("labels", [1, 2, 3])
def test_anchors_of_few_labels(spark, labels):
    """Groups in which all, some or no vectors have a common label, and single rows."""
    rng = random.Random(labels)
    groups = {f"g{i}": [[int(rng.random() < rng.choice([0.3, 0.9, 1.0])) for _ in range(labels)] for _ in range(rng.randrange(1, 7))] for i in range(25)}
    groups |= {"one": [[1] * labels] * 3, "zero": [[0] * labels] * 2, "none": [[0] * labels]}
    names = [f"l{i}" for i in range(labels)]
    df = spark.createDataFrame([(g, i, *r) for g, rows in groups.items() for i, r in enumerate(rows)], ", ".join(["g string", "k long", *(f"{c} int" for c in names)]))
    got = {r.g: (r.a, r.b) for r in clustering.anchors(df, ["g"], "k", names).where("a <> b").collect()}
    want = {g: candidates.anchors(np.arange(len(rows)), np.array(rows, float)) for g, rows in groups.items()}
    assert got == {g: x for g, x in want.items() if x}


@pytest.mark.parametrize(("block", "shard"), [(512, 65_536), (2, 9)])
def test_intra_distance(spark, monkeypatch, block, shard):
    """The scaled lower triangle of the distance matrix, by prefix sums and farthest members."""
    monkeypatch.setattr(similarity, "BLOCK", block)
    monkeypatch.setattr(nearest, "SHARD", shard)
    monkeypatch.setattr(nearest, "LEAF", 3)
    rng = random.Random(block)
    rows = [(i * 3, "g", i % 3 // 2, rng.gauss(0, 1), float(rng.randrange(4)), rng.choice("ab")) for i in range(45)] + [(999, "h", 0, 1.0, 1.0, "a")]
    df = spark.createDataFrame(rows, "k long, node string, cl int, x double, z double, c string")
    got = {(r.node, r.cl): r.avg for r in similarity.intra_distance(df, ["node"], "k", ["x", "z"], ["c"]).collect()}
    span = [max(r[i] for r in rows[:45]) - min(r[i] for r in rows[:45]) + 1e-12 for i in (3, 4)]
    for cl in (0, 1):
        own = [r for r in rows[:45] if r[2] == cl]
        d = np.array([[(abs(a[3] - b[3]) / span[0] + abs(a[4] - b[4]) / span[1] + (a[5] != b[5])) / 3 for b in own] for a in own])
        scaled = d / (d.max(0) + 1e-5)
        low = np.tril_indices(len(own), -1)
        assert math.isclose(got["g", cl], scaled[low].mean(), rel_tol=1e-9)
    assert set(got) == {("g", 0), ("g", 1)}


def test_spectral_sides(spark):
    """The sides of dense eigenvectors, over 500 rows of two uneven crowds and their surroundings."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal([0, 0, 0], 0.5, (300, 3)), rng.normal([3, 2, 1], 0.6, (180, 3)), rng.uniform(-1, 4, (20, 3))])
    df = spark.createDataFrame([("g", i, *map(float, r)) for i, r in enumerate(x)] + [("h", 1000, 1.0, 1.0, 1.0), ("h", 1001, 1.0, 1.0, 1.0)], "node string, k long, a double, b double, c double")
    got = {r.k: r.side for r in spectral.sides(df, ["node"], "k", ["a", "b", "c"]).collect()}
    z = (x - x.min(0)) / np.ptp(x, axis=0)
    w = np.exp(-8.0 * ((z[:, None] - z[None]) ** 2).sum(2))
    d = np.sqrt(w.sum(1))
    side = np.linalg.eigh(w / d[:, None] / d[None])[1][:, -2] > 0
    same = np.mean([got[i] == side[i] for i in range(500)])
    assert max(same, 1 - same) >= 0.99 and got[1000] == got[1001]


def test_rules_train_no_leaf_forests(spark):
    """Rules come from trees and completed labels alone; predictions train the leaves, once."""
    rng = random.Random(2)
    rows = [(i, rng.random(), rng.random(), *((rng.randrange(2), rng.randrange(2)) if i % 2 else (-1, -1))) for i in range(40)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y int, z int")
    f = training.Forest("row_id", ["a", "b"], [], ["y", "z"], forest.Config(trees=1, depth=0), reps=1, leaf_trees=2, leaf_depth=1).fit(df)
    assert f.rules().count() == 1 and "leaves" not in f.fitted
    assert f.predict(df).count() == 80 and f.leaves() is f.leaves()


def test_self_training_sorts_once(monkeypatch):
    """Trees over drawn rows are those of the sorted copies, to the last digit, and no tree sorts."""
    from verdigris.operators import leaves as L

    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=900), rng.integers(0, 9, 900), rng.lognormal(size=900)])
    y = (x[:, 1] + rng.normal(size=900) > 4).astype(int)
    known = np.flatnonzero(rng.random(900) < 0.4)
    columns = [v.copy() for v in x.T]
    orders = [np.argsort(v, kind="stable") for v in columns]
    for seed in range(5):
        a, b = np.random.default_rng(seed), np.random.default_rng(seed)
        at = known[a.integers(0, len(known), len(known))]
        want = L._tree(x[at], y[at].astype(float), a, 4, np.zeros(3))
        w = np.bincount(known[b.integers(0, len(known), len(known))], minlength=900)
        with monkeypatch.context() as m:
            m.setattr(np, "argsort", None)
            assert L._drawn_tree(columns, y, w, [o[w[o] > 0] for o in orders], b, 4) == want
    v = np.round(rng.random(900), 1)
    assert sorted(L._surest(v, 77)) == sorted(np.argsort(-v, kind="stable")[:77])


@pytest.mark.parametrize("name", ["a16_forest_mean", "l4_leaf_votes"])
def test_votes_are_grouped_in_small_tasks(spark, monkeypatch, name):
    """A task groups the labels and trees of SCORED rows at most, however large the table is."""
    import __spark_entry__ as entry

    from verdigris.sources import tables as T

    whole = entry.queries()[name](spark, "/root/testdata/sf0.01")
    assert whole.rdd.getNumPartitions() <= 4
    monkeypatch.setattr(T, "SCORED", 100)
    dealt = entry.queries()[name](spark, "/root/testdata/sf0.01")
    assert dealt.rdd.getNumPartitions() == 15
    assert sorted(map(tuple, dealt.collect())) == sorted(map(tuple, whole.collect()))


def test_bags_of_all_trees_in_one_plan(spark, monkeypatch):
    """Bags are those of a plan for each, and the plan doesn't grow with the trees."""
    df = tables.customer_ml(spark, "/root/testdata/sf0.001").select("row_id", *tables.MASKED)
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("tree"), F.lit(f"s{t}").alias("seed")) for t in range(3)))).alias("s")
    got = sorted((r.tree, r.row_id) for r in sampling.inverse_frequency_bags(df.select("*", each).select("row_id", *tables.MASKED, "s.*"), tables.MASKED, 0.8).collect())
    assert got == sorted((t, r.row_id) for t in range(3) for r in sampling.inverse_frequency_bag(df, tables.MASKED, 0.8, f"s{t}").collect())
    seen = []
    for trees in (1, 6):
        drawn = []
        monkeypatch.setattr(forest, "cut", lambda t, drawn=drawn: drawn.append(t) or t.checkpoint())
        forest.grow(df.withColumn("x", F.col("row_id") * 1.0), "row_id", ["x"], [], tables.MASKED, forest.Config(trees=trees, depth=0))
        seen.append(drawn[0]._jdf.queryExecution().optimizedPlan().toString().count("Window"))
    assert seen[0] == seen[1]


def test_rule_quality_looks_at_activations_once(spark):
    """What a walk and its forests say is computed once for all three sums."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    rows = [(i, 0, 2 + i % 2, label, int(i % 3 == label), int(i % 3 != label), 0, 0) for i in range(12) for label in (0, 1)]
    act = spark.createDataFrame(rows, "row_id long, tree int, node long, label int, tp int, tn int, fp int, fn int")
    got = training.Forest("row_id", ["x"], [], ["a", "b"]).rule_quality(act.mapInPandas(count, act.schema)).collect()
    assert {(r.id, r.n, r.macro_f1, r.micro_f1) for r in got} == {("0_2", 6, 1.0, 1.0), ("0_3", 6, 1.0, 1.0)} and seen.value == 24


def test_large_nodes_in_cells(spark, monkeypatch):
    """Sides and scores are those of one task where a column has many cells, a value as frequent as a cell, and null categories; rows are
    not multiplied by the candidates."""
    rng = random.Random(8)
    rows = [(i, rng.gauss(0, 1), float(rng.choice([0, 0, 0, 1, 7])), rng.choice(["a", "b", None]), *((rng.randrange(2), rng.randrange(2)) if i % 3 else (-1, -1))) for i in range(400)]
    df = spark.createDataFrame(rows, "row_id long, x double, z double, c string, m0 int, m1 int")
    c, got, seen = forest.Config(trees=1, depth=1, iterations=5, groups=4, bag=0.9), [], []
    monkeypatch.setattr(large_nodes, "CELL", 30)
    monkeypatch.setattr(large_nodes, "AT_ONCE", 3)
    monkeypatch.setattr(large_nodes, "cut", lambda t: seen.append((t.columns, n := t.checkpoint())) or n)
    for size in (131_072, 0):
        monkeypatch.setattr(forest, "SMALL_NODE", size)
        nodes, members = forest.grow(df, "row_id", ["x", "z"], ["c"], ["m0", "m1"], c)
        got.append((sorted((r.node, r.is_leaf, tuple(r.cols or ()), round(r.score or 0, 8)) for r in nodes.collect()), sorted(map(tuple, members.collect()))))
    assert got[0] == got[1] and len(got[0][0]) == 3
    dealt = [t.count() for names, t in seen if "sides" in names]
    assert len(dealt) == 2 and set(dealt) == {3 * members.where("node = 1").count()}
