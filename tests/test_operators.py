"""Values computed by hand, and invariants."""

import collections
import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from verdigris.functions.expressions import cosine, gower
from verdigris.functions import prefix
from verdigris.functions.prefix import before, runs
from verdigris.operators import candidates, clustering, forest, leaves, metrics, parameters, paths, sampling, similarity, splits, tabular
from verdigris.plans import regions
from verdigris.sources import tables
from verdigris.streaming import activations


@pytest.fixture(scope="module")
def m(spark):
    rows = [(1, "g", 1.0, 10.0, "a"), (2, "g", 2.0, 30.0, "a"), (3, "g", 4.0, 20.0, "b"), (4, "g", 5.0, 50.0, "b"), (5, "g", 3.0, 10.0, "c")]
    return spark.createDataFrame(rows, "row_id long, node string, x double, z double, c string")


PAIRS = {(1, 2): (0.25, 0.375), (1, 3): (0.666667, 0.5), (1, 4): (1.0, 1.0), (1, 5): (0.5, 0.25), (2, 3): (0.583333, 0.375), (2, 4): (0.75, 0.625), (2, 5): (0.583333, 0.375), (3, 4): (0.333333, 0.5), (3, 5): (0.5, 0.25), (4, 5): (0.833333, 0.75)}


def test_mixed_distance(m):
    p = similarity.pairs(m, ["node"], "row_id", lambda a, b, r: gower(a, b, r, ["x", "z"], ["c"]), ["x", "z"])
    assert {(r.a, r.b): round(r.d, 6) for r in p.collect()} == {k: v[0] for k, v in PAIRS.items()}
    n = m.drop("c")
    p = similarity.pairs(n, ["node"], "row_id", lambda a, b, r: gower(a, b, r, ["x", "z"], []), ["x", "z"])
    assert {(r.a, r.b): round(r.d, 6) for r in p.collect()} == {k: v[1] for k, v in PAIRS.items()}
    p = similarity.pairs(n, ["node"], "row_id", lambda a, b, r: gower(a, b, r, ["x", "z"], [], True), ["x", "z"])
    assert {(r.a, r.b): round(r.d, 6) for r in p.collect()} == {k: v[1] + 0.5 for k, v in PAIRS.items()}


def test_linear_forms(m):
    assert round(similarity.average_distance(m, ["node"], "row_id", ["x", "z"], ["c"]).first().avg, 6) == 0.6
    cl = m.withColumn("cl", F.when(F.col("row_id") <= 2, 0).otherwise(1))
    s = {r.row_id: round(r.s, 6) for r in similarity.silhouettes(cl, ["node"], "row_id", ["x", "z"], ["c"]).collect()}
    assert s == {1: 0.653846, 2: 0.608696, 3: 0.333333, 4: 0.333333, 5: -0.1875}
    assert similarity.average_distance(m.where("row_id = 1"), ["node"], "row_id", ["x"], []).first().avg == 0.0


@pytest.fixture(scope="module")
def y(spark):
    return spark.createDataFrame([(1, 1, 0, 1), (2, 1, 0, 0), (3, 0, 1, 1), (4, 0, 1, 0)], "row_id long, a int, b int, c int")


def test_labels(y):
    j = y.alias("x").join(y.alias("y"), F.col("x.row_id") < F.col("y.row_id")).select(F.col("x.row_id").alias("i"), F.col("y.row_id").alias("j"), F.round(cosine("x", "y", ["a", "b", "c"]), 6).alias("d"))
    assert {(r.i, r.j): r.d for r in j.collect()} == {(1, 2): 0.292893, (1, 3): 0.5, (1, 4): 1.0, (2, 3): 1.0, (2, 4): 1.0, (3, 4): 0.292893}
    v = {(r.a, r.b): (round(r.jaccard, 6), round(r.matching, 6)) for r in similarity.compatibilities(y, ["a", "b", "c"]).collect()}
    assert v["100", "101"] == (0.5, 0.666667) and v["010", "100"] == (0.0, 0.333333)
    b = y.withColumn("g", F.lit(1))
    assert round(clustering.example_balance(b, ["g"], ["a", "b", "c"]).first().balance, 6) == 1.0
    assert round(clustering.example_balance(b.where("row_id < 3"), ["g"], ["a", "b", "c"]).first().balance, 6) == 0.333333


def test_metrics(spark, y):
    p = {1: (0.9, 0.2, 0.6), 2: (0.4, 0.5, 0.1), 3: (0.3, 0.8, 0.7), 4: (0.6, 0.2, 0.1)}
    long = spark.createDataFrame([(r.row_id, i, r[i + 1], p[r.row_id][i]) for r in y.collect() for i in range(3)], "row_id long, label int, y int, prob double")
    pred = F.when(F.col("prob") >= 0.5, 1).otherwise(0)
    assert round(metrics.rank_auc(long).first().auc, 6) == 0.666667
    assert round(metrics.hamming_loss(long, pred).first().loss, 6) == 0.333333
    assert metrics.subset_accuracy(long, pred).first().accuracy == 0.5
    assert metrics.label_ranking_precision(long).first().lrap == 0.75


def test_prefix_sums(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), (F.xxhash64("id") % 97).cast("double").alias("x"))
    got = before(df, ["g"], "x", "id", {"k": F.lit(1), "s": F.col("x")}, bins=7).collect()
    for g in range(3):
        own = sorted((r for r in got if r.g == g), key=lambda r: (r.x, r.id))
        total = 0.0
        for i, r in enumerate(own):
            assert (r.k, r.s) == (i, total)
            total += r.x


def test_encoding_and_masks(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None), (4, "b")], "k long, c string")
    codes = tabular.encoding(df, "c")
    assert {r.k: r.c for r in tabular.encode(df, "c", codes).collect()} == {1: 1.0, 2: 0.0, 3: None, 4: 1.0}
    assert {r.k: r.c for r in tabular.encode(spark.createDataFrame([(9, "z")], df.schema), "c", codes).collect()} == {9: None}
    r = tabular.correlations(spark.createDataFrame([(1.0, 5.0), (2.0, 5.0)], "a double, b double"), ["a", "b"]).first()
    assert r.r is None


def test_samples(spark):
    df = spark.range(500).select(F.col("id").alias("row_id"), (F.col("id") % 10 == 0).cast("int").alias("m0"), (F.col("id") % 2).cast("int").alias("m1"))
    one, two = ({r.row_id for r in sampling.inverse_frequency_bag(df, ["m0", "m1"], 0.5, "s").collect()} for _ in range(2))
    assert one == two and 250 <= len(one) < 500
    folds = sampling.folds(df, ["m0", "m1"], 5, "f").groupBy("fold").count().collect()
    assert len(folds) == 5 and max(r["count"] for r in folds) - min(r["count"] for r in folds) <= 4


def test_forest(spark):
    """Members of the children are those of the parent; every row reaches one leaf of each tree."""
    df = tables.customer_ml(spark, "/root/testdata/sf0.001").select("row_id", *tables.NUMERIC, *tables.CATEGORICAL, *tables.MASKED)
    nodes, members = forest.grow(df, "row_id", tables.NUMERIC, tables.CATEGORICAL, tables.MASKED, forest.Config(trees=1, depth=1, iterations=3, groups=3, least_share=0.01))
    split = nodes.where("NOT is_leaf").count() == 1
    assert members.where("level = 1").count() == (members.where("level = 0").count() if split else 0)
    s = {r.node: r for r in forest.structure(nodes, members, df, "row_id", F.col("m0") >= 0).collect()}
    if split:
        assert s[1].n == s[2].n + s[3].n and s[2].parent == 1 and s[1].left == 2 and s[2].path == s[1].cols
    routed = forest.route(df, df, nodes, members, "row_id", tables.NUMERIC, tables.CATEGORICAL).collect()
    assert len(routed) == df.count() and {r.node for r in routed} <= ({2, 3} if split else {1})
    assert split


def test_forest_below_the_root(spark):
    """Two splits on the way: levels, members and column paths, and routes held against a walk in Python."""
    num, cat = tables.NUMERIC, tables.CATEGORICAL
    df = tables.customer_ml(spark, "/root/testdata/sf0.01").where("row_id <= 600").select("row_id", *num, *cat, *tables.MASKED).localCheckpoint()
    nodes, members = forest.grow(df, "row_id", num, cat, tables.MASKED, forest.Config(trees=1, depth=2, iterations=6, groups=3, least_share=0.01))
    node = {r.node: r for r in nodes.collect()}
    own, row = collections.defaultdict(set), {r.row_id: r for r in df.collect()}
    for r in members.collect():
        own[r.node].add(r.row_id)
    inner = [k for k, r in node.items() if not r.is_leaf]
    assert set(inner) & {2, 3} and {r.level for r in node.values()} == {0, 1, 2}
    for k in inner:
        assert own[2 * k] | own[2 * k + 1] == own[k] and not own[2 * k] & own[2 * k + 1]
    path = {r.node: set(r.path) for r in forest.structure(nodes, members, df, "row_id", F.col("m0") >= 0).collect()}
    for k, r in node.items():
        assert path[k] == set(r.cols or []) | (path[k // 2] if k > 1 else set())

    def leaf(r, k=1):
        while not node[k].is_leaf:
            both = [row[i] for i in own[2 * k] | own[2 * k + 1]]
            span = {x: max(m[x] for m in both) - min(m[x] for m in both) + 1e-12 for x in num}
            far = lambda m: round(sum(abs(r[x] - m[x]) / span[x] if x in num else float(r[x] != m[x]) for x in node[k].cols), 9)  # noqa: B023, E731
            k = 2 * k + (min(map(far, (row[i] for i in own[2 * k]))) >= min(map(far, (row[i] for i in own[2 * k + 1]))))
        return k

    routed = {r.row_id: r.node for r in forest.route(df, df, nodes, members, "row_id", num, cat).collect()}
    assert routed == {i: leaf(r) for i, r in row.items()}


def test_small_and_large_nodes_split_alike(spark, monkeypatch):
    """A node's candidates come to the same sides and scores in one task and in distributed plans."""
    num, cat = tables.NUMERIC, tables.CATEGORICAL
    df = tables.customer_ml(spark, "/root/testdata/sf0.001").select("row_id", *num, *cat, *tables.MASKED)
    c = forest.Config(trees=2, depth=1, iterations=5, groups=3, least_share=0.01, n_attr=8)
    got = []
    for size in (20_000, 0):
        monkeypatch.setattr(forest, "SMALL_NODE", size)
        nodes, members = forest.grow(df, "row_id", num, cat, tables.MASKED, c)
        got.append((sorted((r.tree, r.node, r.is_leaf, tuple(r.cols or ()), round(r.score or 0, 8)) for r in nodes.collect()), sorted(map(tuple, members.collect()))))
    assert got[0] == got[1] and len({n for n in got[0][0] if not n[2]}) == 2


def test_distances_over_drawn_columns_only():
    """Two of four columns are drawn: the others count in no distance, spread or correlation."""
    x = {k: np.array(v, float) for k, v in {"p": [0, 1, 2, 4], "q": [0, 10, 0, 10], "r": [5, 6, 7, 8]}.items()}
    node = candidates.Node(np.arange(4), x, {"c": np.array([0, 0, 1, 1])}, np.array([[1, 0], [0, 1], [1, 1], [1, 0]]), np.ones(4, bool))
    assert np.allclose(node.distances(["p", "c"], 0), [0, 0.125, 0.75, 1.0])
    assert math.isclose(node._spread(["p", "c"], np.array([0, 1])), (1 + 0) / 2, abs_tol=1e-9)
    assert node._independence(["p", "c"]) == 1.0 and math.isclose(node._independence(["p", "q"]), 1 - np.corrcoef(x["p"], x["q"])[0, 1] ** 2)


def test_bins_of_long_tails(spark):
    """The largest bin of a lognormal column has less than five times the rows of the median one."""
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.exp(2 * F.randn(7)).alias("x"), "id")
    n = sorted(r["count"] for r in prefix._binned(df, ["g"], "x", 128).groupBy("g", "_bin").count().collect())
    assert len(n) > 200 and n[-1] < 5 * n[len(n) // 2]


def test_leaf_models(spark):
    df = spark.range(80).select(F.lit("g").alias("g"), F.col("id").alias("k"), (F.col("id") * 1.0).alias("x"), (F.col("id") >= 40).cast("int").alias("a"), F.lit(1).alias("b"))
    out = leaves.forest_models(df, df, ["g"], "k", ["x"], ["a", "b"]).collect()
    assert all(r.prob == 1.0 and r.pred == 1 for r in out if r.label == 1)
    assert sum(r.pred == (r.k >= 40) for r in out if r.label == 0) >= 78
    assert all(0 <= r.prob <= 1 for r in out)


@pytest.mark.parametrize(("n", "most"), [(45, 10), (2040, 10), (2560, 13)])
def test_self_training_takes_rounds_for_all_rows(spark, n, most):
    """20 labels a class at the ends; every open row is labelled by confidence, none left over for the last round."""
    df = spark.range(n).select(F.lit("g").alias("g"), F.col("id").alias("k"), (F.col("id") * 1.0).alias("x"), F.when(F.col("id") < min(20, n // 4), 0).when(F.col("id") >= n - min(20, n // 4), 1).otherwise(-1).alias("m"))
    out = leaves.self_trained(df, ["g"], "k", ["x"], "m").collect()
    size = collections.Counter(r["round"] for r in out)
    open_ = n - 2 * min(20, n // 4)
    assert len(out) == n and {r.label for r in out} == {0, 1} and size.pop(0) == n - open_
    assert set(size) == set(range(1, -(-open_ // most) + 1)) and max(size.values()) == most


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5, "TRUE"), (2, 3.5, "FALSE")], "k int, x double, l string")
    tables.write_csv(df, f"{tmp_path}/c")
    back = tables.read_csv(spark, f"{tmp_path}/c", "k int, x double, l string")
    assert sorted(map(tuple, tables.labelled_columns(back, ["l"]).collect())) == [(1, 2.5, 1), (2, 3.5, 0)]
    tables.write_parts(df, f"{tmp_path}/p", "l")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 2


def test_stream(spark, tmp_path):
    """Counts of a stream of events by a static table, with late rows dropped by the watermark."""
    spark.createDataFrame([(1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:20"), (2, "2024-01-01 00:02:00")], "user_id long, ts string").select("user_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(f"{tmp_path}/in")
    leaf = spark.createDataFrame([(1, "0_4"), (2, "0_5")], "user_id long, id string")
    stream = spark.readStream.schema("user_id long, ts timestamp").parquet(f"{tmp_path}/in")
    q = activations.counts(stream, leaf, "user_id").writeStream.format("memory").queryName("leaf_counts").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.id, r.n) for r in spark.table("leaf_counts").collect()} == {("0_4", 2), ("0_5", 1)}


def pull(x, near, far):
    a, b = abs(x - far), abs(x - near)
    return (a - b) / max(a, b) if max(a, b) else 0.0


@pytest.mark.parametrize("legacy", [False, True])
def test_cut_by_running_means(spark, legacy):
    """Against a walk over the sorted values; the constant column and the group of three rows have no cut."""
    import random

    r = random.Random(5)
    rows = [("g", k, float(r.choice([0, 1, 2, 7, 8, 9, 30])), 4.0) for k in range(40)] + [("h", k, float(k), 1.0) for k in range(40, 43)]
    df = spark.createDataFrame(rows, "g string, k long, x double, c double")
    o = sorted(x for g, _, x, _ in rows if g == "g")
    n, best = len(o), (0.0, None)
    left = o[0] + o[1]
    for k in range(2, n - 1):
        val = o[k - 1]
        lm, rm = left / k, (sum(o) - left) / (n - k)
        q = round((k * (pull(o[0], lm, rm) + pull(val, lm, rm)) + (n - k) * (pull(o[k], rm, lm) + pull(o[-1], rm, lm))) / 2 / n, 9)
        if q > best[0]:
            best = (q, val, lm, rm)
        left += val if legacy else o[k]
    _, cut, lm, rm = best
    quality = sum(pull(x, lm, rm) if x <= cut else pull(x, rm, lm) for x in o) / n
    assert [tuple(x) for x in splits.running_means(df, ["g"], "k", ["x", "c"], legacy).select("g", "col", "cut", "quality").collect()] == [("g", "x", cut, round(quality, 6))]


def test_purity_of_cuts(spark):
    """Values by hand: x 1..5, y 1 1 0 0 0. Later ties win where asked; the last cut leaves a side empty."""
    df = spark.createDataFrame([("g", i, float(i), int(i < 3), 1) for i in range(1, 6)], "g string, k long, x double, a int, b int")
    steps = splits.rank_step_cuts(df, ["g"], "k", "x")
    p = {r.cut: (round(r.purity, 5), r.n_left, r.n_right, r["last"], r.symmetry) for r in splits.purity(df, ["g"], "k", "x", steps, ["a"]).collect()}
    assert p == {1.0: (0.75, 1, 4, 1, 0.6), 2.0: (1.0, 2, 3, 2, 0.2), 3.0: (0.66667, 3, 2, 3, 0.2), 4.0: (0.5, 4, 1, 4, 0.6), 5.0: (0.1, 5, 0, 5, 1.0)}
    sized = {r.cut: round(r.purity, 4) for r in splits.purity(df, ["g"], "k", "x", steps, ["b"], by_size=True).collect()}
    assert sized == {1.0: 0.8, 2.0: 0.6, 3.0: 0.4, 4.0: 0.2, 5.0: 0.0}
    tied = splits.purity(df, ["g"], "k", "x", steps, ["b"]).where("n_right > 0")
    # 2 and 3 tie; the 1e-6 in the sides keeps 1 and 4 just below them
    assert splits.best(tied, ["g"], "purity").first().cut == 2.0 and splits.best(tied, ["g"], "purity", True, ("last",)).first()["last"] == 3


def test_runs_of_flags(spark):
    """Islands and neighbours against a walk, with ties and empty bins, whatever the number of bins."""
    df = spark.range(300).select((F.col("id") % 2).alias("g"), "id", (F.xxhash64("id") % 40).cast("double").alias("x"), (F.xxhash64("id", F.lit(1)) % 3 == 0).cast("int").alias("y"))
    rows = df.collect()
    for bins in (1, 7, 512):
        got = {r.id: (r.island, r.prev, r.next) for r in runs(df, ["g"], "x", "id", "y", bins).collect()}
        for g in (0, 1):
            own, island = sorted((r for r in rows if r.g == g), key=lambda r: (r.x, r.id)), 0
            for i, r in enumerate(own):
                island += i > 0 and own[i - 1].y != r.y
                assert got[r.id] == (island, own[i - 1].x if i else None, own[i + 1].x if i + 1 < len(own) else None)


def test_relations_of_labels(spark):
    """a 1-5, b 2-3 inside it, c 7-9 apart: relative; d without positives: none."""
    df = spark.createDataFrame([("n", lab, float(x), y) for lab, x, y in [("a", 1, 1), ("a", 5, 1), ("b", 2, 1), ("b", 3, 1), ("c", 7, 1), ("c", 9, 1), ("d", 4, 0)]], "node string, label string, x3 double, y int")
    got = {r.a + r.b: (r.kind, r.over_b, r.under_b) for r in regions.relations(df).collect()}
    assert got["ab"] == ("parent-child", True, False) and got["ba"] == ("parent-child", False, True)
    assert got["ac"][0] == got["cb"][0] == "relative" and got["ad"][0] == got["da"][0] == "none" and got["dd"][0] == "self"


def test_plans_do_not_grow_with_columns(spark):
    """The silhouette reads its input as often for eight columns as for one, and so does the mean distance."""
    def scans(f, n):
        df = spark.read.parquet("/root/testdata/sf0.001/customer.parquet")
        df = df.select(F.col("c_custkey").alias("k"), F.lit("g").alias("g"), (F.col("c_custkey") % 2).alias("cl"), "c_mktsegment", *((F.col("c_acctbal") * i).alias(f"x{i}") for i in range(n)))
        return f(df, ["g"], "k", [f"x{i}" for i in range(n)], ["c_mktsegment"])._jdf.queryExecution().optimizedPlan().collectLeaves().size()

    for f in (similarity.silhouettes, similarity.average_distance):
        assert scans(f, 1) == scans(f, 8) <= 16
    ranks = tabular.average_ranks(spark.range(50).select("id", (F.col("id") % 7).alias("x"), (-F.col("id")).alias("y")), ["x", "y"], "id")
    assert "SinglePartition" not in ranks._jdf.queryExecution().executedPlan().toString()
    assert {r.id: r.y for r in ranks.collect()} == {i: 50.0 - i for i in range(50)}


def test_parameters():
    spec = {"n": (int, 2, 4), "x": (float, 1.0, 2.0), "of": ["a", "b"], "p": [(float, 0, 1), (float, 5, 6)], "fixed": "k", "none": []}
    for seed in range(20):
        d = parameters.drawn(spec, seed)
        assert d["n"] in (2, 3, 4) and isinstance(d["n"], int) and 1 <= d["x"] < 2 and d["of"] in "ab" and 0 <= d["p"][0] < 1 and 5 <= d["p"][1] < 6 and (d["fixed"], d["none"]) == ("k", [])
    assert parameters.drawn(spec, 3) == parameters.drawn(spec, 3) and {parameters.drawn(spec, s)["n"] for s in range(40)} == {2, 3, 4}
    with pytest.raises(ValueError):
        parameters.drawn({"s": (str, 0, 1)}, 0)
    assert parameters.grid({"a": [1, 2], "b": "xy"}) == [{"a": 1, "b": "x"}, {"a": 1, "b": "y"}, {"a": 2, "b": "x"}, {"a": 2, "b": "y"}]
    assert parameters.labels_by_name(["id", "q_1", "q_sc", "r_2_scale", "s_3"]) == ["q_1", "s_3"]


def test_explanation_of_a_walk(spark):
    """One row over two splits, by hand: 4.0 goes by member 5.0, then by 6.0: the '<=' bound moves up once. z counts in no split."""
    df = spark.createDataFrame([(1, 0.0, 9.0), (2, 5.0, 1.0), (3, 6.0, 2.0), (4, 20.0, 3.0)], "k long, x double, z double")
    nodes = spark.createDataFrame([(0, 1, 0, False, ["x"]), (0, 2, 1, True, None), (0, 3, 1, False, ["x"]), (0, 6, 2, True, None), (0, 7, 2, True, None)], "tree int, node long, level int, is_leaf boolean, cols array<string>")
    members = spark.createDataFrame([(0, 2, 1, 1), (0, 3, 2, 1), (0, 3, 3, 1), (0, 3, 4, 1), (0, 6, 3, 2), (0, 7, 4, 2)], "tree int, node long, k long, level int")
    row = spark.createDataFrame([(9, 4.0, 0.0)], "k long, x double, z double")
    routed = forest.route(row, df, nodes, members, "k", ["x", "z"], [])
    assert [tuple(r) for r in routed.select("k", "tree", "node").collect()] == [(9, 0, 6)]
    assert [tuple(r) for r in paths.explanation_ranges(row, df, nodes, members, routed, "k", ["x", "z"], []).collect()] == [(9, 0, "x", "<=", 4.0, 6.0, 1)]
    assert {r.node: r.depth for r in paths.heights(nodes).collect()} == {1: 3, 2: 1, 3: 2, 6: 1, 7: 1}
    assert [r.line for r in paths.text_lines(nodes).orderBy("place").collect()] == ["1 x", "  2 leaf", "  3 x", "    6 leaf", "    7 leaf"]


@pytest.mark.parametrize("name", ["u5_jaccard_compatibility", "u6_intersections", "u7_simple_matching", "u8_cosine_compatibility", "u10_jaccard_or_zero"])
def test_label_queries_list_all_pairs(spark, name):
    """Pairs without a common label too."""
    from verdigris.plans import registry

    pairs = {(r.a, r.b) for r in registry.QUERIES[name](spark, "/root/testdata/sf0.001").select("a", "b").collect()}
    every = {x for p in pairs for x in p}
    assert pairs == {(a, b) for a in every for b in every if a <= b}
    assert "WHERE s > 0" not in registry.ORACLES[name]


def test_bins_are_computed_once(spark):
    """Rows and sums of a bin use the same bounds: approximate quantiles differ from one evaluation to the next."""
    df = spark.range(1000).selectExpr("id AS k", "id % 3 AS g", "CAST(id * 7 % 101 AS DOUBLE) AS x")
    out = prefix.before(df, ["g"], "x", "k", {"n": F.lit(1)}, bins=8)
    assert "percentile_approx" not in out._jdf.queryExecution().toString()
    rows = out.collect()
    for r in rows:
        assert r.n == sum(1 for o in rows if o.g == r.g and (o.x, o.k) < (r.x, r.k))


def test_matrix_summary(spark):
    """Equal to the pairs; plans of the registered queries don't form them."""
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2], float(rng.integers(0, 40)), float(rng.random()), "xyz"[rng.integers(0, 3)]) for i in range(60)]
    rows += [(60, "c", 1.0, 2.0, "x"), (61, "c", 1.0, 2.0, "x"), (62, "c", 4.0, 2.0, "y"), (63, "d", 1.0, 1.0, "x")]
    df = spark.createDataFrame(rows, "row_id long, node string, x double, z double, c string")
    p = similarity.pairs(df, ["node"], "row_id", lambda a, b, r: gower(a, b, r, ["x", "z"], ["c"]), ["x", "z"])
    want = {r.node: (r.n, r.avg, r.hi, r.lo) for r in p.groupBy("node").agg(F.count("*").alias("n"), F.avg("d").alias("avg"), F.max("d").alias("hi"), F.min("d").alias("lo")).collect()}
    got = {r.node: (r.n, r.avg, r.hi, r.lo) for r in similarity.matrix_summary(df, ["node"], "row_id", ["x", "z"], ["c"]).collect()}
    assert set(got) == set(want) == {"a", "b", "c"} and got["c"][3] == 0
    assert all(np.allclose(got[g], want[g], atol=1e-9) for g in want)


def test_columns_of_one_value_fill_no_bin(spark, monkeypatch):
    """A column that a candidate didn't draw adds nothing to distances, and its rows aren't sorted in one bin."""
    seen = []
    monkeypatch.setattr(similarity, "before", lambda df, *a, own=similarity.before, **k: seen.append(sorted({r.col for r in df.select("col").distinct().collect()})) or own(df, *a, **k))
    rows = [(i, 1, i % 2, float(i * i % 53), 0.1) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, g int, cl int, x double, same double")
    s = {r.k: r.s for r in similarity.silhouettes(df, ["g"], "k", ["x", "same"], []).collect()}
    alone = {r.k: r.s for r in similarity.silhouettes(df, ["g"], "k", ["x"], []).collect()}
    assert all(abs(s[k] - alone[k]) < 1e-9 for k in alone) and len(s) == 60
    avg = [similarity.average_distance(df, ["g"], "k", c, []).first().avg * len(c) for c in (["x", "same"], ["x"])]
    assert abs(avg[0] - avg[1]) < 1e-9
    assert seen == [["x"]] * 4
    flat = similarity.silhouettes(df.select("k", "g", "cl", "same"), ["g"], "k", ["same"], []).collect()
    assert len(flat) == 60 and all(r.s == 0 for r in flat)
    assert similarity.average_distance(df, ["g"], "k", ["same"], []).first().avg == 0
