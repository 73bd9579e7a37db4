"""Scans, projections, joins, aggregates, samples and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdigris.operators import parameters, sampling, stratify, tabular
from verdigris.plans.registry import query
from verdigris.sources import tables as T

Y, M, X = T.LABELS, T.MASKED, T.NUMERIC


@query("s1_scan", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def s1(spark, sf):
    return T.table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice")


@query("s2_rename_and_flags", """SELECT row_id AS col_0, x1 AS col_1, c1 AS col_2, CAST(sup AS INTEGER) AS label_0, y0 AS label_1 FROM cm""")
def s2(spark, sf):
    return T.labelled_columns(T.customer_ml(spark, sf).select("row_id", "x1", "c1", "sup", "y0"), ["sup", "y0"])


@query("s10_train_test_split", """SELECT row_id, CASE WHEN row_number() OVER (PARTITION BY concat_ws('', y0, y1, y2, y3, y4) ORDER BY md5(concat_ws('|', 'split', row_id)), row_id)
  <= floor(0.3 * count(*) OVER (PARTITION BY concat_ws('', y0, y1, y2, y3, y4))) THEN 'test' ELSE 'train' END AS part FROM cm""")
def s10(spark, sf):
    return sampling.hold_out(T.customer_ml(spark, sf), Y, 0.3, "split")


@query("p1_features", "SELECT row_id, node, c1, x1, x2, x3 FROM cm")
def p1(spark, sf):
    return tabular.features(T.customer_ml(spark, sf), [*Y, *M, "sup"])


@query("p2_downcast", "SELECT row_id, CAST(CAST(x1 AS FLOAT) AS DOUBLE) AS x1, CAST(CAST(x2 AS FLOAT) AS DOUBLE) AS x2, CAST(y0 AS INTEGER) AS y0 FROM cm")
def p2(spark, sf):
    d = tabular.downcast(T.customer_ml(spark, sf), ["y0"], ["x1", "x2"])
    return d.select("row_id", F.col("x1").cast("double").alias("x1"), F.col("x2").cast("double").alias("x2"), F.col("y0").cast("int").alias("y0"))


@query("p3_low_cardinality", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS p_size, p_retailprice FROM part")
def p3(spark, sf):
    return tabular.low_cardinality_to_string(T.table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"], 60)


@query("p4_categorical_columns", "SELECT * FROM (VALUES ('node', 1), ('c1', 2)) t(name, place)")
def p4(spark, sf):
    df = T.customer_ml(spark, sf).select("row_id", "node", "c1", "x1")
    found = tabular.categorical_positions(df, df.columns)
    return df.select(F.explode(F.array(*(F.struct(F.lit(df.columns[i]).alias("name"), F.lit(i).alias("place")) for i in found))).alias("s")).distinct().select("s.*")


@query("p5_encode", "SELECT row_id, CAST(dense_rank() OVER (ORDER BY c1) - 1 AS DOUBLE) AS c1 FROM cm")
def p5(spark, sf):
    df = T.customer_ml(spark, sf).select("row_id", "c1")
    return tabular.encode(df, "c1", tabular.encoding(df, "c1")).select("row_id", F.col("c1").cast("double").alias("c1"))


@query("p6_encode_unseen", """SELECT cm.row_id, CAST(e.code AS DOUBLE) AS c1 FROM cm LEFT JOIN
  (SELECT c1, dense_rank() OVER (ORDER BY c1) - 1 AS code FROM (SELECT DISTINCT c1 FROM cm WHERE x1 > 5000 AND c1 < '2')) e ON cm.c1 = e.c1""")
def p6(spark, sf):
    df = T.customer_ml(spark, sf)
    codes = tabular.encoding(df.where("x1 > 5000 AND c1 < '2'"), "c1")
    return tabular.encode(df.select("row_id", "c1"), "c1", codes).select("row_id", F.col("c1").cast("double").alias("c1"))


@query("p7_mask", "SELECT row_id, CASE WHEN x1 < 0 THEN -1 ELSE y0 END AS y0, CASE WHEN x1 < 0 THEN -1 ELSE y1 END AS y1 FROM cm")
def p7(spark, sf):
    return tabular.mask(T.customer_ml(spark, sf).select("row_id", "x1", "y0", "y1"), ["y0", "y1"], F.col("x1") < 0).select("row_id", "y0", "y1")


@query("p8_supervised", "SELECT row_id, label_0, label_1 FROM dm WHERE label_0 <> -1")
def p8(spark, sf):
    return tabular.supervised(T.docs_ml(spark, sf), "label_0").select("row_id", "label_0", "label_1")


@query("p9_varying_columns", """SELECT node, col FROM (SELECT c1 AS node, 'node' AS col, count(DISTINCT node) AS n FROM cm GROUP BY c1 UNION ALL SELECT c1, 'x2', count(DISTINCT x2) FROM cm GROUP BY c1
  UNION ALL SELECT c1, 'y0', count(DISTINCT y0) FROM cm GROUP BY c1 UNION ALL SELECT c1, 'c1', count(DISTINCT c1) FROM cm GROUP BY c1) WHERE n > 1""")
def p9(spark, sf):
    df = T.customer_ml(spark, sf).select(F.col("c1").alias("g"), "node", "x2", "y0", "c1")
    return tabular.varying_columns(df, ["g"], ["node", "x2", "y0", "c1"]).select(F.col("g").alias("node"), "col")


@query("p10_one_hot", """WITH o AS (SELECT label, row_number() OVER (ORDER BY min(vec_id)) - 1 AS i FROM embeddings GROUP BY label)
SELECT vec_id, CAST(i = 0 AS INTEGER) AS label_0, CAST(i = 1 AS INTEGER) AS label_1, CAST(i = 2 AS INTEGER) AS label_2, CAST(i = 3 AS INTEGER) AS label_3, CAST(i = 4 AS INTEGER) AS label_4,
 CAST(i = 5 AS INTEGER) AS label_5, CAST(i = 6 AS INTEGER) AS label_6, CAST(i = 7 AS INTEGER) AS label_7, CAST(i = 8 AS INTEGER) AS label_8, CAST(i = 9 AS INTEGER) AS label_9
FROM embeddings JOIN o USING (label)""", views=True)
def p10(spark, sf):
    return tabular.one_hot(T.table(spark, sf, "embeddings"), "label", "vec_id")


@query("p11_labels_by_name", """SELECT 'o_orderstatus' AS col, count(DISTINCT o_orderstatus) AS n_distinct FROM orders UNION ALL SELECT 'o_totalprice', count(DISTINCT o_totalprice) FROM orders UNION ALL SELECT 'o_orderdate', count(DISTINCT o_orderdate) FROM orders
UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority) FROM orders""")
def p11(spark, sf):
    """The columns whose names hold one text and lack another, with how many values each has."""
    t = T.table(spark, sf, "orders")
    return tabular.distinct_counts(t, parameters.labels_by_name(t.columns, "o_", "key"))


@query("p12_min_max", "SELECT row_id, round((x1 - (SELECT min(x1) FROM cm)) / (SELECT max(x1) - min(x1) FROM cm), 6) AS x1, round((x3 - (SELECT min(x3) FROM cm)) / (SELECT max(x3) - min(x3) FROM cm), 6) AS x3 FROM cm")
def p12(spark, sf):
    out = tabular.min_max(T.customer_ml(spark, sf).select("row_id", "x1", "x3"), ["x1", "x3"], "row_id")
    return out.select("row_id", F.round("x1", 6).alias("x1"), F.round("x3", 6).alias("x3"))


@query("p13_recode", "SELECT row_id, CASE WHEN m0 = -1 THEN 0 ELSE m0 END AS zero, CASE WHEN m0 = -1 THEN 0 ELSE 1 END AS labelled FROM cm")
def p13(spark, sf):
    return T.customer_ml(spark, sf).select("row_id", F.when(F.col("m0") == -1, 0).otherwise(F.col("m0")).alias("zero"), F.when(F.col("m0") == -1, 0).otherwise(1).alias("labelled"))


@query("p14_threshold", "SELECT row_id, label, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END AS pred FROM sc")
def p14(spark, sf):
    return T.scores(spark, sf).select("row_id", "label", F.when(F.col("prob") >= 0.5, 1).otherwise(0).alias("pred"))


@query("p15_composite_id", "SELECT DISTINCT concat_ws('_', tree, leaf) AS id, tree, leaf FROM act")
def p15(spark, sf):
    return T.scores(spark, sf, 3).select(F.concat_ws("_", "tree", "leaf").alias("id"), "tree", "leaf").distinct()


@query("j2_lookup", "SELECT act.tree, act.leaf, cm.row_id, cm.x1 FROM (SELECT DISTINCT tree, leaf, row_id FROM act) act JOIN cm ON act.row_id = cm.row_id")
def j2(spark, sf):
    member = T.scores(spark, sf, 3).select("tree", "leaf", "row_id").distinct()
    return member.join(T.customer_ml(spark, sf).select("row_id", "x1"), "row_id").select("tree", "leaf", "row_id", "x1")


@query("j3_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j3(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", "source").join(T.table(spark, sf, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query("j4_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j4(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", "source").join(T.table(spark, sf, "labels"), "doc_id", "left_anti")


@query("j5_left", """SELECT d.source, count(*) AS n, count(l.quality) AS n_labelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.source""")
def j5(spark, sf):
    d = T.table(spark, sf, "documents").select("doc_id", "source").join(T.table(spark, sf, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count("quality").alias("n_labelled"))


@query("j8_concat", "SELECT cm.row_id, cm.x1, s.p0, s.p1 FROM cm JOIN (SELECT row_id, max(CASE WHEN label = 0 THEN prob END) AS p0, max(CASE WHEN label = 1 THEN prob END) AS p1 FROM sc GROUP BY row_id) s ON cm.row_id = s.row_id")
def j8(spark, sf):
    s = T.scores(spark, sf).groupBy("row_id").agg(F.max(F.when(F.col("label") == 0, F.col("prob"))).alias("p0"), F.max(F.when(F.col("label") == 1, F.col("prob"))).alias("p1"))
    return T.customer_ml(spark, sf).select("row_id", "x1").join(s, "row_id")


@query("a1_positive_rates", "SELECT label, round(avg(CASE WHEN m >= 0 THEN m END), 6) AS rate, count(CASE WHEN m >= 0 THEN 1 END) AS n FROM yl GROUP BY label")
def a1(spark, sf):
    return tabular.positive_rates(T.customer_ml(spark, sf), M).withColumn("rate", F.round("rate", 6))


@query("a2_label_distribution", "SELECT label, round(avg(y), 6) AS all_rows, round(avg(CASE WHEN sup THEN y END), 6) AS supervised FROM yl GROUP BY label")
def a2(spark, sf):
    every, sup = tabular.positive_rates(T.customer_ml(spark, sf), Y), tabular.positive_rates(T.customer_ml(spark, sf), M)
    return every.select("label", F.round("rate", 6).alias("all_rows")).join(sup.select("label", F.round("rate", 6).alias("supervised")), "label")


@query("a3_distinct_counts", "SELECT 'c1' AS col, count(DISTINCT c1) AS n_distinct FROM cm UNION ALL SELECT 'x1', count(DISTINCT x1) FROM cm UNION ALL SELECT 'x2', count(DISTINCT x2) FROM cm")
def a3(spark, sf):
    return tabular.distinct_counts(T.customer_ml(spark, sf), ["c1", "x1", "x2"])


@query("a5_correlations", "SELECT 'x1' AS a, 'x2' AS b, round(corr(x1, x2), 6) AS r FROM cm UNION ALL SELECT 'x1', 'x3', round(corr(x1, x3), 6) FROM cm UNION ALL SELECT 'x2', 'x3', round(corr(x2, x3), 6) FROM cm")
def a5(spark, sf):
    return tabular.correlations(T.customer_ml(spark, sf), X).withColumn("r", F.round("r", 6))


@query("a6_independence", """WITH c AS (SELECT corr(x1, x2) AS a, corr(x1, x3) AS b, corr(x2, x3) AS c FROM cm)
SELECT round(1 - (a * a + b * b + c * c) / 3, 6) AS score, round(1 - (3 + a * a + b * b + c * c) / 3, 6) AS legacy FROM c""")
def a6(spark, sf):
    r = tabular.correlations(T.customer_ml(spark, sf), X).agg(F.sum(F.col("r") * F.col("r")).alias("s"))
    return r.select(F.round(1 - F.col("s") / 3, 6).alias("score"), F.round(1 - (3 + F.col("s")) / 3, 6).alias("legacy"))


@query("a7_spearman", """WITH k AS (SELECT rank() OVER (ORDER BY x1) + (count(*) OVER (PARTITION BY x1) - 1) / 2.0 AS x1, rank() OVER (ORDER BY x2) + (count(*) OVER (PARTITION BY x2) - 1) / 2.0 AS x2,
 rank() OVER (ORDER BY x3) + (count(*) OVER (PARTITION BY x3) - 1) / 2.0 AS x3 FROM cm)
SELECT 'x1' AS a, 'x2' AS b, round(corr(x1, x2), 6) AS r FROM k UNION ALL SELECT 'x1', 'x3', round(corr(x1, x3), 6) FROM k UNION ALL SELECT 'x2', 'x3', round(corr(x2, x3), 6) FROM k""")
def a7(spark, sf):
    return tabular.correlations(tabular.average_ranks(T.customer_ml(spark, sf), X, "row_id"), X).withColumn("r", F.round("r", 6))


@query("a8_activation_counts", "SELECT concat_ws('_', tree, leaf) AS id, CAST(sum(CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_pred, count(*) AS n FROM act GROUP BY ALL")
def a8(spark, sf):
    return T.scores(spark, sf, 3).groupBy(F.concat_ws("_", "tree", "leaf").alias("id")).agg(F.sum(F.when(F.col("prob") >= 0.5, 1).otherwise(0)).alias("n_pred"), F.count("*").alias("n"))


@query("a9_leaf_means", "SELECT concat_ws('_', tree, leaf) AS id, label, round(avg(prob), 6) AS mean_prob FROM act GROUP BY ALL")
def a9(spark, sf):
    return T.scores(spark, sf, 3).groupBy(F.concat_ws("_", "tree", "leaf").alias("id"), "label").agg(F.round(F.avg("prob"), 6).alias("mean_prob"))


@query("a11_value_counts", "SELECT node, label, m AS value, count(*) AS n FROM yl GROUP BY ALL")
def a11(spark, sf):
    long = T.customer_ml(spark, sf).select("node", F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(c).alias("value")) for i, c in enumerate(M)))).alias("s"))
    return long.groupBy("node", "s.label", "s.value").agg(F.count("*").alias("n"))


@query("a12_ones_distribution", "SELECT node, label, round(sum(CASE WHEN m = 1 THEN 1 ELSE 0 END) / (sum(CASE WHEN m >= 0 THEN 1 ELSE 0 END) + 1e-5), 6) AS ones FROM yl GROUP BY ALL")
def a12(spark, sf):
    long = T.customer_ml(spark, sf).select("node", F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(c).alias("m")) for i, c in enumerate(M)))).alias("s")).select("node", "s.*")
    return long.groupBy("node", "label").agg(F.round(F.count(F.when(F.col("m") == 1, 1)) / (F.count(F.when(F.col("m") >= 0, 1)) + 1e-5), 6).alias("ones"))


@query("a13_label_totals", "SELECT node, label, count(CASE WHEN m = 1 THEN 1 END) AS ones, count(CASE WHEN m = 0 THEN 1 END) AS zeros, count(CASE WHEN m >= 0 THEN 1 END) AS labelled, count(CASE WHEN m < 0 THEN 1 END) AS unlabelled FROM yl GROUP BY ALL")
def a13(spark, sf):
    long = T.customer_ml(spark, sf).select("node", F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(c).alias("m")) for i, c in enumerate(M)))).alias("s")).select("node", "s.*")
    return long.groupBy("node", "label").agg(*(F.count(F.when(c, 1)).alias(k) for k, c in (("ones", F.col("m") == 1), ("zeros", F.col("m") == 0), ("labelled", F.col("m") >= 0), ("unlabelled", F.col("m") < 0))))


@query("a14_sums_of_squares", "SELECT node, round(sum(x1), 2) AS s, round(sum(x1 * x1) / 1e6, 4) AS q FROM cm GROUP BY node")
def a14(spark, sf):
    return T.customer_ml(spark, sf).groupBy("node").agg(F.round(F.sum("x1"), 2).alias("s"), F.round(F.sum(F.col("x1") * F.col("x1")) / 1e6, 4).alias("q"))


@query("a16_forest_mean", "SELECT row_id, label, round(avg(CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS vote, round(avg(prob), 6) AS prob FROM act GROUP BY ALL")
def a16(spark, sf):
    return T.scores(spark, sf, 3).groupBy("row_id", "label").agg(F.round(F.avg(F.when(F.col("prob") >= 0.5, 1.0).otherwise(0.0)), 6).alias("vote"), F.round(F.avg("prob"), 6).alias("prob"))


@query("a17_final_distribution", "SELECT label, round(sum(prob), 4) AS s, round(avg(prob), 6) AS mean FROM act GROUP BY label")
def a17(spark, sf):
    return T.scores(spark, sf, 3).groupBy("label").agg(F.round(F.sum("prob"), 4).alias("s"), F.round(F.avg("prob"), 6).alias("mean"))


@query("a_rollup_reports", "SELECT tree, leaf, count(*) AS n, round(avg(prob), 6) AS prob FROM act GROUP BY ROLLUP (tree, leaf)")
def a_rollup(spark, sf):
    return T.scores(spark, sf, 3).rollup("tree", "leaf").agg(F.count("*").alias("n"), F.round(F.avg("prob"), 6).alias("prob"))


_DRAWS = """WITH c AS (SELECT node, col FROM xl GROUP BY node, col HAVING max(v) > min(v)), i AS (SELECT unnest(range(20)) AS iter),
r AS (SELECT node, CAST(iter AS INTEGER) AS iter, col, row_number() OVER (PARTITION BY node, iter ORDER BY md5(concat_ws('|', 'cols', node, iter, col)), col) AS r, count(*) OVER (PARTITION BY node, iter) AS n FROM c, i)
SELECT node, iter, col FROM r WHERE r <= ceil(least(n, %s))"""


@query("o3_column_sample", _DRAWS % 2)
def o3(spark, sf):
    """Draws of the columns that vary in each node, two at a time."""
    varying = tabular.varying_columns(T.customer_ml(spark, sf), ["node"], T.NUMERIC)
    return sampling.group_column_draws(varying, ["node"], 2, 20, "cols", linear=True)


@query("o9_log2_column_sample", _DRAWS % "floor(log2(7))")
def o9(spark, sf):
    """The same, log2 of seven at a time."""
    varying = tabular.varying_columns(T.customer_ml(spark, sf), ["node"], T.NUMERIC)
    return sampling.group_column_draws(varying, ["node"], 7, 20, "cols")


@query("o5_inverse_frequency_bag", """WITH tot AS (SELECT count(*) AS n, count(CASE WHEN m0 + m1 + m2 + m3 + m4 > 0 THEN 1 END) AS pos, count(CASE WHEN sup THEN 1 END) AS ns, count(CASE WHEN NOT sup THEN 1 END) AS nu FROM cm),
q AS (SELECT label, count(CASE WHEN m = 1 THEN 1 END) AS nc FROM yl GROUP BY label),
quota AS (SELECT label, CAST(floor(least(floor((1 - nc / pos) * n), nc) * 0.6 + 1e-9) AS BIGINT) AS k FROM q, tot),
pick AS (SELECT row_id FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', 'bag', label, row_id)), row_id) AS r FROM yl WHERE m = 1) p JOIN quota USING (label) WHERE r <= k
 UNION SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY md5(concat_ws('|', 'bag', 'sup', row_id)), row_id) AS r FROM cm WHERE sup), tot WHERE r <= floor(ns * 0.6 + 1e-9)
 UNION SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY md5(concat_ws('|', 'bag', 'unsup', row_id)), row_id) AS r FROM cm WHERE NOT sup), tot WHERE r <= floor(nu * 0.6 + 1e-9))
SELECT row_id FROM pick""")
def o5(spark, sf):
    return sampling.inverse_frequency_bag(T.customer_ml(spark, sf), M, 0.6, "bag")


@query("o7_stratified_folds", """SELECT row_id, CAST((row_number() OVER (PARTITION BY concat_ws('', y0, y1, y2, y3, y4) ORDER BY md5(concat_ws('|', 'fold', row_id)), row_id) - 1) % 5 AS INTEGER) AS fold FROM cm""")
def o7(spark, sf):
    return sampling.folds(T.customer_ml(spark, sf), Y, 5, "fold")


@query("o6_iterative_split")
def o6(spark, sf):
    """30 % of the rows, and of each label's rows, as the test part; held against a plain version in tests."""
    return stratify.parts(T.customer_ml(spark, sf), Y, [0.7, 0.3], "split")


@query("o6_iterative_folds")
def o6_folds(spark, sf):
    return stratify.parts(T.customer_ml(spark, sf), Y, [0.2] * 5, "folds")


@query("o6_split_shares", """WITH n AS (SELECT label, sum(y) AS n FROM yl GROUP BY label UNION ALL SELECT -1, count(*) FROM cm) SELECT CAST(label AS INTEGER) AS label, CAST(n AS BIGINT) AS n, true AS within FROM n""")
def o6_shares(spark, sf):
    """How many rows each label has (-1: all rows), and whether the parts' shares of them are within a row of what is asked for
    (of two where a label's rows are tied to another label's)."""
    df = T.customer_ml(spark, sf)
    p = stratify.parts(df, Y, [0.7, 0.3], "split").join(df, "row_id").groupBy("part").agg(F.count("*").alias("c"), *(F.sum(c).alias(f"c{i}") for i, c in enumerate(Y)))
    long = p.select("part", F.explode(F.array(F.struct(F.lit(-1).alias("label"), F.col("c").alias("n")), *(F.struct(F.lit(i).alias("label"), F.col(f"c{i}").alias("n")) for i in range(len(Y))))).alias("s"))
    share = F.when(F.col("part") == 0, 0.7).otherwise(0.3)
    whole = long.groupBy("s.label").agg(F.sum("s.n").alias("n"))
    return long.select("part", "s.label", F.col("s.n").alias("got")).join(whole, "label").groupBy("label").agg(F.first("n").alias("n"), F.min(F.abs(F.col("got") - F.col("n") * share) <= 2).alias("within"))


@query("o10_sorted_values", "SELECT node, x1, row_number() OVER (PARTITION BY node ORDER BY x1, row_id) AS place FROM cm")
def o10(spark, sf):
    from verdigris.functions.prefix import before

    out = before(T.customer_ml(spark, sf).select("row_id", "node", "x1"), ["node"], "x1", "row_id", {"p": F.lit(1)})
    return out.select("node", "x1", (F.col("p") + 1).alias("place"))


@query("u1_union", "SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 0")
def u1(spark, sf):
    lab = T.table(spark, sf, "labels")
    return lab.where("toxic = 1").select("doc_id").union(lab.where("quality = 0").select("doc_id")).distinct()


@query("u2_intersection", "SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def u2(spark, sf):
    return T.table(spark, sf, "labels").where("toxic = 1").select("doc_id").intersect(T.table(spark, sf, "documents").where("lang = 'en'").select("doc_id"))


@query("u3_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u3(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id").subtract(T.table(spark, sf, "labels").select("doc_id"))


@query("n2_scalars", """SELECT row_id, round(log2(x2 + 1), 6) AS lg, round(sqrt(x2), 6) AS sq, round(exp(-x2 / 10), 6) AS ex, abs(x1) AS ab, round_even(x1, 0) AS he, CAST(floor(x1) AS BIGINT) AS fl,
  greatest(x1, x2) AS hi, least(x1, x2) AS lo, instr(node, 'U') - 1 AS at, rpad(node, 12, '.') AS pad FROM cm""")
def n2(spark, sf):
    d = T.customer_ml(spark, sf)
    return d.select("row_id", F.round(F.log2(F.col("x2") + 1), 6).alias("lg"), F.round(F.sqrt("x2"), 6).alias("sq"), F.round(F.exp(-F.col("x2") / 10), 6).alias("ex"), F.abs("x1").alias("ab"),
                    F.bround("x1", 0).alias("he"), F.floor("x1").alias("fl"), F.greatest("x1", "x2").alias("hi"), F.least("x1", "x2").alias("lo"), (F.instr("node", "U") - 1).alias("at"), F.rpad("node", 12, ".").alias("pad"))


@query("n1_elementwise_and_reduction", "SELECT round(sum(exp(sin(sqrt(abs(x1) + x2)))), 4) AS s FROM cm")
def n1(spark, sf):
    return T.customer_ml(spark, sf).agg(F.round(F.sum(F.exp(F.sin(F.sqrt(F.abs("x1") + F.col("x2"))))), 4).alias("s"))


@query("w8_first_valid_then_best", """WITH c AS (SELECT row_id, label, prob, row_number() OVER (PARTITION BY row_id ORDER BY label) AS k FROM sc WHERE prob >= 0.2)
SELECT row_id, arg_max(label, prob) AS best FROM c WHERE k <= 3 GROUP BY row_id""")
def w8(spark, sf):
    w = Window.partitionBy("row_id").orderBy("label")
    c = T.scores(spark, sf).where("prob >= 0.2").withColumn("k", F.row_number().over(w)).where("k <= 3")
    return c.groupBy("row_id").agg(F.max_by("label", F.struct("prob", -F.col("label"))).alias("best"))

