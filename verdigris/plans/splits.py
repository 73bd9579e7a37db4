"""Seeded clustering, split scores and threshold searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions.expressions import r6
from verdigris.operators import clustering as C
from verdigris.operators import spectral
from verdigris.operators import splits as P
from verdigris.plans.registry import query
from verdigris.plans.similarity import MIXED, RANGE
from verdigris.sources import tables as T
from verdigris.sources.shared import cut

X, K, Y, M = T.NUMERIC, T.CATEGORICAL, T.LABELS, T.MASKED


def _cos(a: str, b: str) -> str:
    dot = " + ".join(f"{a}.y{i} * {b}.y{i}" for i in range(5))
    na, nb = (" + ".join(f"{t}.y{i}" for i in range(5)) for t in (a, b))
    return f"(1 - coalesce(({dot}) / nullif(sqrt({na}) * sqrt({nb}), 0), 0))"


def _gower(x: str, t: str) -> str:
    return MIXED.replace("a.", f"{x}.").replace(" b.", f" {t}.")


_SAME = " AND ".join(f"a.y{i} = b.y{i}" for i in range(5))
SEEDS = f"""{RANGE},
lv AS (SELECT node, y0, y1, y2, y3, y4, max(row_id) AS k, min(row_id) AS k0, count(*) AS n FROM cm WHERE sup GROUP BY ALL),
lp AS (SELECT a.node, a.k AS ka, CASE WHEN {_SAME} THEN a.k0 ELSE b.k END AS kb, CASE WHEN {_SAME} AND a.n = 1 THEN 0 ELSE round({_cos('a', 'b')}, 9) END AS d FROM lv a JOIN lv b ON a.node = b.node),
far AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node, ka ORDER BY d DESC, kb DESC) AS r FROM lp) WHERE r = 1),
ab AS (SELECT node AS an, ka, kb FROM (SELECT node, ka, kb, row_number() OVER (PARTITION BY node ORDER BY d DESC, ka DESC, kb DESC) AS r FROM far) WHERE r = 1 AND ka <> kb),
w AS (SELECT x.node, x.row_id, ka, kb, round(0.7 + 0.3 * {_gower('x', 'p')} + 0.7 * {_cos('x', 'p')}, 9) AS wa, round(0.7 + 0.3 * {_gower('x', 'q')} + 0.7 * {_cos('x', 'q')}, 9) AS wb
 FROM cm x JOIN ab ON an = x.node JOIN cm p ON p.row_id = ka JOIN cm q ON q.row_id = kb JOIN rg ON rn = x.node WHERE x.sup),
fs AS (SELECT node AS fn, row_id AS seed, wb AS wseed FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY wa DESC, row_id DESC) AS r FROM w WHERE row_id <> ka) WHERE r = 1),
rest AS (SELECT w.*, seed, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY node) AS n, avg(wa) OVER (PARTITION BY node ORDER BY wb, row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m0,
 (wseed + coalesce(sum(wb) OVER (PARTITION BY node ORDER BY wb, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / row_number() OVER o AS m1 FROM w JOIN fs ON fn = node WHERE row_id <> kb WINDOW o AS (PARTITION BY node ORDER BY wb, row_id)),
stp AS (SELECT node AS sn, coalesce(min(CASE WHEN i >= 1 AND i <= n - 2 AND round(m0, 6) > round(m1, 6) THEN i END), max(greatest(n - 2, 0))) AS stop FROM rest GROUP BY node),
seeds AS (SELECT node, row_id, CASE WHEN row_id = seed OR i < stop THEN 1 ELSE 0 END AS cl, i = n - 1 AS centre0, CASE WHEN stop > 0 THEN i = stop - 1 ELSE row_id = seed END AS centre1 FROM rest JOIN stp ON sn = node
 UNION ALL SELECT DISTINCT node, seed, 1, false, stop = 0 FROM rest JOIN stp ON sn = node WHERE seed = kb)"""
ASSIGNED = f"""{SEEDS},
asg AS (SELECT x.*, coalesce(s.cl, CASE WHEN round({_gower('x', 'q')}, 9) < round({_gower('x', 'p')}, 9) THEN 1 ELSE 0 END) AS cl
 FROM cm x JOIN seeds c0 ON c0.centre0 AND c0.node = x.node JOIN seeds c1 ON c1.centre1 AND c1.node = x.node JOIN cm p ON p.row_id = c0.row_id JOIN cm q ON q.row_id = c1.row_id JOIN rg ON rn = x.node
 LEFT JOIN seeds s ON s.row_id = x.row_id)"""


def rows(spark, sf):
    """Read by many joins of one plan, so computed once."""
    return cut(T.customer_ml(spark, sf).select("row_id", "node", "sup", *X, *K, *Y))


def assigned(spark, sf):
    df = rows(spark, sf)
    return cut(C.assign(df, cut(C.seed(df, ["node"], "row_id", X, K, Y)), ["node"], "row_id", X, K))


@query("c1_seeded_clusters", f"WITH {SEEDS} SELECT node, row_id, cl, centre0, centre1 FROM seeds")
def c1(spark, sf):
    return C.seed(rows(spark, sf), ["node"], "row_id", X, K, Y)


@query("w5_transfer_stop", f"WITH {SEEDS} SELECT sn AS node, CAST(stop AS INTEGER) AS stop FROM stp")
def w5(spark, sf):
    return C.seed(rows(spark, sf), ["node"], "row_id", X, K, Y, stops_only=True)


@query("c2_assignments", f"WITH {ASSIGNED} SELECT row_id, node, cl FROM asg")
def c2(spark, sf):
    return assigned(spark, sf).select("row_id", "node", "cl")


_BAL = " + ".join(f"coalesce(least(count(CASE WHEN y{i} = 1 THEN 1 END), count(CASE WHEN y{i} = 0 THEN 1 END)) / nullif(greatest(count(CASE WHEN y{i} = 1 THEN 1 END), count(CASE WHEN y{i} = 0 THEN 1 END)), 0), 0)" for i in range(5))


@query("c3_example_balance", f"SELECT node, round(({_BAL}) / 5, 6) AS balance, round(1 - ({_BAL}) / 5, 6) AS inverse FROM cm WHERE sup GROUP BY node")
def c3(spark, sf):
    b = C.example_balance(rows(spark, sf).where("sup"), ["node"], Y)
    return b.select("node", F.round("balance", 6).alias("balance"), F.round(1 - F.col("balance"), 6).alias("inverse"))


@query("c5_old_balance", "SELECT node, round((sum(y0) + sum(y1) + sum(y2) + sum(y3) + sum(y4)) / 5 / greatest(sum(y0), sum(y1), sum(y2), sum(y3), sum(y4)), 6) AS balance FROM cm WHERE sup GROUP BY node")
def c5(spark, sf):
    return C.old_balance(rows(spark, sf).where("sup"), ["node"], Y).select("node", F.round("balance", 6).alias("balance"))


_SCORE = f"""WITH {ASSIGNED},
sz AS (SELECT node, count(CASE WHEN cl = 0 THEN 1 END) AS n0, count(CASE WHEN cl = 1 THEN 1 END) AS n1, count(CASE WHEN cl = 0 AND sup THEN 1 END) AS s0, count(CASE WHEN cl = 1 AND sup THEN 1 END) AS s1 FROM asg GROUP BY node),
ok AS (SELECT * FROM sz WHERE s0 > 2 AND s1 > 2),
gp AS (SELECT a.node, a.row_id AS a, b.row_id AS b, a.cl AS ca, b.cl AS cb, a.sup AND b.sup AS bsup, {MIXED} AS d, {_cos('a', 'b')} AS l FROM asg a JOIN asg b ON a.node = b.node AND a.row_id < b.row_id JOIN rg ON rn = a.node),
lab AS (SELECT node, avg(l) AS l FROM (SELECT node, ca, avg(l) AS l FROM gp WHERE ca = cb AND bsup GROUP BY node, ca) GROUP BY node),
bal AS (SELECT node, avg(b) AS bal FROM (SELECT node, cl, ({_BAL}) / 5 AS b FROM asg WHERE sup GROUP BY node, cl) GROUP BY node),
sym AS (SELECT node, a, b, ca, cb, d FROM gp UNION ALL SELECT node, b, a, cb, ca, d FROM gp),
sr AS (SELECT node, a, coalesce(sum(CASE WHEN ca = cb THEN d END) / nullif(count(CASE WHEN ca = cb THEN 1 END), 0), 1) AS x, sum(CASE WHEN ca <> cb THEN d END) / count(CASE WHEN ca <> cb THEN 1 END) AS y FROM sym GROUP BY node, a),
sl AS (SELECT node, avg((y - x) / greatest(x, y)) AS s FROM sr GROUP BY node),
rs AS (SELECT node, cl, min(x1) AS l1, max(x1) AS h1, min(x2) AS l2, max(x2) AS h2, min(x3) AS l3, max(x3) AS h3 FROM asg GROUP BY node, cl),
fd AS (SELECT node, avg(m) AS f FROM (SELECT a.node, a.cl, avg({MIXED}) AS m FROM asg a JOIN asg b ON a.node = b.node AND a.cl = b.cl AND a.row_id < b.row_id JOIN rs ON rs.node = a.node AND rs.cl = a.cl GROUP BY a.node, a.cl) GROUP BY node),
ind AS (SELECT node, corr(x1, x2) ** 2 + corr(x1, x3) ** 2 + corr(x2, x3) ** 2 AS r2 FROM asg GROUP BY node)"""


_MATRIX = """, mq AS (SELECT node, ca, a, b, d FROM gp WHERE ca = cb), mf AS (SELECT c, max(d) AS far FROM (SELECT a AS c, d FROM mq UNION ALL SELECT b, d FROM mq) GROUP BY c),
mx AS (SELECT node, avg(f) AS f FROM (SELECT node, ca, avg(d / (far + 1e-5)) AS f FROM mq JOIN mf ON mf.c = mq.a GROUP BY node, ca) GROUP BY node)"""


@query("c6_split_score", f"""{_SCORE}{_MATRIX} SELECT ok.node, round((1 - l + least(s0, s1) / greatest(s0, s1) + least(s0 / n0, s1 / n1) / greatest(s0 / n0, s1 / n1) + bal + (s + 1) / 2 + 1 - r2 / 3 + 1 - f) / 7, 6) AS score
FROM ok JOIN lab USING (node) JOIN bal USING (node) JOIN sl USING (node) JOIN mx USING (node) JOIN ind USING (node)""")
def c6(spark, sf):
    return C.option_scores(assigned(spark, sf), ["node"], "row_id", X, K, Y, matrix=True).select("node", F.round("score", 6).alias("score"))


@query("c6_split_terms_legacy", f"""{_SCORE} SELECT ok.node, round(1 - l, 6) AS labels, round(1 - bal, 6) AS example_balance, round((s + 1) / 2, 6) AS silhouette, round(1 - (3 + r2) / 3, 6) + 0.0 AS independence, round(1 - f, 6) AS features
FROM ok JOIN lab USING (node) JOIN bal USING (node) JOIN sl USING (node) JOIN fd USING (node) JOIN ind USING (node)""")
def c6_legacy(spark, sf):
    s = C.option_scores(assigned(spark, sf), ["node"], "row_id", X, K, Y, legacy=True)
    return s.select("node", *(r6(F.col(c)).alias(c) for c in ("labels", "example_balance", "silhouette", "independence", "features")))


@query("c17_legacy_scores", f"""{_SCORE} SELECT ok.node, round(0.4 * l + 0.3 * (1 - bal) + 0.2 * (1 - least(s0, s1) / greatest(s0, s1)) + 0.1 * (1 - (s + 1) / 2), 6) AS minimised
FROM ok JOIN lab USING (node) JOIN bal USING (node) JOIN sl USING (node)""")
def c17(spark, sf):
    s = C.option_scores(assigned(spark, sf), ["node"], "row_id", X, K, Y)
    t = lambda c: 1 - F.col(c)
    return s.select("node", F.round(0.4 * t("labels") + 0.3 * t("example_balance") + 0.2 * t("count_balance") + 0.1 * t("silhouette"), 6).alias("minimised"))


@query("c18_inverted_silhouette", f"""{_SCORE} SELECT ok.node, round((1 - l + 1 - (s + 1) / 2 + 1 - (abs(corr_a) + abs(corr_b) + abs(corr_c)) / 3) / 3, 6) AS score
FROM ok JOIN lab USING (node) JOIN sl USING (node) JOIN (SELECT node, corr(x1, x2) AS corr_a, corr(x1, x3) AS corr_b, corr(x2, x3) AS corr_c FROM asg GROUP BY node) USING (node)""")
def c18(spark, sf):
    df = assigned(spark, sf)
    s = C.option_scores(df, ["node"], "row_id", X, K, Y)
    pair = lambda a, b: C.squared_correlations(df, ["node"], [a, b]).select("node", F.sqrt("_r2").alias(f"{a}{b}"))
    for a, b in (("x1", "x2"), ("x1", "x3"), ("x2", "x3")):
        s = s.join(pair(a, b), "node")
    return s.select("node", F.round((F.col("labels") + 1 - F.col("silhouette") + 1 - (F.col("x1x2") + F.col("x1x3") + F.col("x2x3")) / 3) / 3, 6).alias("score"))


@query("c11_variance_reduction", """WITH v AS (SELECT node, col, v, count(*) AS n, sum(y0) AS s FROM (SELECT xl.node, col, v, y0 FROM xl JOIN cm USING (row_id)) GROUP BY ALL),
p AS (SELECT node, col, v, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER g AS tn, sum(s) OVER g AS ts FROM v WINDOW w AS (PARTITION BY node, col ORDER BY v), g AS (PARTITION BY node, col)),
q AS (SELECT node, col, v, round((ts / tn - (ts / tn) ** 2) - ln / tn * (ls / ln - (ls / ln) ** 2) - (1 - ln / tn) * ((ts - ls) / (tn - ln) - ((ts - ls) / (tn - ln)) ** 2), 6) AS gain FROM p WHERE ln > 1 AND tn - ln > 1)
SELECT node, col, v AS cut, gain FROM (SELECT *, row_number() OVER (PARTITION BY node, col ORDER BY gain DESC, v) AS r FROM q) WHERE r = 1""")
def c11(spark, sf):
    return P.variance_reduction(rows(spark, sf), ["node"], "row_id", X, "y0")


def _pull(x: str, near: str, far: str) -> str:
    return f"coalesce((abs({x} - {far}) - abs({x} - {near})) / nullif(greatest(abs({x} - {far}), abs({x} - {near})), 0), 0)"


def _means_sql(left: str) -> str:
    return f"""WITH o AS (SELECT node, col, v, row_number() OVER w AS k, sum(v) OVER w AS cs, lead(v) OVER w AS nx, nth_value(v, 2) OVER a AS second, count(*) OVER g AS n, sum(v) OVER g AS t, min(v) OVER g AS lo, max(v) OVER g AS hi FROM xl
 WINDOW w AS (PARTITION BY node, col ORDER BY v, row_id), a AS (PARTITION BY node, col ORDER BY v, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), g AS (PARTITION BY node, col)),
m AS (SELECT *, {left} / k AS lm, (t - ({left})) / (n - k) AS rm FROM o WHERE k >= 2 AND k <= n - 2),
q AS (SELECT node, col, v AS cut, k, lm, rm, round((k * ({_pull('lo', 'lm', 'rm')} + {_pull('v', 'lm', 'rm')}) + (n - k) * ({_pull('nx', 'rm', 'lm')} + {_pull('hi', 'rm', 'lm')})) / 2 / n, 9) AS q1 FROM m),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node, col ORDER BY q1 DESC, k) AS r FROM q WHERE q1 > 0) WHERE r = 1)
SELECT xl.node, xl.col, any_value(cut) AS cut, round(avg(CASE WHEN v <= cut THEN {_pull('v', 'lm', 'rm')} ELSE {_pull('v', 'rm', 'lm')} END), 6) AS quality FROM xl JOIN b ON b.node = xl.node AND b.col = xl.col GROUP BY xl.node, xl.col"""


@query("c9_running_means", _means_sql("cs"))
def c9(spark, sf):
    return P.running_means(rows(spark, sf), ["node"], "row_id", X)


@query("c9_running_means_legacy", _means_sql("(cs - v + second)"))
def c9_legacy(spark, sf):
    return P.running_means(rows(spark, sf), ["node"], "row_id", X, legacy=True)


@query("c10_route_by_cut", "SELECT row_id, CASE WHEN x1 <= (SELECT avg(x1) FROM cm) THEN 0 ELSE 1 END AS side FROM cm")
def c10(spark, sf):
    df = T.customer_ml(spark, sf)
    return df.join(F.broadcast(df.agg(F.avg("x1").alias("cut")))).select("row_id", F.when(F.col("x1") <= F.col("cut"), 0).otherwise(1).alias("side"))  # one row


def _purity_sql(cuts: str, pick: str, labels: int = 5, factor: str = "1") -> str:
    """Sides, purity and last row of each cut; the formula of a side is |zeros - ones| / (rows + 1e-6)."""
    side = lambda cond, n: " + ".join(f"abs(count(CASE WHEN {cond} AND y{i} = 0 THEN 1 END) - count(CASE WHEN {cond} AND y{i} = 1 THEN 1 END)) / ({n} + 1e-6)" for i in range(labels))
    nl, nr = "count(CASE WHEN x1 <= cut THEN 1 END)", "count(CASE WHEN x1 > cut THEN 1 END)"
    return f"""WITH cuts AS ({cuts}), q AS (SELECT cm.node, cut, ({side('x1 <= cut', nl)} + {side('x1 > cut', nr)}) / {2 * labels} * {factor.format(nl=nl, nr=nr)} AS purity, {nl} AS nl, {nr} AS nr, last(row_id ORDER BY x1, row_id) FILTER (WHERE x1 <= cut) AS last
 FROM cm JOIN cuts ON cuts.node = cm.node WHERE sup GROUP BY cm.node, cut) {pick}"""


#: The best cut of two sides that hold rows, the greatest of equal ones.
_LATER = "SELECT node, last, {cut}round(purity, 6) AS purity, round(abs(nl - nr) / (nl + nr), 6) AS symmetry FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY round(purity, 6) DESC, cut DESC) AS r FROM q WHERE nl > 0 AND nr > 0) {join} WHERE r = 1"
_WIDTH = "SELECT node, lo + i * (hi - lo) / 20 AS cut FROM (SELECT node, min(x1) AS lo, max(x1) AS hi FROM cm WHERE sup GROUP BY node), (SELECT unnest(range(1, 20)) AS i)"


@query("c12_purity", _purity_sql("SELECT node, avg(x1) AS cut FROM cm WHERE sup GROUP BY node", "SELECT node, round(purity, 6) AS purity FROM q", 1))
def c12(spark, sf):
    """By the first label."""
    df = rows(spark, sf).where("sup")
    return P.purity(df, ["node"], "row_id", "x1", df.groupBy("node").agg(F.avg("x1").alias("cut")), Y[:1]).select("node", F.round("purity", 6).alias("purity"))


@query("c13_best_purity", _purity_sql("SELECT DISTINCT node, x1 AS cut FROM cm WHERE sup", "SELECT node, cut, purity FROM (SELECT node, cut, round(purity, 6) AS purity, row_number() OVER (PARTITION BY node ORDER BY round(purity, 6) DESC, cut) AS r FROM q) WHERE r = 1", 1))
def c13(spark, sf):
    """Over every value of the column, by the first label: counts of the smaller values come from prefix sums, not from a
    row-by-cut join."""
    return P.best(P.purity_at_values(rows(spark, sf).where("sup"), ["node"], "row_id", "x1", Y[:1]), ["node"], "purity")


def _later(p):
    """The best cut with rows on both sides, ties to the greatest."""
    return P.best(p.where("n_left > 0 AND n_right > 0"), ["node"], "purity", True, ("last", "symmetry")).withColumn("symmetry", F.round("symmetry", 6))


@query("c14_purity_at_rank_steps", _purity_sql("SELECT DISTINCT node, x1 AS cut FROM (SELECT node, x1, row_number() OVER (PARTITION BY node ORDER BY x1, row_id) - 1 AS k, count(*) OVER (PARTITION BY node) AS n FROM cm WHERE sup) WHERE k % greatest(n // 10, 1) = 0", _LATER.format(cut="cut, ", join="")))
def c14(spark, sf):
    df = rows(spark, sf).where("sup")
    return _later(P.purity(df, ["node"], "row_id", "x1", P.rank_step_cuts(df, ["node"], "row_id", "x1"), Y))


@query("c15_purity_at_widths", _purity_sql(_WIDTH, _LATER.format(cut="round(cut, 6) AS cut, round(cut - lo, 6) AS above_least, ", join="JOIN (SELECT node, min(x1) AS lo FROM cm WHERE sup GROUP BY node) USING (node)"), 5, "({nr} + 1e-6) / ({nl} + {nr} + 2e-6)"))
def c15(spark, sf):
    """cut, and above_least: the threshold counted from the column's least value."""
    df = rows(spark, sf).where("sup")
    p = _later(P.purity(df, ["node"], "row_id", "x1", P.equal_width_cuts(df, ["node"], "x1"), Y, by_size=True))
    least = df.groupBy("node").agg(F.min("x1").alias("lo"))
    return p.join(least, "node").select("node", "last", F.round("cut", 6).alias("cut"), F.round(F.col("cut") - F.col("lo"), 6).alias("above_least"), "purity", "symmetry")


@query("c16_best_column", """WITH v AS (SELECT node, col, v, count(*) AS n, sum(y0) AS s FROM (SELECT xl.node, col, v, y0 FROM xl JOIN cm USING (row_id)) GROUP BY ALL),
p AS (SELECT node, col, v, sum(n) OVER w AS ln, sum(s) OVER w AS ls, sum(n) OVER g AS tn, sum(s) OVER g AS ts FROM v WINDOW w AS (PARTITION BY node, col ORDER BY v), g AS (PARTITION BY node, col)),
q AS (SELECT node, col, v, round((ts / tn - (ts / tn) ** 2) - ln / tn * (ls / ln - (ls / ln) ** 2) - (1 - ln / tn) * ((ts - ls) / (tn - ln) - ((ts - ls) / (tn - ln)) ** 2), 6) AS gain FROM p WHERE ln > 1 AND tn - ln > 1)
SELECT node, col, cut, gain FROM (SELECT node, col, v AS cut, gain, row_number() OVER (PARTITION BY node ORDER BY gain DESC, col, v) AS r FROM q) WHERE r = 1""")
def c16(spark, sf):
    v = P.variance_reduction(rows(spark, sf), ["node"], "row_id", X, "y0")
    return v.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("g"), "col", "cut")).alias("x")).select("node", "x.col", "x.cut", (-F.col("x.g")).alias("gain"))


@query("c8_spectral_sides")
def c8(spark, sf):
    """Two-way spectral sides of each node's rows over all numbers; held against dense eigenvectors in tests."""
    return spectral.sides(rows(spark, sf), ["node"], "row_id", X)


@query("o4_related_columns", """WITH c AS (SELECT 'x2' AS col, abs(corr(x1, x2)) AS r FROM cm UNION ALL SELECT 'x3', abs(corr(x1, x3)) FROM cm) SELECT col, round(r, 6) AS r, row_number() OVER (ORDER BY r DESC, col) AS place FROM c""")
def o4(spark, sf):
    """The other columns in the order of their relation to a start column."""
    from pyspark.sql import Window

    from verdigris.operators import tabular

    r = tabular.correlations(rows(spark, sf), X).where("a = 'x1'").select(F.col("b").alias("col"), F.round(F.abs("r"), 6).alias("r"))
    return r.withColumn("place", F.row_number().over(Window.orderBy(F.desc("r"), "col")))
