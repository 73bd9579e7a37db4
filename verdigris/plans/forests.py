"""Trees, leaves and forests."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from verdigris.operators import forest as T1
from verdigris.operators import leaf_forests as LF
from verdigris.operators import leaves as L
from verdigris.operators import metrics, stratify
from verdigris.operators import paths as W
from verdigris.operators import threshold_trees as TT
from verdigris.operators import training as TR
from verdigris.plans.registry import query
from verdigris.plans.similarity import MIXED
from verdigris.sources import tables as T
from verdigris.sources.shared import cut

X, C, Y, M = T.NUMERIC, T.CATEGORICAL, T.LABELS, T.MASKED


#: Trees and depth of a leaf's forest for a label.
LEAF_TREES, LEAF_DEPTH = 12, 4


def _forest_sql(p: str, train: str, seed: str, trees: int, depth: int, balanced: bool = False, at: str = "cm") -> str:
    """CTEs of a forest for each node and label of train (row_id, node, label, y) over x1 to x3, named with p: sums of weights
    by bin, level by level. {p}sh shares, {p}n0.. nodes of a level. at: (row_id, node) of all rows that are asked for."""
    cut = lambda i: f"least(greatest(CAST(floor(coalesce((x{i} - l{i}) / nullif(h{i} - l{i}, 0), 0) * {LF.BINS}) AS INTEGER), 0), {LF.BINS - 1})"
    u = f"CAST(('0x' || substr(md5(concat_ws('|', '{seed}', rt, t.label, t.row_id)), 1, 8)) AS BIGINT) / 4294967296.0"
    weight = " + ".join(f"CAST({u} >= {c} AS INTEGER)" for c in LF.POISSON)
    more = " * (n / (2.0 * CASE WHEN y = 1 THEN ones ELSE n - ones END))" if balanced else ""
    by, gini = "node, label, rt, place", lambda n, s: f"(2 * (({s}) / ({n})) * (1 - ({s}) / ({n})))"
    out = [
        f"{p}ed AS (SELECT node, {', '.join(f'min(x{i}) AS l{i}, max(x{i}) AS h{i}' for i in (1, 2, 3))} FROM (SELECT DISTINCT row_id, node FROM {train}) t JOIN (SELECT row_id, x1, x2, x3 FROM cm) USING (row_id) GROUP BY node)",
        f"{p}b AS (SELECT row_id, a.node, {', '.join(f'{cut(i)} AS b{i - 1}' for i in (1, 2, 3))} FROM (SELECT DISTINCT row_id, node FROM {at}) a JOIN (SELECT row_id, x1, x2, x3 FROM cm) USING (row_id) JOIN {p}ed ON {p}ed.node = a.node)",
        f"{p}sh AS (SELECT node, label, count(*) AS n, sum(y) AS ones FROM {train} GROUP BY ALL)",
        f"{p}r0 AS (SELECT * FROM (SELECT t.node, t.label, rt, CAST(1 AS BIGINT) AS place, t.row_id, y, b0, b1, b2, CAST(({weight}) AS DOUBLE){more} AS w FROM {train} t JOIN {p}sh s ON s.node = t.node AND s.label = t.label AND ones > 0 AND ones < n JOIN {p}b b ON b.row_id = t.row_id AND b.node = t.node, (SELECT unnest(range({trees})) AS rt)) WHERE w > 0)",
    ]
    for k in range(depth + 1):
        out.append(f"{p}s{k} AS (SELECT {by}, sum(w) AS tw, sum(w * y) AS t1 FROM {p}r{k} GROUP BY ALL)")
        if k == depth:
            out.append(f"{p}n{k} AS (SELECT {by}, NULL AS col, NULL AS ct, 0.0 AS gain, t1 / tw AS prob FROM {p}s{k})")
            break
        out += [
            f"{p}d{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY md5(concat_ws('|', '{seed}col', label, rt, place, col)), col) AS r FROM (SELECT *, unnest([0, 1, 2]) AS col FROM {p}s{k} WHERE t1 / tw > 1e-12 AND t1 / tw < 1 - 1e-12 AND tw >= 2)) WHERE r <= 2)",
            f"{p}h{k} AS (SELECT {by}, col, CASE col WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END AS ct, sum(w) AS bw, sum(w * y) AS bs, any_value(tw) AS tw, any_value(t1) AS t1 FROM {p}r{k} JOIN {p}d{k} USING ({by}) GROUP BY ALL)",
            f"{p}c{k} AS (SELECT *, sum(bw) OVER v AS lw, sum(bs) OVER v AS l1 FROM {p}h{k} WINDOW v AS (PARTITION BY {by}, col ORDER BY ct))",
            f"{p}g{k} AS (SELECT *, round(tw * {gini('tw', 't1')} - lw * {gini('lw', 'l1')} - (tw - lw) * {gini('tw - lw', 't1 - l1')}, 9) AS gain FROM {p}c{k} WHERE tw - lw > 1e-9)",
            f"{p}e{k} AS (SELECT * FROM (SELECT {by}, col, ct, gain, row_number() OVER (PARTITION BY {by} ORDER BY gain DESC, col, ct) AS r FROM {p}g{k}) WHERE r = 1 AND gain > 1e-9)",
            f"{p}n{k} AS (SELECT {by}, col, ct, coalesce(gain, 0) AS gain, t1 / tw AS prob FROM {p}s{k} LEFT JOIN {p}e{k} USING ({by}))",
            f"{p}r{k + 1} AS (SELECT r.node, r.label, r.rt, 2 * r.place + CASE WHEN CASE col WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END > ct THEN 1 ELSE 0 END AS place, row_id, y, b0, b1, b2, w FROM {p}r{k} r JOIN {p}e{k} USING ({by}))",
        ]
    return ", ".join(out)


def _applied_sql(p: str, rows: str, depth: int) -> str:
    """CTE {p}p: node, row_id, label, prob of rows (row_id, node) by the forests of p."""
    out = [f"{p}q0 AS (SELECT b.node, label, rt, CAST(1 AS BIGINT) AS place, row_id, b0, b1, b2 FROM {p}b b JOIN {rows} USING (row_id, node) JOIN (SELECT DISTINCT node, label, rt FROM {p}n0) f ON f.node = b.node)"]
    for k in range(depth):
        out.append(f"{p}q{k + 1} AS (SELECT q.node, q.label, q.rt, 2 * q.place + CASE WHEN CASE col WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END > ct THEN 1 ELSE 0 END AS place, row_id, b0, b1, b2 FROM {p}q{k} q JOIN {p}n{k} USING (node, label, rt, place) WHERE col IS NOT NULL)")
    leaves = " UNION ALL ".join(f"SELECT node, row_id, label, prob FROM {p}q{k} JOIN {p}n{k} USING (node, label, rt, place) WHERE col IS NULL" for k in range(depth + 1))
    out.append(f"{p}p AS (SELECT node, row_id, label, avg(prob) AS prob FROM ({leaves}) GROUP BY ALL UNION ALL SELECT b.node, row_id, label, CASE WHEN ones > 0 THEN 1.0 ELSE 0.0 END FROM {p}b b JOIN {rows} USING (row_id, node) JOIN {p}sh s ON s.node = b.node WHERE ones = 0 OR ones = n)")
    return ", ".join(out)


#: The forest of the registered queries: its first level has SQL; ``f1_forest_below`` and the README have deeper ones.
GROWN = T1.Config(trees=3, depth=1, iterations=4, groups=3, bag=0.88)


def _grown(spark, sf, config=GROWN):
    df = cut(T.customer_ml(spark, sf).select("row_id", "sup", *X, *C, *M))
    return df, *T1.grow(df, "row_id", X, C, M, config)


def _grown_sql(c: T1.Config) -> str:
    """CTEs of the first level of a forest: bg bags, dr drawn columns, best the candidate of each tree, sd its sides."""
    bags = []
    for t in range(c.trees):
        seed = f"{c.seed}{t}"
        rest = " UNION ".join(f"SELECT {t}, row_id FROM (SELECT row_id, row_number() OVER (ORDER BY md5(concat_ws('|', '{seed}', '{k}', row_id)), row_id) AS r FROM cm WHERE {cond}), bt WHERE r <= floor({n} * {c.bag} + 1e-9)" for k, cond, n in (("sup", "sup", "ns"), ("unsup", "NOT sup", "nu")))
        bags.append(f"SELECT {t} AS tree, row_id FROM (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '{seed}', label, row_id)), row_id) AS r FROM yl WHERE m = 1) JOIN bk USING (label) WHERE r <= k UNION {rest}")
    used = ", ".join(f"count(CASE WHEN col = '{x}' AND r <= {c.width([*X, *C])} THEN 1 END) AS u{i}" for i, x in enumerate([*X, *C], 1))
    num = lambda a, b: " + ".join(f"u{i} * abs({a}.x{i} - {b}.x{i}) / (h{i} - l{i} + 1e-12)" for i in (1, 2, 3))
    far = lambda a, b: f"(({num(a, b)}) + u4 * CASE WHEN {a}.c1 <> {b}.c1 THEN 1 ELSE 0 END) / {c.width([*X, *C])}"
    dot, norm = lambda a, b: " + ".join(f"{a}.m{i} * {b}.m{i}" for i in range(5)), lambda a: " + ".join(f"{a}.m{i}" for i in range(5))
    cos = lambda a, b: f"(1 - coalesce(({dot(a, b)}) / nullif(sqrt({norm(a)}) * sqrt({norm(b)}), 0), 0))"
    same = " AND ".join(f"a.m{i} = b.m{i}" for i in range(5))
    bal = " + ".join(f"coalesce(least(count(CASE WHEN m{i} = 1 THEN 1 END), count(CASE WHEN m{i} = 0 THEN 1 END)) / nullif(greatest(count(CASE WHEN m{i} = 1 THEN 1 END), count(CASE WHEN m{i} = 0 THEN 1 END)), 0), 0)" for i in range(5))
    span = ", ".join(f"min(x{i}) AS l{i}, max(x{i}) AS h{i}" for i in (1, 2, 3))
    r2 = " + ".join(f"u{i} * u{j} * coalesce(corr(x{i}, x{j}), 0) ** 2" for i, j in ((1, 2), (1, 3), (2, 3)))
    by = "tree, it"
    return f"""bt AS (SELECT count(*) AS n, count(CASE WHEN m0 + m1 + m2 + m3 + m4 > 0 THEN 1 END) AS pos, count(CASE WHEN sup THEN 1 END) AS ns, count(CASE WHEN NOT sup THEN 1 END) AS nu FROM cm),
bk AS (SELECT label, CAST(floor(least(floor((1 - count(CASE WHEN m = 1 THEN 1 END) / any_value(pos)) * any_value(n)), count(CASE WHEN m = 1 THEN 1 END)) * {c.bag} + 1e-9) AS BIGINT) AS k FROM yl, bt GROUP BY label),
bg AS MATERIALIZED (SELECT b.tree, cm.* FROM ({' UNION ALL '.join(f'({x})' for x in bags)}) b JOIN cm USING (row_id)),
dr AS (SELECT tree, it, {used} FROM (SELECT tree, it, col, row_number() OVER (PARTITION BY tree, it ORDER BY md5(concat_ws('|', '{c.seed}', tree, 1, it, col)), col) AS r FROM (SELECT unnest(range({c.trees})) AS tree), (SELECT unnest(range({c.iterations})) AS it), (SELECT unnest(['x1', 'x2', 'x3', 'c1']) AS col)) GROUP BY tree, it),
sp AS (SELECT tree, {span} FROM bg GROUP BY tree),
kv AS (SELECT tree, m0, m1, m2, m3, m4, max(row_id) AS k, min(row_id) AS k0, count(*) AS n FROM bg WHERE sup GROUP BY ALL),
kp AS (SELECT a.tree, a.k AS ka, CASE WHEN {same} THEN a.k0 ELSE b.k END AS kb, CASE WHEN {same} AND a.n = 1 THEN 0 ELSE round({cos('a', 'b')}, 9) END AS d FROM kv a JOIN kv b ON a.tree = b.tree),
kf AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, ka ORDER BY d DESC, kb DESC) AS r FROM kp) WHERE r = 1),
ab AS (SELECT tree, ka, kb FROM (SELECT tree, ka, kb, row_number() OVER (PARTITION BY tree ORDER BY d DESC, ka DESC, kb DESC) AS r FROM kf) WHERE r = 1 AND ka <> kb),
w0 AS (SELECT x.tree, it, x.row_id, ka, kb, substr(md5(concat_ws('|', '{c.seed}coin', x.tree, 1, it)), 1, 1) < '8' AS byb, round(0.7 + 0.3 * ({far('x', 'p')}) + 0.7 * {cos('x', 'p')}, 9) AS wa, round(0.7 + 0.3 * ({far('x', 'q')}) + 0.7 * {cos('x', 'q')}, 9) AS wb
 FROM bg x JOIN ab ON ab.tree = x.tree JOIN cm p ON p.row_id = ka JOIN cm q ON q.row_id = kb JOIN sp ON sp.tree = x.tree JOIN dr ON dr.tree = x.tree WHERE x.sup),
w1 AS (SELECT *, CASE WHEN byb THEN kb ELSE ka END AS skip, CASE WHEN byb THEN ka ELSE kb END AS near, CASE WHEN byb THEN wa ELSE wb END AS far, CASE WHEN byb THEN wb ELSE wa END AS wo FROM w0),
fs AS (SELECT tree, it, row_id AS seed, wb AS wseed FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY far DESC, row_id DESC) AS r FROM w1 WHERE row_id <> near) WHERE r = 1),
rs AS (SELECT w1.*, seed, row_number() OVER o - 1 AS i, count(*) OVER (PARTITION BY w1.tree, w1.it) AS n, avg(wa) OVER (PARTITION BY w1.tree, w1.it ORDER BY wo, row_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS m0,
 (wseed + coalesce(sum(wb) OVER (PARTITION BY w1.tree, w1.it ORDER BY wo, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / row_number() OVER o AS m1 FROM w1 JOIN fs ON fs.tree = w1.tree AND fs.it = w1.it WHERE row_id <> skip WINDOW o AS (PARTITION BY w1.tree, w1.it ORDER BY wo, row_id)),
st AS (SELECT tree, it, coalesce(min(CASE WHEN i >= 1 AND i <= n - 2 AND round(m0, 6) > round(m1, 6) THEN i END), max(greatest(n - 2, 0))) AS stop FROM rs GROUP BY {by}),
sds AS (SELECT tree, it, row_id, CASE WHEN row_id = seed OR i < stop THEN 1 ELSE 0 END AS cl, i = n - 1 AS centre0, CASE WHEN stop > 0 THEN i = stop - 1 ELSE row_id = seed END AS centre1 FROM rs JOIN st USING (tree, it)
 UNION ALL SELECT DISTINCT tree, it, seed, 1, false, stop = 0 FROM rs JOIN st USING (tree, it) WHERE seed = skip),
asn AS MATERIALIZED (SELECT x.*, dr.it, u1, u2, u3, u4, coalesce(s.cl, CASE WHEN round({far('x', 'q')}, 9) < round({far('x', 'p')}, 9) THEN 1 ELSE 0 END) AS cl
 FROM bg x JOIN dr ON dr.tree = x.tree JOIN sds c0 ON c0.centre0 AND c0.tree = x.tree AND c0.it = dr.it JOIN sds c1 ON c1.centre1 AND c1.tree = x.tree AND c1.it = dr.it JOIN cm p ON p.row_id = c0.row_id JOIN cm q ON q.row_id = c1.row_id JOIN sp ON sp.tree = x.tree
 LEFT JOIN sds s ON s.row_id = x.row_id AND s.tree = x.tree AND s.it = dr.it),
sz AS (SELECT {by}, count(CASE WHEN cl = 0 THEN 1 END) AS n0, count(CASE WHEN cl = 1 THEN 1 END) AS n1, count(CASE WHEN cl = 0 AND sup THEN 1 END) AS s0, count(CASE WHEN cl = 1 AND sup THEN 1 END) AS s1, u1 + u2 + u3 AS nu FROM asn GROUP BY ALL),
ok AS (SELECT * FROM sz WHERE s0 > 2 AND s1 > 2 AND least(n0, n1) >= (SELECT ceil(count(*) * {c.least_share}) FROM cm)),
gp AS MATERIALIZED (SELECT a.tree, a.it, a.row_id AS a, b.row_id AS b, a.cl AS ca, b.cl AS cb, a.sup AND b.sup AS bsup, {far('a', 'b').replace('u1', 'a.u1').replace('u2', 'a.u2').replace('u3', 'a.u3').replace('u4', 'a.u4')} AS d, {cos('a', 'b')} AS l FROM asn a JOIN asn b ON a.tree = b.tree AND a.it = b.it AND a.row_id < b.row_id JOIN sp ON sp.tree = a.tree),
lab AS (SELECT {by}, avg(l) AS l FROM (SELECT {by}, ca, avg(CASE WHEN bsup THEN l END) AS l FROM gp WHERE ca = cb GROUP BY {by}, ca) GROUP BY {by}),
bal AS (SELECT {by}, avg(b) AS bal FROM (SELECT {by}, cl, ({bal}) / 5 AS b FROM asn WHERE sup GROUP BY {by}, cl) GROUP BY {by}),
sy AS (SELECT {by}, a, ca, cb, d FROM gp UNION ALL SELECT {by}, b, cb, ca, d FROM gp),
sr AS (SELECT {by}, a, coalesce(sum(CASE WHEN ca = cb THEN d END) / nullif(count(CASE WHEN ca = cb THEN 1 END), 0), 1) AS x, sum(CASE WHEN ca <> cb THEN d END) / count(CASE WHEN ca <> cb THEN 1 END) AS y FROM sy GROUP BY {by}, a),
sl AS (SELECT {by}, avg((y - x) / greatest(x, y)) AS s FROM sr GROUP BY {by}),
rg2 AS (SELECT {by}, cl, {span} FROM asn GROUP BY {by}, cl),
fd AS (SELECT {by}, avg(f) AS f FROM (SELECT a.tree, a.it, a.cl, avg({far('a', 'b').replace('u1', 'a.u1').replace('u2', 'a.u2').replace('u3', 'a.u3').replace('u4', 'a.u4')}) AS f FROM asn a JOIN asn b ON a.tree = b.tree AND a.it = b.it AND a.cl = b.cl AND a.row_id < b.row_id JOIN rg2 ON rg2.tree = a.tree AND rg2.it = a.it AND rg2.cl = a.cl GROUP BY a.tree, a.it, a.cl) GROUP BY {by}),
ind AS (SELECT {by}, {r2} AS r2 FROM asn GROUP BY {by}, u1, u2, u3),
sco AS (SELECT ok.tree, ok.it, round((1 - l + least(s0, s1) / greatest(s0, s1) + least(s0 / n0, s1 / n1) / greatest(s0 / n0, s1 / n1) + bal + (s + 1) / 2 + CASE WHEN nu > 1 THEN 1 - r2 / (nu * (nu - 1) / 2) ELSE 1 END + 1 - f) / 7, 9) AS score, row_number() OVER (PARTITION BY ok.tree ORDER BY ok.it) AS r
 FROM ok JOIN lab USING (tree, it) JOIN bal USING (tree, it) JOIN sl USING (tree, it) JOIN fd USING (tree, it) JOIN ind USING (tree, it)),
best AS (SELECT tree, it, score FROM (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY score DESC, it) AS k FROM sco WHERE r <= {c.groups}) WHERE k = 1),
sd AS MATERIALIZED (SELECT asn.*, 2 + cl AS place FROM asn JOIN best USING (tree, it))"""


_COLS = "array_to_string(list_filter([CASE WHEN u4 = 1 THEN 'c1' END, CASE WHEN u1 = 1 THEN 'x1' END, CASE WHEN u2 = 1 THEN 'x2' END, CASE WHEN u3 = 1 THEN 'x3' END], lambda z: z IS NOT NULL), ',')"
_LEAVES = "lf AS (SELECT tree, place, row_id FROM sd UNION ALL SELECT tree, 1, row_id FROM bg WHERE tree NOT IN (SELECT tree FROM best))"


def _shown(s):
    """Column lists as text."""
    return s.select("tree", "node", "parent", "left", "right", "level", "is_leaf", F.array_join("cols", ",").alias("cols"), F.array_join("path", ",").alias("path"), "n", "n_sup")


@query("t1_grow_forest", f"""WITH {_grown_sql(GROWN)}, dc AS (SELECT tree, {_COLS} AS cols FROM dr JOIN best USING (tree, it)), {_LEAVES}
SELECT bg.tree, CAST(1 AS BIGINT) AS node, CAST(NULL AS BIGINT) AS parent, CAST(CASE WHEN cols IS NOT NULL THEN 2 END AS BIGINT) AS left, CAST(CASE WHEN cols IS NOT NULL THEN 3 END AS BIGINT) AS right, 0 AS level, cols IS NULL AS is_leaf, cols, coalesce(cols, '') AS path, count(*) AS n, count(CASE WHEN sup THEN 1 END) AS n_sup FROM bg LEFT JOIN dc USING (tree) GROUP BY bg.tree, cols
UNION ALL SELECT sd.tree, place, 1, NULL, NULL, 1, true, NULL, cols, count(*), count(CASE WHEN sup THEN 1 END) FROM sd JOIN dc USING (tree) GROUP BY sd.tree, place, cols""")
def t1(spark, sf):
    df, nodes, members = _grown(spark, sf)
    return _shown(T1.structure(nodes, members, df, "row_id", F.col("sup")))


#: Rows walk to the side of the nearer member by the drawn columns, over both sides' ranges.
_ROUTED = """nr AS (SELECT x.row_id, s.tree, s.cl, min(round(s.u1 * abs(x.x1 - s.x1) / (h1 - l1 + 1e-12) + s.u2 * abs(x.x2 - s.x2) / (h2 - l2 + 1e-12) + s.u3 * abs(x.x3 - s.x3) / (h3 - l3 + 1e-12) + s.u4 * CASE WHEN x.c1 <> s.c1 THEN 1 ELSE 0 END, 9)) AS d FROM cm x, sd s JOIN sp ON sp.tree = s.tree GROUP BY x.row_id, s.tree, s.cl),
ro AS (SELECT row_id, tree, CASE WHEN min(CASE WHEN cl = 0 THEN d END) < min(CASE WHEN cl = 1 THEN d END) THEN 2 ELSE 3 END AS place FROM nr GROUP BY row_id, tree UNION ALL SELECT row_id, tree, 1 FROM cm, (SELECT DISTINCT tree FROM bg WHERE tree NOT IN (SELECT tree FROM best)))"""


@query("t4_route_rows", f"WITH {_grown_sql(GROWN)}, {_ROUTED} SELECT row_id, tree, CAST(place AS BIGINT) AS node FROM ro")
def t4(spark, sf):
    df, nodes, members = _grown(spark, sf)
    return T1.route(df, df, nodes, members, "row_id", X, C)


def _fitted(spark, sf):
    """The forest of the registered queries, fitted, and its rows."""
    df = cut(T.customer_ml(spark, sf).select("row_id", *X, *C, *M, *Y))
    return TR.Forest("row_id", X, C, M, GROWN, 3, 2, LEAF_TREES, LEAF_DEPTH).fit(df), df


def _filled_sql(reps: int, width: int) -> str:
    """CTE tn: row_id, node (tree and place), label, y of the members of leaves, unlabelled ones by their nearest labelled rows."""
    out = []
    for r in range(reps):
        order = sorted([*X, *C], key=lambda c: hashlib.md5(f"fill|{r}|{c}".encode()).hexdigest())[:width]
        d = " + ".join([f"abs(a.{x} - b.{x}) / (h{x[1]} - l{x[1]} + 1e-12)" for x in X if x in order] + ["CASE WHEN a.c1 <> b.c1 THEN 1 ELSE 0 END" for x in C if x in order])
        out.append(f"SELECT a.node, a.row_id, arg_min(b.row_id, (({d}) / {float(width)}, concat(b.tree, '_', b.row_id))) AS b FROM lm a JOIN lm b ON a.node = b.node AND NOT a.sup AND b.sup JOIN lr ON lr.node = a.node GROUP BY a.node, a.row_id")
    known = " UNION ALL ".join(f"SELECT row_id, lm.node, {i} AS label, m{i} AS y FROM lm WHERE sup" for i in range(5))
    filled = " UNION ALL ".join(f"SELECT f.row_id, f.node, {i}, CAST(round_even(avg(m{i}), 0) AS INTEGER) FROM fl f JOIN cm c ON c.row_id = f.b GROUP BY f.row_id, f.node" for i in range(5))
    return f"""lm AS (SELECT tree, concat(tree, '_', place) AS node, row_id, x1, x2, x3, c1, sup, m0, m1, m2, m3, m4 FROM lf JOIN (SELECT * EXCLUDE (node) FROM cm) USING (row_id)),
lr AS (SELECT node, {', '.join(f'min(x{i}) AS l{i}, max(x{i}) AS h{i}' for i in (1, 2, 3))} FROM lm GROUP BY node), fl AS ({' UNION ALL '.join(out)}), tn AS ({known} UNION ALL {filled})"""


_PREDICTED = f"""{_grown_sql(GROWN)}, {_ROUTED}, {_LEAVES}, {_filled_sql(3, 2)}, ra AS (SELECT row_id, concat(tree, '_', place) AS node FROM ro), rb AS (SELECT row_id, node FROM ra UNION SELECT row_id, node FROM tn),
{_forest_sql('f', 'tn', 'leaf', LEAF_TREES, LEAF_DEPTH, at='rb')}, {_applied_sql('f', 'ra', LEAF_DEPTH)},
pt AS (SELECT p.node, row_id, label, prob, CASE WHEN ones = 0 OR ones = n THEN CAST(ones > 0 AS INTEGER) WHEN round(prob, 9) > round(0.95 * ones / n, 9) THEN 1 ELSE 0 END AS pred FROM fp p JOIN fsh USING (node, label))"""


@query("f2_forest_predictions", f"WITH {_PREDICTED} SELECT row_id, label, round(avg(pred), 6) AS vote, round(avg(prob), 6) AS prob, CASE WHEN avg(pred) >= 0.5 THEN 1 ELSE 0 END AS pred FROM pt GROUP BY row_id, label")
def f2(spark, sf):
    """A whole fit and predict: the trees' leaves predict by forests of their completed labels, the trees vote."""
    f, df = _fitted(spark, sf)
    return f.predict_with_proba(df).select("row_id", "label", F.round("vote", 6).alias("vote"), F.round("prob", 6).alias("prob"), "pred")


@query("x1_forest_activations", f"""WITH {_PREDICTED} SELECT row_id, p.node AS leaf, label, pred, round(prob, 6) AS prob, y AS real, CAST(pred = 1 AND y = 1 AS INTEGER) AS tp, CAST(pred = 0 AND y = 0 AS INTEGER) AS tn, CAST(pred = 1 AND y = 0 AS INTEGER) AS fp, CAST(pred = 0 AND y = 1 AS INTEGER) AS fn
FROM pt p JOIN (SELECT row_id, label, y FROM yl) USING (row_id, label)""")
def x1(spark, sf):
    """What every tree's leaf says of every row, against the true labels."""
    f, df = _fitted(spark, sf)
    a = f.activations(df.drop(*M).withColumnsRenamed(dict(zip(Y, M))))
    return a.select("row_id", F.concat_ws("_", "tree", "node").alias("leaf"), "label", "pred", F.round("prob", 6).alias("prob"), "real", "tp", "tn", "fp", "fn")


@query("x2_forest_rule_quality", f"""WITH {_PREDICTED}, k AS (SELECT p.node, label, count(*) AS n, count(CASE WHEN pred = 1 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN pred = 1 AND y = 0 THEN 1 END) AS fp, count(CASE WHEN pred = 0 AND y = 1 THEN 1 END) AS fn FROM pt p JOIN (SELECT row_id, label, y FROM yl) USING (row_id, label) GROUP BY ALL)
SELECT node AS id, max(n) AS n, round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) AS macro_precision, round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 6) AS macro_recall, round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 6) AS macro_f1, round(coalesce(2 * sum(tp) / nullif(sum(2 * tp + fp + fn), 0), 0), 6) AS micro_f1 FROM k GROUP BY node""")
def x2(spark, sf):
    f, df = _fitted(spark, sf)
    q = f.rule_quality(f.activations(df.drop(*M).withColumnsRenamed(dict(zip(Y, M)))))
    return q.select("id", "n", *(F.round(c, 6).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "micro_f1")))


@query("m_forest_report", f"""WITH {_PREDICTED}, sv AS (SELECT row_id, label, avg(prob) AS prob, CASE WHEN avg(pred) >= 0.5 THEN 1 ELSE 0 END AS pred FROM pt GROUP BY row_id, label), sw AS (SELECT sv.*, y FROM sv JOIN (SELECT row_id, label, y FROM yl) USING (row_id, label)),
k AS (SELECT label, count(CASE WHEN pred = 0 AND y = 0 THEN 1 END) AS tn, count(CASE WHEN pred = 0 AND y = 1 THEN 1 END) AS fn, count(CASE WHEN pred = 1 AND y = 1 THEN 1 END) AS tp, count(CASE WHEN pred = 1 AND y = 0 THEN 1 END) AS fp FROM sw GROUP BY label)
SELECT 'hamming_loss' AS name, CAST(NULL AS INTEGER) AS label, round(avg(CASE WHEN pred <> y THEN 1 ELSE 0 END), 6) AS value FROM sw UNION ALL SELECT 'subset_accuracy', NULL, round(avg(ok), 6) FROM (SELECT min(CASE WHEN pred = y THEN 1 ELSE 0 END) AS ok FROM sw GROUP BY row_id)
UNION ALL SELECT 'macro_precision', NULL, round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 6) FROM k UNION ALL SELECT unnest(['tn', 'fn', 'tp', 'fp']), CAST(label AS INTEGER), CAST(unnest([tn, fn, tp, fp]) AS DOUBLE) FROM k""")
def m_report(spark, sf):
    """The report of a fitted forest against the true labels: some metrics, and the confusion counts by label."""
    f, df = _fitted(spark, sf)
    scored = cut(f.predict_with_proba(df).join(f.long_labels(df.drop(*M).withColumnsRenamed(dict(zip(Y, M)))), ["row_id", "label"]))
    r = TR.report(scored).where(F.col("name").isin("hamming_loss", "subset_accuracy", "macro_precision", "tn", "fn", "tp", "fp"))
    return r.select("name", "label", F.round("value", 6).alias("value"))


@query("f1_forest_below")
def f1(spark, sf):
    """A forest of several levels: its rules as a table. Growth, walks and leaves are held against plain versions in tests."""
    df = T.customer_ml(spark, sf).select("row_id", *X, *C, *M)
    return TR.Forest("row_id", X, C, M, T1.Config(trees=4, depth=4, iterations=8, groups=5, bag=0.88), reps=1).fit(df).rules()


@query("f6_cross_validation")
def f6(spark, sf):
    """Five folds, each scored by trees that were grown and trained without it: precision, recall and f1 by fold and label."""
    df = T.customer_ml(spark, sf)
    folds = stratify.parts(df, Y, [0.2] * 5, "folds").withColumnRenamed("part", "fold")
    forest = TR.Forest("row_id", X, C, M, T1.Config(trees=2, depth=2, iterations=4, groups=3, bag=0.88), reps=1)
    scored = cut(TR.cross_validated(df.select("row_id", *X, *C, *M, *Y), folds, 5, forest, Y))
    r = metrics.rates(metrics.confusion(scored, F.col("pred"), ["fold", "label"]), ["fold", "label"])
    return r.select("fold", "label", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "support")


#: Two given trees over the labelled rows: tree, node, level, columns, and the cut that deals a split's members.
TREES = [(0, 1, 0, ["x1", "x2", "c1"], "x1 <= 4500"), (0, 2, 1, ["x2", "x3"], "x2 <= 15"), (0, 3, 1, ["x1", "x3"], "x3 <= 2000000"), (1, 1, 0, ["c1", "x3"], "x3 <= 2500000")]
LEAVES = [(0, 4, 2), (0, 5, 2), (0, 6, 2), (0, 7, 2), (1, 2, 1), (1, 3, 1)]


def _given_sql() -> str:
    """Members of the given trees, and the way of every row through them by the nearest member's side."""
    nd = " UNION ALL ".join(f"SELECT {t} AS tree, {n} AS node, " + ", ".join(f"{int(c in cols)} AS u{i}" for i, c in enumerate(("x1", "x2", "x3", "c1"), 1)) for t, n, _, cols, _ in TREES)
    cond = {(t, n): c for t, n, _, _, c in TREES}
    top = " UNION ALL ".join(f"SELECT {t} AS tree, CASE WHEN {cond[t, 1]} THEN 2 ELSE 3 END AS node, row_id FROM cm WHERE sup" for t in (0, 1))
    low = " UNION ALL ".join(f"SELECT 0 AS tree, CASE WHEN {cond[0, n]} THEN {2 * n} ELSE {2 * n + 1} END AS node, row_id FROM cm JOIN m1 USING (row_id) WHERE m1.tree = 0 AND m1.node = {n}" for n in (2, 3))
    far = " + ".join(f"u{i} * abs(x.x{i} - b.x{i}) / (h{i} - l{i} + 1e-12)" for i in (1, 2, 3))

    def step(k: int) -> str:
        return f"""p{k} AS (SELECT a.tree, a.node, a.row_id, m.node % 2 AS side, m.row_id AS m, round({far} + u4 * CASE WHEN x.c1 <> b.c1 THEN 1 ELSE 0 END, 9) AS d
 FROM at{k} a JOIN nd ON nd.tree = a.tree AND nd.node = a.node JOIN sp ON sp.tree = a.tree AND sp.node = a.node JOIN mem m ON m.tree = a.tree AND m.node // 2 = a.node JOIN cm x ON x.row_id = a.row_id JOIN cm b ON b.row_id = m.row_id),
f{k} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tree, node, row_id, side ORDER BY d, m) AS r FROM p{k}) WHERE r = 1),
w{k} AS (SELECT tree, node, row_id, CASE WHEN min(CASE WHEN side = 0 THEN d END) < min(CASE WHEN side = 1 THEN d END) THEN 0 ELSE 1 END AS side FROM f{k} GROUP BY ALL),
at{k + 1} AS (SELECT tree, 2 * node + side AS node, row_id FROM w{k})"""

    return f"""nd AS ({nd}), m1 AS ({top}), mem AS (SELECT * FROM m1 UNION ALL {low}),
sp AS (SELECT tree, mem.node // 2 AS node, {', '.join(f'min(x{i}) AS l{i}, max(x{i}) AS h{i}' for i in (1, 2, 3))} FROM mem JOIN cm USING (row_id) GROUP BY tree, mem.node // 2),
at0 AS (SELECT tree, 1 AS node, row_id FROM cm, (SELECT DISTINCT tree FROM nd)), {step(0)}, {step(1)},
leaf AS (SELECT row_id, tree, node FROM at2 UNION ALL SELECT row_id, tree, node FROM at1 WHERE tree = 1)"""


def _given(spark, sf):
    df = cut(T.customer_ml(spark, sf).select("row_id", "sup", *X, *C, *Y))
    kind = "tree int, node long, level int, is_leaf boolean, cols array<string>, score double"
    nodes = spark.createDataFrame([(t, n, lv, False, cols, 0.0) for t, n, lv, cols, _ in TREES] + [(t, n, lv, True, None, None) for t, n, lv in LEAVES], kind)
    members = own = df.where("sup").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("tree"), F.lit(1).cast("long").alias("node"), "row_id", F.lit(0).alias("level"))
    for level in (0, 1):
        side = F.lit(None).cast("int")
        for t, n, lv, _, cond in TREES:
            side = F.when((F.col("tree") == t) & (F.col("node") == n) & (F.lit(lv) == level), F.when(F.expr(cond), 0).otherwise(1)).otherwise(side)
        own = own.join(df.select("row_id", *X, *C), "row_id").withColumn("_s", side).where("_s IS NOT NULL").select("tree", (2 * F.col("node") + F.col("_s")).alias("node"), "row_id", F.lit(level + 1).alias("level"))
        members = members.unionAll(own)
    return df, nodes, cut(members)


@query("t4_route_given_trees", f"WITH {_given_sql()} SELECT row_id, tree, node FROM leaf")
def t4_given(spark, sf):
    df, nodes, members = _given(spark, sf)
    return T1.route(df, df, nodes, members, "row_id", X, C)


@query("x3_explanation_ranges", f"""WITH {_given_sql()}, st AS (SELECT 0 AS level, f0.* FROM f0 JOIN w0 USING (tree, node, row_id, side) UNION ALL SELECT 1, f1.* FROM f1 JOIN w1 USING (tree, node, row_id, side)),
e AS ({' UNION ALL '.join(f"SELECT row_id, st.tree, level, 'x{i}' AS col, x.x{i} AS v, b.x{i} AS bound FROM st JOIN nd ON nd.tree = st.tree AND nd.node = st.node JOIN cm x USING (row_id) JOIN cm b ON b.row_id = st.m WHERE u{i} = 1" for i in (1, 2, 3))}),
o AS (SELECT *, CASE WHEN v < bound THEN '<=' ELSE '>=' END AS op FROM e),
k AS (SELECT *, CASE WHEN level = 1 AND (op = '<=' AND bound > lag(bound) OVER w OR op = '>=' AND bound < lag(bound) OVER w) THEN 1 ELSE 0 END AS moved FROM o WINDOW w AS (PARTITION BY row_id, tree, col, op ORDER BY level))
SELECT row_id, tree, col, op, any_value(v) AS v, CASE WHEN op = '<=' THEN max(bound) ELSE min(bound) END AS bound, CAST(sum(moved) AS BIGINT) AS extended FROM k GROUP BY row_id, tree, col, op""")
def x3(spark, sf):
    df, nodes, members = _given(spark, sf)
    routed = T1.route(df, df, nodes, members, "row_id", X, C)
    return W.explanation_ranges(df, df, nodes, members, routed, "row_id", X, C)


@query("x4_final_decisions", f"""WITH {_given_sql()}, pr AS (SELECT tree, mem.node, label, avg(y) AS p FROM mem JOIN yl USING (row_id) GROUP BY ALL)
SELECT leaf.row_id, label, CASE WHEN avg(CASE WHEN p >= 0.5 THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 1 ELSE 0 END AS final_decision, round(avg(p), 6) AS final_probability, count(*) AS trees FROM leaf JOIN pr ON pr.tree = leaf.tree AND pr.node = leaf.node GROUP BY ALL""")
def x4(spark, sf):
    """A row for each row and label: the vote of the trees' leaves, and the mean of their probabilities."""
    df, nodes, members = _given(spark, sf)
    routed = T1.route(df, df, nodes, members, "row_id", X, C)
    means = L.mean_vectors(members.join(df, "row_id"), ["tree", "node"], Y)
    each = routed.join(means, ["tree", "node"])
    n = each.groupBy("row_id", "label").agg(F.count("*").alias("trees"))
    return T1.vote(each, "row_id").join(n, ["row_id", "label"]).select("row_id", "label", F.col("pred").alias("final_decision"), F.round("prob", 6).alias("final_probability"), "trees")


@query("t7_nested_structure", f"""WITH {_given_sql()}, al AS (SELECT tree, 1 AS node, row_id FROM cm, (SELECT DISTINCT tree FROM nd) WHERE sup UNION ALL SELECT tree, node, row_id FROM mem), k AS (SELECT DISTINCT tree, node FROM al)
SELECT al.tree, al.node, count(*) AS n, count(CASE WHEN sup THEN 1 END) AS supervised, any_value(1 + CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.tree = al.tree AND k.node // 4 = al.node) THEN 2 WHEN EXISTS (SELECT 1 FROM k WHERE k.tree = al.tree AND k.node // 2 = al.node) THEN 1 ELSE 0 END) AS depth FROM al JOIN cm USING (row_id) GROUP BY al.tree, al.node""")
def t7(spark, sf):
    """The height of each node and how many of its members have labels; the lists themselves are the members table."""
    df, nodes, members = _given(spark, sf)
    n = members.join(df.select("row_id", "sup"), "row_id").groupBy("tree", "node").agg(F.count("*").alias("n"), F.count(F.when(F.col("sup"), 1)).alias("supervised"))
    return n.join(W.heights(nodes).select("tree", "node", "depth"), ["tree", "node"])


@query("t5_legacy_routes", """WITH c AS (SELECT node, avg(x1) AS m, min(row_id) AS k FROM cm GROUP BY node)
SELECT a.row_id, CASE WHEN a.x1 <= c.m THEN 'left' ELSE 'right' END AS by_threshold, CASE WHEN exp(-0.01 * (a.x2 - b.x2) ** 2) < 0.5 THEN 'left' ELSE 'right' END AS by_similarity,
 CASE WHEN abs(a.x2 - b.x2) <= 3 THEN 'left' ELSE 'right' END AS by_distance FROM cm a JOIN c USING (node) JOIN cm b ON b.row_id = c.k""")
def t5(spark, sf):
    df = T.customer_ml(spark, sf)
    c = df.groupBy("node").agg(F.avg("x1").alias("m"), F.min_by("x2", "row_id").alias("k2"))
    side = lambda cond: F.when(cond, "left").otherwise("right")
    d = F.col("x2") - F.col("k2")
    return df.join(c, "node").select("row_id", side(F.col("x1") <= F.col("m")).alias("by_threshold"), side(F.exp(-0.01 * d * d) < 0.5).alias("by_similarity"), side(F.abs(d) <= 3).alias("by_distance"))


@query("t10_simple_leaf", "SELECT node, label, round(avg(y), 6) AS prob, CASE WHEN avg(y) >= 0.5 THEN 1 ELSE 0 END AS pred FROM yl WHERE sup GROUP BY ALL")
def t10(spark, sf):
    return L.mean_vectors(T.customer_ml(spark, sf).where("sup"), ["node"], Y).select("node", "label", F.round("prob", 6).alias("prob"), "pred")


@query("t12_local_fill", """WITH d AS (SELECT node, label, avg(CASE WHEN m >= 0 THEN m END) AS d FROM yl GROUP BY ALL), g AS (SELECT label, avg(CASE WHEN m >= 0 THEN m END) AS g FROM yl GROUP BY label)
SELECT row_id, CAST(sum(CASE WHEN m >= 0 THEN m ELSE CASE WHEN CAST(('0x' || substr(md5(concat_ws('|', 'fill', 'm' || label, row_id)), 1, 8)) AS BIGINT) / 4294967296.0 < d * (1 - g) / (1 - (g * d + (1 - g) * (1 - d))) THEN 1 ELSE 0 END END * (1 << label)) AS BIGINT) AS bits
FROM yl JOIN d USING (node, label) JOIN g USING (label) GROUP BY row_id""")
def t12(spark, sf):
    f = L.local_fill(T.customer_ml(spark, sf).select("row_id", "node", *M), ["node"], "row_id", M)
    return f.select("row_id", sum((F.col(c) * (1 << i) for i, c in enumerate(M[1:], 1)), F.col(M[0])).cast("long").alias("bits"))


@query("l1_completed_labels", f"""WITH rg AS (SELECT node AS rn, min(x1) AS l1, max(x1) AS h1, min(x2) AS l2, max(x2) AS h2, min(x3) AS l3, max(x3) AS h3 FROM cm GROUP BY node),
p AS (SELECT a.row_id, b.row_id AS b, {MIXED} AS d FROM cm a JOIN cm b ON a.node = b.node AND NOT a.sup AND b.sup JOIN rg ON rn = a.node),
nn AS (SELECT row_id, b FROM (SELECT row_id, b, row_number() OVER (PARTITION BY row_id ORDER BY d, b) AS k FROM p) WHERE k = 1)
SELECT row_id, y0 AS m0, y1 AS m1, y2 AS m2, y3 AS m3, y4 AS m4 FROM cm WHERE sup UNION ALL SELECT nn.row_id, y0, y1, y2, y3, y4 FROM nn JOIN cm ON cm.row_id = nn.b""")
def l1(spark, sf):
    return L.completed_labels(T.customer_ml(spark, sf), ["node"], "row_id", X, C, M, reps=1, width=4).select("row_id", *M)


_LABELLED = "lt AS (SELECT row_id, node, label, m AS y FROM yl WHERE sup), ts AS (SELECT row_id, node FROM cm WHERE NOT sup)"


@query("l2_leaf_forests", f"""WITH {_LABELLED}, {_forest_sql('f', 'lt', 'leaf', LEAF_TREES, LEAF_DEPTH)}, {_applied_sql('f', 'ts', LEAF_DEPTH)}
SELECT p.node, row_id, label, round(prob, 6) AS prob, CASE WHEN ones = 0 OR ones = n THEN CAST(ones > 0 AS INTEGER) WHEN round(prob, 9) > round(0.95 * ones / n, 9) THEN 1 ELSE 0 END AS pred FROM fp p JOIN fsh USING (node, label)""")
def l2(spark, sf):
    """A forest for each node and label on the labelled rows, applied to the others."""
    df = T.customer_ml(spark, sf)
    model = LF.fit(df.where("sup"), ["node"], "row_id", X, M, LEAF_TREES, LEAF_DEPTH)
    return LF.predictions(model, df.where("NOT sup"), ["node"], "row_id", X).withColumn("prob", F.round("prob", 6))


_NODES = " UNION ALL ".join(f"SELECT node, label, rt, col, gain FROM fn{k}" for k in range(LEAF_DEPTH + 1))


@query("l5_importances", f"""WITH {_LABELLED}, {_forest_sql('f', 'lt', 'leaf', LEAF_TREES, LEAF_DEPTH)}, nd AS (SELECT * FROM ({_NODES}) WHERE col IS NOT NULL),
t AS (SELECT node, label, rt, sum(gain) AS t FROM nd GROUP BY ALL), k AS (SELECT node, label, count(*) AS k FROM t GROUP BY ALL)
SELECT node, label, 'x' || (col + 1) AS col, round(sum(gain / t) / any_value(k), 6) AS importance FROM nd JOIN t USING (node, label, rt) JOIN k USING (node, label) GROUP BY node, label, col""")
def l5(spark, sf):
    model = LF.fit(T.customer_ml(spark, sf).where("sup"), ["node"], "row_id", X, M, LEAF_TREES, LEAF_DEPTH)
    return LF.importances(model, ["node"], X).withColumn("importance", F.round("importance", 6))


@query("l7_supervised_fill", f"""WITH {_LABELLED}, {_forest_sql('f', 'lt', 'fill', 7, LEAF_DEPTH)}, {_applied_sql('f', 'ts', LEAF_DEPTH)},
tc AS (SELECT row_id, node, label, y FROM lt UNION ALL SELECT row_id, node, label, CASE WHEN round(prob, 9) > 0.5 THEN 1 ELSE 0 END FROM fp), every AS (SELECT row_id, node FROM cm),
{_forest_sql('g', 'tc', 'leaf', 5, LEAF_DEPTH, True)}, {_applied_sql('g', 'every', LEAF_DEPTH)}
SELECT p.node, row_id, label, round(prob, 6) AS prob, CASE WHEN ones = 0 OR ones = n THEN CAST(ones > 0 AS INTEGER) WHEN round(1 - prob, 9) > round(0.95 * (1 - ones / n), 9) THEN 0 ELSE 1 END AS pred FROM gp p JOIN gsh USING (node, label)""")
def l7(spark, sf):
    """Unlabelled rows are filled by a forest of the labelled ones; a balanced forest of all rows then predicts."""
    df = T.customer_ml(spark, sf)
    filled = cut(LF.supervised_fill(df, ["node"], "row_id", X, M, 7, LEAF_DEPTH)).join(df.select("row_id", *X), "row_id")
    model = LF.fit(filled, ["node"], "row_id", X, M, 5, LEAF_DEPTH, balanced=True)
    return LF.predictions(model, df, ["node"], "row_id", X, zero_first=True).withColumn("prob", F.round("prob", 6))


@query("l3_thresholds", "SELECT node, label, round(0.95 * avg(y), 6) AS threshold FROM yl WHERE sup GROUP BY ALL")
def l3(spark, sf):
    return L.thresholds(T.customer_ml(spark, sf).where("sup"), ["node"], Y).select("node", "label", F.round("threshold", 6).alias("threshold"))


@query("l6_self_trained_labels")
def l6(spark, sf):
    return L.self_trained(T.customer_ml(spark, sf), ["node"], "row_id", X, "m0")


@query("l4_leaf_votes", """SELECT row_id, label, round(avg(CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END), 6) AS vote, round(avg(prob), 6) AS prob, CASE WHEN avg(CASE WHEN prob >= 0.5 THEN 1.0 ELSE 0.0 END) >= 0.5 THEN 1 ELSE 0 END AS pred FROM act GROUP BY ALL""")
def l4(spark, sf):
    leaf = T.scores(spark, sf, 3).withColumn("pred", F.when(F.col("prob") >= 0.5, 1).otherwise(0))
    return T1.vote(leaf, "row_id").select("row_id", "label", F.round("vote", 6).alias("vote"), F.round("prob", 6).alias("prob"), "pred")


def _threshold_sql(depth: int, share: float) -> str:
    """CTEs of a threshold tree over the masked labels: vn{k} nodes and vm{k} members of a level, and leaf (row_id, node)."""
    out = ["vm0 AS (SELECT CAST(1 AS BIGINT) AS place, row_id FROM cm)"]
    dot = " + ".join(f"a.m{i} * b.m{i}" for i in range(5))
    size = lambda t: " + ".join(f"{t}.m{i}" for i in range(5))
    for k in range(depth + 1):
        out.append(f"vz{k} AS (SELECT place, count(*) AS n, count(CASE WHEN sup THEN 1 END) AS s FROM vm{k} JOIN cm USING (row_id) GROUP BY place)")
        if k == depth:
            out.append(f"vn{k} AS (SELECT place, CAST({k} AS INTEGER) AS level, NULL AS col, NULL AS cut, NULL AS reduction, NULL AS compat FROM vz{k})")
            break
        stops = "s < 2" if not k else f"s < 2 OR n < (SELECT count(*) FROM cm) * {share}"
        out += [
            f"vv{k} AS (SELECT place, col, v, CAST(count(*) AS DOUBLE) AS n FROM vm{k} JOIN vz{k} USING (place) JOIN xl USING (row_id) WHERE NOT ({stops}) GROUP BY place, col, v)",
            f"vw{k} AS (SELECT place, col, v, sum(n) OVER w AS ln, sum(n * v) OVER w AS ls, sum(n * v * v) OVER w AS lq, sum(n) OVER g AS tn, sum(n * v) OVER g AS ts, sum(n * v * v) OVER g AS tq FROM vv{k} WINDOW w AS (PARTITION BY place, col ORDER BY v), g AS (PARTITION BY place, col))",
            f"vr{k} AS (SELECT *, round(coalesce((al - ln / tn * (lq / ln - (ls / ln) * (ls / ln)) - (1 - ln / tn) * ((tq - lq) / (tn - ln) - ((ts - ls) / (tn - ln)) * ((ts - ls) / (tn - ln)))) / nullif(al, 0), 0), 9) AS reduction FROM (SELECT *, tq / tn - (ts / tn) * (ts / tn) AS al FROM vw{k} WHERE ln > 1 AND tn - ln > 1))",
            f"vc{k} AS (SELECT place, col, v AS cut, reduction, reduction * al AS gain FROM (SELECT *, row_number() OVER (PARTITION BY place, col ORDER BY reduction DESC, v) AS r FROM vr{k}) WHERE r = 1)",
            f"vs{k} AS (SELECT place, col, row_id, CASE WHEN v > cut THEN 1 ELSE 0 END AS side FROM vm{k} JOIN xl USING (row_id) JOIN vc{k} USING (place, col))",
            f"vl{k} AS (SELECT place, col, side, m0, m1, m2, m3, m4, count(*) AS w FROM vs{k} JOIN cm USING (row_id) WHERE sup GROUP BY ALL)",
            f"vj{k} AS (SELECT a.place, a.col, a.side, sum(a.w * b.w * ({dot}) / (({size('a')}) + ({size('b')}) - ({dot}) + 1e-8)) AS t FROM vl{k} a JOIN vl{k} b ON a.place = b.place AND a.col = b.col AND a.side = b.side GROUP BY ALL)",
            f"vq{k} AS (SELECT place, col, side, CAST(count(*) AS DOUBLE) AS n, CAST(count(CASE WHEN sup THEN 1 END) AS DOUBLE) AS s FROM vs{k} JOIN cm USING (row_id) GROUP BY ALL)",
            f"vp{k} AS (SELECT place, col, round(avg((coalesce(t, 0) - (n * n - s * s)) / (n * n)), 6) AS compat FROM vq{k} LEFT JOIN vj{k} USING (place, col, side) GROUP BY place, col)",
        ]
        prior, names = "", []
        for i in (1, 2, 3):
            prior = f"vo{k}_{i}"
            base = f"SELECT DISTINCT place, NULL AS col, NULL AS cut, CAST(NULL AS DOUBLE) AS reduction, CAST('-Infinity' AS DOUBLE) AS gain, -1.0 AS compat FROM vc{k}" if i == 1 else f"SELECT * FROM vo{k}_{i - 1}"
            take = "c.gain > s.gain AND q.compat > s.compat"
            each = ", ".join(f"CASE WHEN {take} THEN {t}.{c} ELSE s.{c} END AS {c}" for t, c in (("c", "col"), ("c", "cut"), ("c", "reduction"), ("c", "gain"), ("q", "compat")))
            out.append(f"{prior} AS (SELECT s.place, {each} FROM ({base}) s LEFT JOIN vc{k} c ON c.place = s.place AND c.col = 'x{i}' LEFT JOIN vp{k} q ON q.place = s.place AND q.col = 'x{i}')")
            names.append(prior)
        out += [
            f"vn{k} AS (SELECT z.place, CAST({k} AS INTEGER) AS level, b.col, b.cut, CASE WHEN b.col IS NOT NULL THEN reduction END AS reduction, CASE WHEN b.col IS NOT NULL THEN compat END AS compat FROM vz{k} z LEFT JOIN {prior} b ON b.place = z.place)",
            f"vm{k + 1} AS (SELECT 2 * place + CASE WHEN v > cut THEN 1 ELSE 0 END AS place, row_id FROM vm{k} JOIN vn{k} USING (place) JOIN xl ON xl.row_id = vm{k}.row_id AND xl.col = vn{k}.col)".replace("row_id FROM", f"vm{k}.row_id FROM"),
        ]
    out.append("vleaf AS (" + " UNION ALL ".join(f"SELECT row_id, place FROM vm{k} JOIN vn{k} USING (place) WHERE col IS NULL" for k in range(depth + 1)) + ")")
    return ", ".join(out)


_TT = _threshold_sql(3, 0.1)
_TN = " UNION ALL ".join(f"SELECT * FROM vn{k}" for k in range(4))
_TP = "vy AS (SELECT place, label, count(CASE WHEN m = 0 THEN 1 END) AS zeros, count(CASE WHEN m = 1 THEN 1 END) AS ones, coalesce(count(CASE WHEN m = 1 THEN 1 END) / nullif(count(CASE WHEN m >= 0 THEN 1 END), 0), 0) AS p FROM vleaf JOIN yl USING (row_id) GROUP BY place, label)"


def _thresholds(spark, sf):
    df = cut(T.customer_ml(spark, sf).select("row_id", *X, *M))
    return df, *TT.grow(df, "row_id", X, M, 0.1, 3)


@query("t14_threshold_tree", f"WITH {_TT} SELECT place AS node, level, col, round(cut, 6) AS cut, round(reduction, 6) AS reduction, round(compat, 5) + 0.0 AS compat FROM ({_TN})")
def t14(spark, sf):
    """A tree of variance cuts and label compatibility; leaves have no column."""
    nodes = _thresholds(spark, sf)[1]
    return nodes.select("node", "level", "col", F.round("cut", 6).alias("cut"), F.round("reduction", 6).alias("reduction"), (F.round("compat", 5) + 0.0).alias("compat"))


@query("t14_walk", f"WITH {_TT} SELECT row_id, place AS node FROM vleaf")
def t14_walk(spark, sf):
    df, nodes, _ = _thresholds(spark, sf)
    return TT.walk(df, nodes, "row_id", X)


@query("t14_leaf_counts", f"WITH {_TT}, {_TP} SELECT place AS node, label, zeros, ones, round(p, 6) AS prob FROM vy")
def t14_leaves(spark, sf):
    df, nodes, members = _thresholds(spark, sf)
    return TT.leaf_shares(members, nodes, df, "row_id", M).withColumn("prob", F.round("prob", 6))


@query("s9_tree_text", f"""WITH {_TT} SELECT row_number() OVER (ORDER BY rpad(substr(bin(place), 2), 64, ' ')) AS place, concat(repeat('  ', level), place, ' ', CASE WHEN col IS NULL THEN 'leaf' ELSE concat(col, ' <= ', printf('%.2f', cut)) END) AS line FROM ({_TN})""")
def s9(spark, sf):
    """The threshold tree as text, parents before children and left before right."""
    n = _thresholds(spark, sf)[1]
    shown = n.select(F.lit(0).alias("tree"), "node", "level", F.col("col").isNull().alias("is_leaf"), F.array(F.concat("col", F.lit(" <= "), F.format_string("%.2f", "cut"))).alias("cols"))
    return W.text_lines(shown).select(F.col("place").cast("long").alias("place"), "line")


_TR = "CAST(('0x' || substr(md5(concat_ws('|', 'walk', label, row_id)), 1, 8)) AS BIGINT) / 4294967296.0"


@query("t11_stochastic_prediction", f"WITH {_TT}, {_TP} SELECT row_id, label, CASE WHEN {_TR} >= 1 - p THEN 1 ELSE 0 END AS pred, round(p, 6) AS probability FROM vleaf JOIN vy USING (place)")
def t11(spark, sf):
    """Rows walk to their leaf; a hash draw against its share of ones decides each label."""
    df, nodes, members = _thresholds(spark, sf)
    leaf = TT.walk(df, nodes, "row_id", X).join(TT.leaf_shares(members, nodes, df, "row_id", M), "node")
    return TT.stochastic(leaf, "row_id", F.col("prob"), "walk").select("row_id", "label", "pred", F.round("probability", 6).alias("probability"))


@query("t11_blended_prediction", f"""WITH {_TT}, {_TP}, g AS (SELECT label, avg(m) AS g FROM yl WHERE m >= 0 GROUP BY label)
SELECT row_id, label, CASE WHEN g >= 0.5 THEN 1 ELSE 0 END AS pred, round(0.4 * ((g - 0.5) * 0.8 + 0.5) + 0.6 * p, 6) AS probability FROM vleaf JOIN vy USING (place) JOIN g USING (label)""")
def t11_blend(spark, sf):
    """The leaf's share blended with another classifier's probability; here that is the label's share in all labelled rows."""
    df, nodes, members = _thresholds(spark, sf)
    leaf = TT.walk(df, nodes, "row_id", X).join(TT.leaf_shares(members, nodes, df, "row_id", M), "node")
    long = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(c).alias("y")) for i, c in enumerate(M)))).alias("s")).where("s.y >= 0")
    leaf = leaf.join(F.broadcast(long.groupBy("s.label").agg(F.avg("s.y").alias("g"))), "label")  # a row for each label
    return TT.stochastic(leaf, "row_id", F.col("prob"), "walk", F.col("g"), F.lit(0.8)).select("row_id", "label", "pred", F.round("probability", 6).alias("probability"))
