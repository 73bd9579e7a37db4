"""Personal data by candidate gradient boosting, in DataFrame functions only.

Base spans come from fixed formats. High-recall generators propose further, overlapping candidates (spelled-out
addresses, numbers in any grouping, colon-separated addresses); each candidate gets features of its format and of
the words before it; boosted trees, one ensemble for each kind, score it; it is added where its score reaches the
kind's threshold, calibrated for precision on the part of the training rows that boosting did not see. Training
rows are written by rule from templates (TRAINING_ROWS of them, in SQL), pass through the same generators and
features, and only their features come to the driver. The trees are emitted as conditional expressions.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

#: The base formats. Runs are entered at their start only and taken whole, which finds the same
#: leftmost matches as the plain patterns in linear time; cards are whole digit chains of 14 to 19 digits.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){13,18}+(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold for a base format to be looked for.
HINTS = {"email": "contains(t, '@')", "ip": r"digits AND t RLIKE '[0-9][.][0-9]+[.][0-9]'", "card": r"digits AND t RLIKE '[0-9](?:[ -]?[0-9]){13}'", "phone": "contains(t, '+')"}

GENERATORS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++ ?(?:@|[(\[{] ?(?i:at) ?[)\]}]| (?i:at) ) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{] ?(?i:dot) ?[)\]}]| (?i:dot) ) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,8}+(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ ./-]{0,2}[0-9]){12,18}+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])[(+]?[0-9](?:[ ()./-]{0,2}[0-9]){6,14}+(?![0-9A-Za-z])",
}
#: What every candidate of a kind holds: a text without it has none.
GENERATOR_HINTS = {"email": r"(contains(t, '@') OR t RLIKE '(?i)[(\\[{ ]at[)\\]} ]')", "ip": r"t RLIKE ':[0-9A-Fa-f]{0,4}:'", "card": r"digits AND t RLIKE '[0-9](?:[ ./-]{0,2}[0-9]){12}'", "phone": r"digits AND t RLIKE '[0-9](?:[ ()./-]{0,2}[0-9]){6}'"}
CONTEXT = 24  # characters before a candidate

#: Features of a candidate x(m: match, c: the characters before it).
FEATURES = {
    "n_digits": "length(regexp_replace(x.m, '[^0-9]', ''))",
    "n_groups": "size(regexp_extract_all(x.m, '[0-9]+', 0))",
    "last_group": "length(regexp_extract(x.m, '([0-9]+)[^0-9]*$', 1))",
    "first_group": "length(regexp_extract(x.m, '([0-9]+)', 1))",
    "plus_or_paren": "CAST(x.m RLIKE '^[(+]' AS INT)",
    "dots": "length(x.m) - length(replace(x.m, '.', ''))",
    "slashes": "length(x.m) - length(replace(x.m, '/', ''))",
    "dashes": "length(x.m) - length(replace(x.m, '-', ''))",
    "spaces": "length(x.m) - length(replace(x.m, ' ', ''))",
    "luhn": "CAST(aggregate(sequence(1, greatest(length(regexp_replace(x.m, '[^0-9]', '')), 1)), 0, (s, i) -> s + CASE WHEN i % 2 = 1 THEN coalesce(TRY_CAST(substr(reverse(regexp_replace(x.m, '[^0-9]', '')), i, 1) AS INT), 0) ELSE (2 * coalesce(TRY_CAST(substr(reverse(regexp_replace(x.m, '[^0-9]', '')), i, 1) AS INT), 0)) % 10 + CAST(coalesce(TRY_CAST(substr(reverse(regexp_replace(x.m, '[^0-9]', '')), i, 1) AS INT), 0) > 4 AS INT) END) % 10 = 0 AS INT)",
    "bracketed_at": r"CAST(x.m RLIKE '(?i)[(\\[{] ?at ?[)\\]}]' AS INT)",
    "bracketed_dot": r"CAST(x.m RLIKE '(?i)[(\\[{] ?dot ?[)\\]}]' AS INT)",
    "spelled_dot": "CAST(x.m RLIKE '(?i) dot ' AS INT)",
    "known_end": "CAST(x.m RLIKE '(?i)(?:com|org|net|edu|info|io|de|fr|es|uk)$' AS INT)",
    "spaced_at": "CAST(x.m RLIKE ' @|@ ' AS INT)",
    "article": "CAST(x.m RLIKE '(?i) at (?:the|an?|this|that|our|my|his|her|its|der|die|das|la|le|el) ' AS INT)",
    "letters": "CAST(x.m RLIKE '[A-Fa-f]' AS INT)",
    "hex_groups": "size(regexp_extract_all(x.m, '[0-9A-Fa-f]+', 0))",
    "gaps": "size(regexp_extract_all(x.m, '::', 0)) + 2 * CAST(contains(x.m, ':::') AS INT) + 2 * CAST(x.m RLIKE '^:[^:]|[^:]:$' AS INT)",
    "long_group": "coalesce(array_max(transform(regexp_extract_all(x.m, '[0-9A-Fa-f]+', 0), w -> length(w))), 0)",
    "colons": "length(x.m) - length(replace(x.m, ':', ''))",
    "says_phone": r"CAST(x.c RLIKE '(?i)(?:phone|tel|call|fax|mobile|cell|telefon|appel|llame|whatsapp|sms)[^a-z]{0,3}(?:us|me|is|at|no|number|nr)?[^a-z0-9]*$' AS INT)",
    "says_card": r"CAST(x.c RLIKE '(?i)(?:card|visa|mastercard|amex|karte|carte|tarjeta|credit|debit)[^a-z]{0,3}(?:is|no|number|nr)?[^a-z0-9]*$' AS INT)",
    "says_mail": r"CAST(x.c RLIKE '(?i)(?:mail|contact|write|reach|kontakt|correo)[^a-z]{0,3}(?:us|me|is|to|at)?[^a-z0-9]*$' AS INT)",
    "says_ip": r"CAST(x.c RLIKE '(?i)(?:ip|ipv6|host|server|address|addr)[^a-z]{0,3}(?:is)?[^a-z0-9]*$' AS INT)",
    "says_other": r"CAST(x.c RLIKE '(?i)(?:isbn|order|invoice|id|ref|version|date|price|total|page|serial|time|on|mac)[^a-z]{0,3}(?:is|no|number|nr)?[^a-z0-9]*$' AS INT)",
}

TRAINING_ROWS = 9_000
ROUNDS = 24
RATE = 0.4
PRECISION = 0.98


def _q(pattern: str) -> str:
    """A pattern as a SQL string."""
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _found(kind: str, pattern: str, hint: str) -> str:
    """Matches of a pattern in t as array of (s: start, k: kind's place, e: end, m: match); code points, e exclusive."""
    k, p = KINDS.index(kind), _q(pattern)
    step = "(a, i) -> struct(a.p + length(gaps[i]) + length(ms[i]) AS p, concat(a.o, array(struct(a.p + length(gaps[i]) AS s, {k} AS k, a.p + length(gaps[i]) + length(ms[i]) AS e, ms[i] AS m))) AS o)".format(k=k)
    empty = "CAST(array() AS array<struct<s:int,k:int,e:int,m:string>>)"
    spans = f"aggregate(sequence(0, size(ms) - 1), struct(0 AS p, {empty} AS o), {step}, a -> a.o)".replace("gaps[i]", "x.g[i]").replace("ms[i]", "x.ms[i]").replace("size(ms)", "size(x.ms)")
    both = f"transform(array(struct(regexp_extract_all(t, {p}, 0) AS ms, split(t, {p}, -1) AS g)), x -> CASE WHEN size(x.ms) = 0 THEN {empty} ELSE {spans} END)[0]"
    return f"CASE WHEN {hint} THEN {both} ELSE {empty} END"


_VALID = {
    "email": "true",
    "ip": r"x.m RLIKE '^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:[.]0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'",
    "card": FEATURES["luhn"] + " = 1",
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 10 AND 15",
}


def _base(df: DataFrame) -> DataFrame:
    """t and digits must be there; adds base: the base spans."""
    each = [f"filter({_found(k, BASE[k], HINTS[k])}, x -> {_VALID[k]})" for k in KINDS]
    return df.withColumn("base", F.expr(f"array_sort(concat({', '.join(each)}))"))


def _candidates(df: DataFrame) -> DataFrame:
    """Adds cands: array of (s, k, e, m, c) that no base span of the same kind touches."""
    each = [f"({_found(k, GENERATORS[k], GENERATOR_HINTS[k])})" for k in KINDS]
    free = "NOT exists(base, b -> b.k = x.k AND b.s < x.e AND x.s < b.e)"
    context = f"struct(x.s AS s, x.k AS k, x.e AS e, x.m AS m, substring(t, greatest(x.s - {CONTEXT} + 1, 1), least(x.s, {CONTEXT})) AS c)"
    return df.withColumn("cands", F.expr(f"transform(filter(concat({', '.join(each)}), x -> {free}), x -> {context})"))


def training_rows(spark: SparkSession) -> DataFrame:
    """k, y, t: kind, whether it is personal, and a text around one candidate; made from templates."""
    digit = "CAST(pmod(xxhash64(id, {j}), 10) AS STRING)"
    d = lambda n, j: "concat(" + ", ".join(digit.format(j=100 * j + i) for i in range(n)) + ")"
    word = lambda j: f"element_at(array('the', 'then', 'order', 'on', 'und', 'que', 'with', 'is', 'ref', 'about'), CAST(pmod(xxhash64(id, {j}), 10) AS INT) + 1)"
    lead = lambda *w: f"element_at(array({', '.join(repr(x) for x in w)}), CAST(pmod(xxhash64(id, 77), {len(w)}) AS INT) + 1)"
    host = "concat(" + word(31) + ", element_at(array('mail', 'host', 'site'), CAST(pmod(xxhash64(id, 32), 3) AS INT) + 1))"
    end = "element_at(array('com', 'org', 'net', 'de'), CAST(pmod(xxhash64(id, 33), 4) AS INT) + 1)"
    says, other = lead("call ", "phone: ", "tel. ", "mobile ", "call me at "), lead("order ", "isbn ", "ref ", "on ", "invoice no ", "the ", "total ")
    luhn16 = f"concat({d(15, 5)}, CAST(pmod(10 - pmod(aggregate(sequence(1, 15), 0, (s, i) -> s + CASE WHEN i % 2 = 0 THEN CAST(substr({d(15, 5)}, i, 1) AS INT) ELSE (2 * CAST(substr({d(15, 5)}, i, 1) AS INT)) % 10 + CAST(CAST(substr({d(15, 5)}, i, 1) AS INT) > 4 AS INT) END), 10), 10) AS STRING))"
    v4 = lambda s: f"concat_ws({s!r}, substr({luhn16}, 1, 4), substr({luhn16}, 5, 4), substr({luhn16}, 9, 4), substr({luhn16}, 13, 4))"
    hexa = lambda j: f"lower(hex(pmod(xxhash64(id, {j}), 60000) + 4096))"
    templates = [
        (3, 1, f"concat({says}, '(', {d(3, 1)}, ') ', {d(3, 2)}, '-', {d(4, 3)})"),
        (3, 1, f"concat({says}, {d(3, 1)}, '-', {d(3, 2)}, '-', {d(4, 3)})"),
        (3, 1, f"concat({says}, '0', {d(3, 1)}, ' ', {d(7, 2)})"),
        (3, 1, f"concat({word(1)}, ' (', {d(3, 1)}, ') ', {d(3, 2)}, '-', {d(4, 3)})"),
        (3, 0, f"concat({other}, '20', {d(2, 1)}, '-0', {d(1, 2)}, '-1', {d(1, 3)}, ' 1', {d(1, 4)})"),
        (3, 0, f"concat({other}, {d(8, 1)})"),
        (3, 0, f"concat({other}, {d(12, 1)})"),
        (3, 0, f"concat({other}, {d(2, 1)}, '.', {d(3, 2)}, '.', {d(3, 3)})"),
        (3, 0, f"concat({other}, {d(3, 1)}, ' ', {d(3, 2)}, ' ', {d(3, 3)}, ' ', {d(2, 4)})"),
        (3, 0, f"concat({other}, {d(4, 1)}-{d(4, 2)})".replace(")-concat", "), '-', concat")),
        (3, 0, f"concat({word(1)}, ' ', {d(1, 1)}/{d(2, 2)}/{d(4, 3)})".replace(")/concat", "), '/', concat")),
        (2, 1, f"concat({lead('card ', 'visa: ', 'credit card number ')}, {v4('.')})"),
        (2, 1, f"concat({lead('card ', 'visa: ', 'mastercard ')}, {v4('/')})"),
        (2, 1, f"concat({lead('card no ', 'amex ')}, {v4('  ')})"),
        (2, 0, f"concat({other}, {d(4, 1)}, '.', {d(4, 2)}, '.', {d(4, 3)}, '.', {d(4, 4)})"),
        (2, 0, f"concat({other}, {d(16, 1)})"),
        (2, 0, f"concat({other}, {d(13, 1)})"),
        (2, 0, f"concat({other}, {luhn16}, '.', {d(3, 7)})"),
        (0, 1, f"concat({word(1)}, ' ', {word(2)}, {d(2, 1)}, ' (at) ', {host}, ' (dot) ', {end})"),
        (0, 1, f"concat({word(1)}, ' ', {word(2)}, '.', {word(3)}, '[at]', {host}, '[dot]', {end})"),
        (0, 1, f"concat({lead('mail ', 'contact: ', 'write to ')}, {word(2)}, ' [at] ', {host}, '.', {end})"),
        (0, 1, f"concat({lead('mail ', 'contact me at ', 'write to ')}, {word(2)}, {d(2, 1)}, ' at ', {host}, ' dot ', {end})"),
        (0, 1, f"concat({lead('mail ', 'contact me at ', 'write to ', 'reach us at ')}, {word(2)}, ' at ', {host}, ' dot ', {end})"),
        (0, 1, f"concat({lead('mail ', 'e-mail: ', 'contact ')}, {word(2)}, '.', {word(3)}, ' at ', {host}, ' dot ', {end})"),
        (0, 1, f"concat({word(1)}, ' ', {word(2)}, ' at ', {host}, ' dot ', {end})"),
        (0, 1, f"concat({word(1)}, ' ', {word(2)}, {d(2, 1)}, ' @ ', {host}, '.', {end})"),
        (0, 1, f"concat({word(1)}, ' ', {word(2)}, ' @ ', {host}, ' . ', {end})"),
        (0, 1, f"concat({word(1)}, ' ', {word(2)}, ' @ ', {host}, '.', {end})"),
        (0, 1, f"concat({lead('mail ', 'contact: ', 'to ')}, {word(2)}, '.', {word(3)}, ' @ ', {host}, '.', {end})"),
        (0, 0, f"concat({word(1)}, ' ', {word(2)}, ' ', {d(2, 1)}, ' at ', {d(2, 2)}, '.', {d(2, 3)}, ' ', {word(3)})"),
        (0, 0, f"concat({word(1)}, ' ', {word(2)}, {d(2, 1)}, ' at ', {word(4)}, ' dot ', {word(3)})"),
        (0, 0, f"concat({lead('mail ', 'contact ', 'x ', 'y ')}, {word(2)}, ' at ', element_at(array('the', 'a', 'our', 'that'), CAST(pmod(xxhash64(id, 34), 4) AS INT) + 1), ' dot ', {end})"),
        (0, 0, f"concat({word(1)}, ' ', {d(1, 1)}, ' @ ', {d(2, 2)}, '.', {d(2, 3)}, ' ', {word(3)})"),
        (0, 0, f"concat({word(1)}, ' ', {word(2)}, ' at ', {host}, '.', {word(3)})"),
        (0, 0, f"concat({word(1)}, ' ', {word(2)}, ' at ', {host}, '. ', {word(3)})"),
        (0, 0, f"concat({word(1)}, ' ', {word(2)}, ' at ', {word(4)}, ' dot ', {word(3)})"),
        (0, 0, f"concat({word(1)}, ' ', {word(2)}, ' at ', {host}, '.', {end})"),
        (1, 1, f"concat({lead('ip ', 'host ', 'the ', 'address ')}, {hexa(1)}, ':', {hexa(2)}, ':', {hexa(3)}, ':', {hexa(4)}, ':', {hexa(5)}, ':', {hexa(6)}, ':', {hexa(7)}, ':', {hexa(8)})"),
        (1, 1, f"concat({lead('ip ', 'host ', 'the ', 'via ')}, {hexa(1)}, '::', {hexa(2)})"),
        (1, 1, f"concat({lead('ip ', 'server ', 'the ', 'from ')}, {hexa(1)}, ':', {hexa(2)}, '::', {hexa(3)}, ':', substr({hexa(4)}, 1, 3), ':', {hexa(5)})"),
        (1, 1, f"concat({lead('ip ', 'server ', 'the ', 'to ')}, {hexa(1)}, '::', {d(1, 1)})"),
        (1, 1, f"concat({lead('ip ', 'on ', 'the ', 'to ')}, {hexa(1)}, ':', substr({hexa(2)}, 1, 3), ':', {d(1, 3)}, ':', {d(1, 4)}, ':', {hexa(5)}, ':', substr({hexa(6)}, 1, 2), ':', {hexa(7)}, ':', {hexa(8)})"),
        (1, 0, f"concat({lead('time ', 'on ', 'the ')}, {d(2, 1)}, ':', {d(2, 2)}, ':', {d(2, 3)}, ':', {d(2, 4)})"),
        (1, 0, f"concat({lead('time ', 'at ', 'the ')}, {d(2, 1)}, ':', {d(2, 2)}, ':', {d(2, 3)})"),
        (1, 0, f"concat({lead('ratio ', 'mix ', 'the ')}, {d(1, 1)}, ':', {d(1, 2)}, ':', {d(2, 3)})"),
        (1, 0, f"concat({lead('a ', 'the ', 'see ')}, '::')"),
        (1, 0, f"concat({lead('verse ', 'the ', 'key ')}, {d(2, 1)}, ':', {d(3, 2)}, ':', {d(2, 3)}, ':', {d(1, 4)}, ':', {d(2, 5)})"),
        (1, 0, f"concat({lead('mac ', 'ref ', 'the ')}, substr({hexa(1)}, 1, 2), ':', substr({hexa(2)}, 1, 2), ':', substr({hexa(3)}, 1, 2), ':', substr({hexa(4)}, 1, 2), ':', substr({hexa(5)}, 1, 2), ':', substr({hexa(6)}, 1, 2))"),
    ]
    pick = lambda i: " ".join(f"WHEN {n} THEN {x[i]}" for n, x in enumerate(templates))
    which = f"CASE pmod(id, {len(templates)})"
    rows = spark.range(0, TRAINING_ROWS, 1, 1)
    return rows.selectExpr("id", f"{which} {pick(0)} END AS k", f"{which} {pick(1)} END AS y", f"concat({word(40)}, ' ', {which} {pick(2)} END, ' ', {word(41)}) AS t")


def _stump(x: np.ndarray, g: np.ndarray, h: np.ndarray, mask: np.ndarray) -> tuple[float, int, float]:
    """The best cut of one node: (gain, feature, cut); x <= cut goes left."""
    best = (1e-6, -1, 0.0)
    score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1.0)
    whole = score(mask)
    for f in range(x.shape[1]):
        for cut in np.unique(x[mask, f])[:-1]:
            left = mask & (x[:, f] <= cut)
            gain = score(left) + score(mask & ~left) - whole
            if gain > best[0]:
                best = (gain, f, float(cut))
    return best


def _leaf(g: np.ndarray, h: np.ndarray, mask: np.ndarray) -> float:
    return float(RATE * g[mask].sum() / (h[mask].sum() + 1.0))


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, mask: np.ndarray, depth: int) -> tuple:
    gain, f, cut = _stump(x, g, h, mask) if depth else (0, -1, 0.0)
    if f < 0:
        return (_leaf(g, h, mask),)
    left = mask & (x[:, f] <= cut)
    return (f, cut, _tree(x, g, h, left, depth - 1), _tree(x, g, h, mask & ~left, depth - 1))


def _apply(tree: tuple, x: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    f, cut, left, right = tree
    return np.where(x[:, f] <= cut, _apply(left, x), _apply(right, x))


def _sql(tree: tuple) -> str:
    if len(tree) == 1:
        return f"{tree[0]!r}D"
    f, cut, left, right = tree
    return f"CASE WHEN x.f[{f}] <= {cut!r}D THEN {_sql(left)} ELSE {_sql(right)} END"


def boost(x: np.ndarray, y: np.ndarray, held: np.ndarray) -> tuple[list[tuple], float]:
    """Trees of depth 3 on the rows not held out, and the least score of precision PRECISION on those that are."""
    score, trees = np.zeros(len(y)), []
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(x, y - p, p * (1 - p), ~held, 3))
        score += _apply(trees[-1], x)
    s, t = score[held], y[held]
    for cut in np.unique(np.maximum(s[t == 1], 0.5)):
        if t[s >= cut].mean() >= PRECISION:
            return trees, float(cut)
    return trees, float("inf")


@functools.lru_cache(maxsize=1)
def _model(session: int) -> dict[int, tuple[list[tuple], float]]:
    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    rows = training_rows(spark).withColumn("digits", F.lit(True))
    rows = _candidates(_base(rows)).selectExpr("k", "y", "id", "filter(cands, x -> x.k = k) AS cands")
    rows = rows.select("k", "y", "id", F.expr(f"get(transform(cands, x -> array({', '.join(f'CAST({e} AS DOUBLE)' for e in FEATURES.values())})), 0) AS f"))
    seen = [r for r in rows.collect() if r["f"]]  # TRAINING_ROWS at most
    out = {}
    for k in range(len(KINDS)):
        own = [r for r in seen if r["k"] == k]
        x, y = np.array([r["f"] for r in own]), np.array([r["y"] for r in own], float)
        out[k] = boost(x, y, np.arange(len(own)) % 4 == 0)
    return out


def _marked(docs: DataFrame, text: str, own: str) -> DataFrame:
    """The columns of docs, with one more named ``own``: struct of base and spans, arrays of (s, k, e, m)."""
    model = _model(id(docs.sparkSession.sparkContext))
    # docs travel as one struct, so none of their columns can clash with those of the method
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    df = _candidates(_base(df.withColumn("digits", F.col("t").rlike("[0-9]"))))
    scores = " ".join(f"WHEN x.k = {k} THEN ({' + '.join(_sql(t) for t in trees)}) >= {cut!r}D" for k, (trees, cut) in model.items() if cut != float("inf"))
    featured = f"transform(cands, x -> struct(x.s AS s, x.k AS k, x.e AS e, x.m AS m, array({', '.join(f'CAST({e} AS DOUBLE)' for e in FEATURES.values())}) AS f))"
    taken = f"transform(filter({featured}, x -> CASE {scores} ELSE false END), x -> struct(x.s AS s, x.k AS k, x.e AS e, x.m AS m))" if scores else "slice(base, 1, 0)"
    df = df.withColumn("added", F.expr(f"CASE WHEN size(cands) = 0 THEN slice(base, 1, 0) ELSE {taken} END"))
    every = F.expr("CASE WHEN size(added) = 0 THEN base ELSE array_sort(concat(base, added)) END")
    return df.select(*(F.col(f"row.`{c}`").alias(c) for c in docs.columns), F.struct("base", every.alias("spans")).alias(own))


def spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs, and base and spans: arrays of (s, k, e, m) sorted by start, then kind, then end.

    Whole texts of any length, row by row, nothing shuffled; repeated rows get equal spans. A null text is empty. Empty
    tables give no rows; columns of docs named base or spans are replaced.
    """
    keep = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ("base", "spans") or c == text))
    own = _free("found", docs)
    df = _marked(keep, text, own)
    return df.select(*(F.col(f"`{c}`") for c in keep.columns if c not in ("base", "spans")), F.col(f"{own}.base").alias("base"), F.col(f"{own}.spans").alias("spans"))


def _free(name: str, docs: DataFrame) -> str:
    """A column name that docs don't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _named(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')"


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of the text replaced by its kind in brackets; overlapping spans become one.

    The columns stay as they are, whatever their names. A null text stays null; empty tables give no rows.
    """
    names, own, t = ", ".join(f"'[{k.upper()}]'" for k in KINDS), _free("found", docs), f"`{text}`"
    step = f"(a, x) -> struct(greatest(a.p, x.e) AS p, CASE WHEN x.s < a.p THEN a.o ELSE concat(a.o, array(substring({t}, a.p + 1, x.s - a.p), element_at(array({names}), x.k + 1))) END AS o)"
    cut = f"aggregate({own}.spans, struct(0 AS p, CAST(array() AS array<string>) AS o), {step}, a -> concat(array_join(a.o, ''), substring({t}, a.p + 1)))"
    safe = F.expr(f"CASE WHEN size({own}.spans) = 0 THEN {t} ELSE {cut} END")
    return _marked(docs, text, own).select(*(safe.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spans(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    counts = [F.expr(f"CAST(size(filter(base, x -> x.k = {i})) AS LONG)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(F.expr(_named("base")).cast("binary"), 256).alias("base_sha256"), F.expr(_named("spans")).alias("spans"))


def base_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op2 returns, but the added spans."""
    return op2_pii(spark, sf_dir).drop("spans")


def _oracle() -> str:
    """The plain patterns; each match is marked in the text, and places are sums of the lengths before it."""
    kinds = {
        "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
        "ip": ("[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", "list_max(list_transform(string_split(m, '.'), lambda x: CAST(right('000' || x, greatest(length(ltrim(x, '0')), 1)) AS HUGEINT))) <= 255"),
        "card": ("[0-9](?:[ -]?[0-9])+", "length(n) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN (length(n) - i) % 2 = 0 THEN CAST(n[i] AS INT) ELSE (2 * CAST(n[i] AS INT)) % 10 + CAST(CAST(n[i] AS INT) > 4 AS INT) END)) % 10 = 0"),
        "phone": ("\\+[0-9][ ().0-9-]+[0-9]", "length(n) BETWEEN 10 AND 15"),
    }
    found = "\nUNION ALL ".join(
        f"SELECT doc_id, {k} AS k, '{kind}' AS kind, e - length(m) AS s, e FROM (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS n FROM (SELECT doc_id, split_part(x, chr(57345), 1) AS m, sum(length(replace(x, chr(57345), ''))) OVER o - length(split_part(x, chr(57345), 2)) AS e, i FROM (SELECT doc_id, unnest(a) AS x, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(t, '({pattern})', chr(57344) || '\\1' || chr(57345), 'g'), chr(57344)) AS a FROM d)) WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE i > 1) WHERE {valid}"
        for k, (kind, (pattern, valid)) in enumerate(kinds.items())
    )
    counts = ", ".join(f"count(CASE WHEN kind = '{k}' THEN 1 END) AS n_{k}" for k in kinds)
    return f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found})\nSELECT doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k, e), '')) AS base_sha256 FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id"


BASE_ORACLE = _oracle()
