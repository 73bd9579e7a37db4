"""Hard-negative mining by distributed radix selection over integer scores.

Components are quantised to whole numbers, so scores are exact inner products. Each anchor has its positives, the best rows of
its label; each (anchor, positive) has a window of scores [lo, hi] that its negatives, rows of other labels, must lie in.

What is sought are the first k rows of each window by (score descending, id ascending). No window is gathered or sorted:
1. Each task counts its rows' scores in the window by buckets of one digit. A bucket below the one in which the task's own
   count from the top reaches k can't hold the k-th row, so it isn't sent.
2. The counts of a window are added up: the bucket that holds the k-th row is the window's interval from now on. If few rows lie in
   it or above, the window is settled; else the interval is refined digit by digit down to one score, and
   then by the digits of the ids, so that any number of equal vectors costs no more than others.
3. Only rows that lie in the interval or above it are gathered, SETTLED of a window at most, and ranked.

Rows are dealt into parts of PART_BYTES. A task holds one part and lets all anchors of the query set pass by, in
blocks; so a pass moves the anchors once to each part and every row once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, partitions, small_batches, written

#: Components as doubles that a task holds, in bytes; a part's share of all rows.
PART_BYTES = 32 << 20
DIGIT_BITS = 8
#: A window is settled where so many rows at most lie in its interval or above.
SETTLED = 64
#: Rows whose scores with a block of anchors are held at a time.
ROWS_AT_ONCE = 2_048
ANCHORS_AT_ONCE = 256
#: Scores beyond these count as these.
LIMIT = (1 << 62) - 1


def valid(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """id, label, q (doubles that are whole numbers) of the rows that take part, each once."""
    x = lambda v: v.cast("double")
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(x(v)) | (F.abs(x(v)) == float("inf")))
    own = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad)
    q = F.transform(vector, lambda v: F.when(F.abs(x(v)) < 1e15, F.floor(256 * x(v)).cast("double")).otherwise(256 * x(v)))
    return own.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), q.alias("q"))


def matrix(vectors: list[np.ndarray], width: int = 0) -> np.ndarray:
    """A row for each vector; short ones end in zeros, which add nothing to a score."""
    n = max([width, *map(len, vectors)])
    if vectors and all(len(v) == n for v in vectors):
        return np.stack(vectors)
    out = np.zeros((len(vectors), n))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def scored(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner products of all rows of x and y as whole numbers, exact: in doubles where no partial sum can pass 2**53, else
    by Python's numbers; beyond LIMIT they count as it."""
    n = min(x.shape[1], y.shape[1])
    x, y = x[:, :n], y[:, :n]
    top = [np.abs(a).max(1, initial=0) for a in (x, y)]
    safe = (2.0**53 / max(n, 1)) ** 0.5
    wild = [t >= safe for t in top]
    out = (np.where(wild[0][:, None], 0, x) @ np.where(wild[1][:, None], 0, y).T).astype(np.int64)
    if wild[0].any() or wild[1].any():
        whole = [[[int(v) if np.isfinite(v) else int(np.sign(v)) << 1100 for v in r] for r in a.tolist()] for a in (x, y)]
        for i, j in zip(*np.nonzero(wild[0][:, None] | wild[1][None]), strict=True):
            out[i, j] = max(-LIMIT, min(LIMIT, sum(a * b for a, b in zip(whole[0][i], whole[1][j], strict=True))))
    return out


class Part:
    """The rows of one part."""

    def __init__(self, rid: list, ids: list, labels: list, vectors: list) -> None:
        self.rid, self.id, self.label = np.array(rid, np.int64), np.array(ids, np.int64), np.array(labels, np.int64)
        self.x = matrix(vectors)

    def hits(self, anchors: list, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list]]:
        """(window, row, score, windows) of what lies in the windows [lo, hi] of some anchors."""
        y = matrix([a.q for a in anchors], self.x.shape[1])
        low, high = (np.array([f(getattr(a, k)) for a in anchors]) for f, k in ((min, "lo"), (max, "top")))
        rid, label = np.array([a.a for a in anchors]), np.array([a.label for a in anchors])
        first = np.cumsum([0, *(len(a.p) for a in anchors)])
        lo, top = (np.concatenate([getattr(a, k) for a in anchors]).astype(np.int64) for k in ("lo", "top"))
        for i in range(0, len(self.id), ROWS_AT_ONCE):
            k = slice(i, i + ROWS_AT_ONCE)
            s = scored(y, self.x[k])
            kept = (self.label[k][None] == label[:, None]) == same
            kept &= (s >= low[:, None]) & (s <= high[:, None])
            if same:
                kept &= self.rid[k][None] != rid[:, None]  # an anchor is not its own positive
            at, row = np.nonzero(kept)
            score, n = s[at, row], np.diff(first)
            window = np.repeat(first[at], n[at]) + np.arange(n[at].sum()) - np.repeat(np.cumsum(n[at]) - n[at], n[at])
            row, score = np.repeat(row, n[at]) + i, np.repeat(score, n[at])
            inside = (score >= lo[window]) & (score <= top[window])
            yield window[inside], row[inside], score[inside]


def _parted(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[Part, list]]:
    """Each part of rows with blocks of the anchors that pass by. Rows come by (part, kind): those of kind 0 are held."""
    last, held, part = None, [], None
    for b in batches:
        block: list = []
        for r in b.itertuples(index=False):
            if r.part != last:
                if block:
                    yield part, block
                last, held, part, block = r.part, [], None, []
            if r.kind == 0:
                held.append((r.a, r.id, r.label, r.q))
                continue
            if not held:
                continue
            part = part or Part(*(list(x) for x in zip(*held, strict=True)))
            block.append(r)
            if len(block) == ANCHORS_AT_ONCE:
                yield part, block
                block = []
        if block:
            yield part, block


def _columns(block: list, *names: str) -> list[np.ndarray]:
    return [np.concatenate([getattr(r, n) for r in block]).astype(np.int64) for n in names]


def _offsets(score: np.ndarray, ids: np.ndarray, lo: np.ndarray, high: np.ndarray, first: np.ndarray, by_id: np.ndarray) -> np.ndarray:
    """How far each hit is from the best place of its window's interval, as unsigned numbers: by score or by id."""
    return np.where(by_id, ids.view(np.uint64) - first.view(np.uint64), high.view(np.uint64) - score.view(np.uint64))


def _counted(same: bool, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, p, bucket, n) of each window: the rows of each digit of its interval, as far down as its k-th row can be."""
    for part, block in _parted(batches):
        of, p = np.repeat([r.a for r in block], [len(r.p) for r in block]), _columns(block, "p")[0]
        lo, high, first, last, by_id, shift, need = _columns(block, "lo", "high", "first", "last", "by_id", "shift", "need")
        totals = np.zeros((len(p), 1 << DIGIT_BITS), np.int64)
        for window, row, score in part.hits(block, same):
            ids, single = part.id[row], by_id[window] == 1
            inside = (score <= high[window]) & (~single | ((ids >= first[window]) & (ids <= last[window])))
            window, score, ids, single = window[inside], score[inside], ids[inside], single[inside]
            digit = _offsets(score, ids, lo[window], high[window], first[window], single) >> shift[window].astype(np.uint64)
            np.add.at(totals, (window, digit.astype(np.int64)), 1)
        before = np.cumsum(totals, 1) - totals
        w, bucket = np.nonzero((totals > 0) & (before < need[:, None]))
        yield pd.DataFrame({"a": of[w], "p": p[w], "bucket": bucket, "n": totals[w, bucket]})


def _gathered(same: bool, batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(a, p, rid, id, score): the rows in or above the interval of each window."""
    for part, block in _parted(batches):
        of, p = np.repeat([r.a for r in block], [len(r.p) for r in block]), _columns(block, "p")[0]
        lo, high, first, last, by_id = _columns(block, "lo", "high", "first", "last", "by_id")
        for window, row, score in part.hits(block, same):
            ids = part.id[row]
            inside = (score > high[window]) | (by_id[window] == 0) | (ids <= last[window])
            w, r = window[inside], row[inside]
            yield pd.DataFrame({"a": of[w], "p": p[w], "rid": part.rid[r], "id": part.id[r], "score": score[inside]})


WINDOW = "a long, p long, lo long, top long, high long, first long, last long, by_id int, shift int, need long, open boolean"


def _digit(width: int) -> int:
    """The shift that leaves one digit of the numbers below width."""
    return max(0, (width - 1).bit_length() - DIGIT_BITS)


def begun(a: int, p: int, lo: int, top: int, ids: tuple[int, int], k: int) -> tuple:
    """A window whose interval is [lo, top]; top stays, high is the interval's upper end from here on."""
    return (a, p, lo, top, top, *ids, 0, _digit(top - lo + 1), k, True)


def refined(a, p, lo, top, high, first, last, by_id, shift, need, counts: dict[int, int]) -> tuple:
    """The window after a digit, by the counts of its buckets: the interval that holds its k-th row, or all if it has fewer.

    need: how many rows of the interval are sought. Settled are windows of few rows, or whose interval is one place."""
    so_far = 0
    for bucket in sorted(counts):
        if so_far + counts[bucket] >= need:
            break
        so_far += counts[bucket]
    else:
        return (a, p, lo, top, top, first, last, 0, 0, 0, False)  # fewer than are sought: all of the window's interval
    inside, width = counts[bucket], 1 << shift
    if by_id:
        first, last = first + bucket * width, min(last, first + (bucket + 1) * width - 1)
    else:
        lo, high = max(lo, high - (bucket + 1) * width + 1), high - bucket * width
    need -= so_far
    left = last - first if by_id else high - lo
    done = inside <= SETTLED - so_far or inside == need or (by_id and not left)
    if not done and not by_id and not left:
        by_id, left = 1, last - first
    return (a, p, lo, top, high, first, last, by_id, 0 if done else _digit(left + 1), need, not done)


def _refined(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in WINDOW.split(", ")]
    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            own = tuple(int(getattr(r, n)) for n in names[:-1])
            out.append(refined(*own, {} if r.counts is None else {int(c["bucket"]): int(c["n"]) for c in r.counts}))
        yield pd.DataFrame(out, columns=names)


def _passed(rows: DataFrame, anchors: DataFrame, windows: DataFrame, parts: int, names: list[str]) -> DataFrame:
    """Rows and, for each part, the anchors with their windows, in the order in which a task wants them."""
    own = windows.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("p", *(n for n in names if n != "p")))).alias("w"))  # an anchor has a few
    asked = anchors.join(own.hint("merge"), "a").select("a", "id", "label", "q", *(F.col(f"w.{n}").alias(n) for n in names))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(1).alias("kind"), "*")
    kinds = dict(asked.dtypes)
    held = rows.select("part", F.lit(0).alias("kind"), F.col("rid").alias("a"), "id", "label", "q", *(F.lit(None).cast(kinds[n]).alias(n) for n in names))
    return held.unionByName(asked).repartition(parts, "part").sortWithinPartitions("part", "kind", "a")


def selected(rows: DataFrame, anchors: DataFrame, windows: DataFrame, parts: int, same: bool, k: int) -> DataFrame:
    """(a, p, rid, id, score, rank): the first k rows of each window, of the anchor's label or of others."""
    spark, names = rows.sparkSession, [x.split()[0] for x in WINDOW.split(", ")]
    settled, windows = [], written(windows, "windows")
    while not windows.where("open").isEmpty():
        now = windows.where("open")
        counts = _passed(rows, anchors, now.select("a", *names[1:-1]), parts, names[1:-1]).mapInPandas(functools.partial(_counted, same), "a long, p long, bucket int, n long")
        counts = counts.groupBy("a", "p", "bucket").agg(F.sum("n").alias("n")).groupBy("a", "p").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))  # a digit's buckets
        after = written(now.join(counts.hint("merge"), ["a", "p"], "left").mapInPandas(_refined, WINDOW), "windows")
        settled.append(windows)
        windows = after
    every = functools.reduce(DataFrame.unionAll, [w.where("NOT open") for w in [*settled, windows]])
    gathered = _passed(rows, anchors, every.select(*names[:-1]), parts, names[1:-1]).mapInPandas(functools.partial(_gathered, same), "a long, p long, rid long, id long, score long")
    best = Window.partitionBy("a", "p").orderBy(F.desc("score"), "id", "rid")
    out = written(gathered.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "selected")
    discard(*settled, windows)
    return out


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, by rows (id, label, q) as of ``valid``.

    An anchor's positives are its first rows of the same label, itself left out; a positive's negatives the first
    rows of another label whose score s has 50 * positive_score <= 100 * s <= 95 * positive_score. Scores come first, ties by id.
    A row that is there twice counts once; rows that share an id and not the rest are different rows, an anchor each. Vectors of unequal
    lengths are compared as if the shorter ended in zeros; an empty one scores 0. Scores are exact; beyond 2**62 they count as that.
    An anchor without positives, or a positive without negatives, has no row. Empty tables give no rows.
    """
    spark = rows.sparkSession
    # rows that repeat meet by id; a part is a hash of it
    size = rows.agg(F.sum(F.size("q") * 8 + 24).alias("n")).first().n or 0
    parts = max(partitions(spark), -(-size // PART_BYTES))
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")
    named = rows.select("*", part).repartition(parts, "part").dropDuplicates(["part", "id", "label", "q"])
    rows = written(named.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    with small_batches(spark):
        anchors = written(rows.where(is_anchor).select(F.col("rid").alias("a"), "id", "label", "q"), "anchors")
        norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, v: s + v * v))
        bounds = rows.agg(F.max(norm).alias("norm"), F.min("id").alias("first"), F.max("id").alias("last")).first()
        ids = (bounds.first, bounds.last)

        def whole(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Any score lies within the product of the norms."""
            for b in batches:
                most = [int(m * 1.001) + 1 if (m := x * bounds.norm) < 2.0**61 else LIMIT for x in b["norm"]]
                yield pd.DataFrame([begun(a, -1, -m, m, ids, positives) for a, m in zip(b["a"].tolist(), most, strict=True)], columns=[x.split()[0] for x in WINDOW.split(", ")])

        def between(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """ceil(s / 2) to floor(19 s / 20), where that is not empty."""
            for b in batches:
                each = [(a, p, -(-s // 2), 19 * s // 20) for a, p, s in zip(b["a"].tolist(), b["rid"].tolist(), b["score"].tolist(), strict=True)]
                yield pd.DataFrame([begun(a, p, lo, top, ids, negatives) for a, p, lo, top in each if lo <= top], columns=[x.split()[0] for x in WINDOW.split(", ")])

        if bounds.first is None:
            return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        near = selected(rows, anchors, anchors.select("a", norm.alias("norm")).mapInPandas(whole, WINDOW), parts, True, positives)
        far = selected(rows, anchors, near.select("a", "rid", "score").mapInPandas(between, WINDOW), parts, False, negatives)
        of = near.select("a", F.col("rid").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = far.join(of.hint("merge"), ["a", "p"]).join(anchors.select("a", F.col("id").alias("anchor_id")).hint("merge"), "a")
        out = written(out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
    discard(rows, anchors, near, far)
    return out


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    rows = rows.withColumn("label", F.when(F.col("id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mined(rows, F.col("id") % 50 == 0)


#: Brute force: every anchor with every row.
ORACLE = """
WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS s FROM e AS a JOIN e AS b ON a.id % 50 = 0 AND a.id <> b.id),
p AS (SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM p JOIN s AS n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s QUALIFY rank <= 3
"""
