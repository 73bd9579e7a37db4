"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme values.

Training: over a bounded sample of labelled documents (distinct texts), counts of tokens and of token beginnings in
toxic and other documents give log-odds with an informative Dirichlet prior; a feature scores its log-odds if
these are above LEAST_ODDS by Z0 standard deviations, any other token scores -DRIFT. Scoring: one linear scan of a text finds
every maximal segment (Ruzzo and Tompa). For scores that drift down, the best segment of m unrelated tokens exceeds
s with probability about 1 - exp(-K m exp(-lambda s)); lambda comes from the token scores of documents that are not
toxic, K from how many of their segments exceed their median. A segment's evidence is lambda s - ln(K m + 1), significant above 0; a document's
score is a logistic function, fitted on the sample, of its significant evidence (else of its best evidence).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_in, chunks, exact, text_bytes, trimmed, written
from .textkit import SPACE, Words, eights, span_hash

#: Bounds of the fit: labelled rows taken (in the order of a hash of doc_id), features kept (the surest).
SAMPLE_ROWS = 20_000
FEATURES = 50_000
PRIOR = 0.5
Z0 = 2.33
LEAST_ODDS = 1.0
LEAST_DOCS = 4
DRIFT = 0.25
THRESHOLD = 0.7
#: A token's features: itself and its first so many bytes.
BEGINNINGS = (5, 6, 7)

_BREAK = SPACE.copy()
_BREAK[[b for b in range(128) if not chr(b).isalnum()]] = True


class Tokens(Words):
    """Runs of letters and digits of some texts, lower-cased; hashes: one row for each kind of feature."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8).copy()
        raw[(raw >= 65) & (raw <= 90)] += 32
        upper = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        raw[1:][upper] += 32
        gap = _BREAK[raw]
        self.start, self.end = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1, np.flatnonzero(~gap[:-1] & gap[1:]) + 1
        self.base = np.cumsum([1, *(len(t) + 1 for t in texts)])
        edge = np.searchsorted(self.start, self.base)
        self.first, self.count = edge[:-1], np.diff(edge)
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        view = eights(raw)
        kinds = [span_hash(raw, self.start, self.end, view=view)]
        for k in BEGINNINGS:  # a beginning is a feature of its own, whatever token it is of
            kinds.append(span_hash(raw, self.start, np.minimum(self.start + k, self.end), view=view) + np.uint64(k))
        self.hashes = np.stack(kinds)


@dataclass(frozen=True)
class Model:
    key: np.ndarray
    weight: np.ndarray
    decay: float = 1.0
    k: float = 1.0
    slope: float = 1.0
    bias: float = 0.0
    none: float = -5.0  # evidence of a text without segments

    def scores(self, hashes: np.ndarray) -> np.ndarray:
        """The score of each token: its best feature's, else -DRIFT."""
        out = np.full(hashes.shape[1], -DRIFT)
        if len(self.key):
            for row in hashes:
                at = np.minimum(np.searchsorted(self.key, row), len(self.key) - 1)
                out = np.maximum(out, np.where(self.key[at] == row, self.weight[at], -DRIFT))
        return out

    def evidence(self, score: float, tokens: int) -> float:
        return self.decay * score - float(np.log(self.k * tokens + 1.0))

    def probability(self, x: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.slope * x + self.bias, -40, 40))))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments [start, end) of a sequence, in linear time (runs of negative scores as one)."""
    out: list[list[float]] = []  # start, end, sum before, sum up to the end
    total, last = 0.0, 0
    for p in np.flatnonzero(scores > 0):
        total += -DRIFT * (p - last)
        new = [int(p), int(p) + 1, total, total + float(scores[p])]
        total, last = new[3], int(p) + 1
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(int(a), int(b), r - l) for a, b, l, r in out]


def _scored(texts: list[bytes], model: Model) -> Iterator[tuple[int, Tokens, int, list[tuple[int, int, float]]]]:
    """(index, tokens, number of the text among them, segments) for each text."""
    for i, j in chunks(texts):
        t = Tokens(texts[i:j])
        s = model.scores(t.hashes)
        hot = np.zeros(j - i, bool)
        hot[t.doc[s > 0]] = True
        for d in range(j - i):
            yield i + d, t, d, segments(s[t.first[d] : t.first[d] + t.count[d]]) if hot[d] else []


def _summary(model: Model, m: int, found: list[tuple[int, int, float]]) -> float:
    each = [model.evidence(s, m) for _, _, s in found]
    return sum(x for x in each if x > 0) if each and max(each) > 0 else max(model.none, *each) if each else model.none


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """y, t: labels and texts of at most SAMPLE_ROWS labelled documents outside the held-out third."""
    own = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    return docs.select("doc_id", text_bytes().alias("t")).join(F.broadcast(own), "doc_id").groupBy("t").agg((F.max("y") > 0).alias("y"))


def _counted(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Feature counts of toxic and other documents; a feature counts once in a document."""
    for b in batches:
        toxic, texts = b["y"].to_numpy(bool), b["t"].to_list()
        for i, j in chunks(texts):
            t = Tokens(texts[i:j])
            f, d = t.hashes.ravel(), np.tile(t.doc, len(t.hashes))
            order = np.lexsort((d, f))
            f, d = f[order], d[order]
            new = np.ones(len(f), bool)
            new[1:] = (f[1:] != f[:-1]) | (d[1:] != d[:-1])
            f, y = f[new], toxic[i:j][d[new]]
            u, at = np.unique(f, return_inverse=True)
            yield pd.DataFrame({"f": u.view(np.int64), "a": np.bincount(at, y, len(u)).astype("int64"), "b": np.bincount(at, ~y, len(u)).astype("int64")})


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model. Texts and the label are all that is read."""
    rows = written(training_rows(docs, labels), "toxicity_sample")
    counts = rows.mapInPandas(trimmed(_counted), "f long, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    size = rows.agg(F.sum(F.col("y").cast("long")).alias("a"), F.sum((~F.col("y")).cast("long")).alias("b")).first()
    na, nb = float(size["a"] or 0), float(size["b"] or 0)
    if not na or not nb:
        return Model(np.zeros(0, np.uint64), np.zeros(0), bias=0.0)
    # the prior of a feature: PRIOR documents, and as many more as it is frequent in the sample
    prior = F.lit(PRIOR) + (F.col("a") + F.col("b")) / F.lit(na + nb)
    a, b = F.col("a") + prior, F.col("b") + prior
    odds = F.log(a / (F.lit(na + 1.0) - F.col("a"))) - F.log(b / (F.lit(nb + 1.0) - F.col("b")))  # counts are na, nb at most
    low = odds - F.lit(Z0) * F.sqrt(1.0 / a + 1.0 / b)
    best = counts.where(f"a >= {LEAST_DOCS}").select("f", odds.alias("w"), low.alias("low")).where(f"low >= {LEAST_ODDS}").orderBy(F.desc("low"), "f").limit(FEATURES).collect()
    key = np.array([r["f"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(key)
    model = Model(key[order], np.array([r["w"] for r in best], float)[order])

    def measured(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [(bool(y), int(t.count[d]), [float(s) for *_, s in found]) for (_, t, d, found), y in zip(_scored(x["t"].to_list(), model), x["y"], strict=True)]
            yield pd.DataFrame(rows, columns=["y", "m", "found"])

    seen = rows.mapInPandas(measured, "y boolean, m long, found array<double>").toPandas()  # SAMPLE_ROWS rows at most
    return _calibrated(model, seen)


def _calibrated(model: Model, seen: pd.DataFrame) -> Model:
    null = seen[~seen["y"]]
    tokens, peaks = float(null["m"].sum()) + 1.0, np.array([s for x in null["found"] for s in x] or [1.0])
    # lambda: the mean of exp(lambda * score) over tokens that aren't toxic is 1
    down, lo, hi = max(tokens - len(peaks), 1.0), 1e-4, 20.0
    for _ in range(80):
        mid = (lo + hi) / 2
        if (down * np.exp(-mid * DRIFT) + np.exp(np.minimum(mid * peaks, 500.0)).sum()) / tokens < 1:
            lo = mid
        else:
            hi = mid
    middle = float(np.median(peaks))
    k = float(np.clip((peaks >= middle).sum() * np.exp(min(lo * middle, 500.0)) / tokens, 1e-9, 1.0))
    model = Model(model.key, model.weight, lo, k, none=-float(np.log(k * (float(seen["m"].mean()) + 1.0) + 1.0)))
    x = np.array([_summary(model, m, [(0, 0, s) for s in f]) for m, f in zip(seen["m"], seen["found"], strict=True)])
    y = seen["y"].to_numpy(float)
    slope, bias = 1.0, 0.0
    for _ in range(60):  # Newton steps with a weak pull to 0
        p = 1.0 / (1.0 + np.exp(-np.clip(slope * x + bias, -40, 40)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * x).sum() - 0.1 * slope, (y - p).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        slope, bias = slope + step[0], bias + step[1]
    return Model(model.key, model.weight, model.decay, model.k, max(float(slope), 1e-3), float(bias), model.none)


def passages(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, start, end (bytes), score, evidence of every significant toxic passage."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES features at most

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for b in batches:
            ids, rows = b["doc_id"].to_list(), []
            for i, t, d, found in _scored(b["_t"].to_list(), model):
                for p, q, s in found:
                    if (x := model.evidence(s, int(t.count[d]))) > 0:
                        f = t.first[d]
                        rows.append((ids[i], int(t.start[f + p] - t.base[d]), int(t.end[f + q - 1] - t.base[d]), s, x))
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "score", "evidence"])

    own = docs.select(F.col(key).alias("doc_id"), text_bytes(text).alias("_t"))
    return as_in(exact(own).mapInPandas(trimmed(work), f"doc_id {exact(own).schema['doc_id'].dataType.simpleString()}, start long, end long, score double, evidence double"), own)


def scored(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The columns of docs, and score (0 to 1) of each row.

    Whole texts, row by row; a null text is empty and gets the score of no evidence. Repeated rows get equal scores;
    empty tables give no rows; a column of docs named score is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = held.value
        for b in batches:
            p = [model.probability(_summary(model, int(t.count[d]), found)) for _, t, d, found in _scored(b["_t"].to_list(), model)]
            yield b.drop(columns="_t").assign(score=pd.Series(p, dtype="float64", index=b.index))

    own = docs.drop("score", "_t")
    cols = exact(own).withColumn("_t", text_bytes(text))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != "_t")
    return as_in(cols.mapInPandas(trimmed(work), f"{schema}, score double"), own)


def kept(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold, their columns as they are, whatever their names."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in names.items()))
    return scored(renamed, model, names[text]).where(F.col("score") < threshold).select(*(F.col(k).alias(c) for c, k in names.items()))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs.select("doc_id", "text"), model)
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
