"""Quality rules as learned decision lists.

A document is reduced to statistics of its words and lines. Sequential covering learns from labelled statistics:
a rule is grown condition by condition (the threshold with the largest gain of information over the documents that
the rule still covers), pruned from its end on a part of the sample that growing did not see, and kept if it is
precise there; what it covers is set aside and the next rule is learned. The list is emitted as one conditional
expression of Spark, first rule that holds decides, and reads as it is printed.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_in, chunks, exact, text_bytes
from .textkit import Words, numbered

#: Bound of the fit: labelled rows taken, in the order of a hash of doc_id.
SAMPLE_ROWS = 20_000
MAX_RULES = 12
MAX_CONDITIONS = 4
CUTS = 48
LEAST_COVER = 8
LEAST_PRECISION = 0.75

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_lines", "n_upper", "n_digits", "n_punct", "n_pipes", "n_distinct_words", "n_short_words"]
#: What rules are made of: expressions over the statistics, the same text for Spark and for the fit.
FEATURES = {
    "n_words": "n_words",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "punct_per_word": "n_punct / greatest(n_words, 1)",
    "pipe_share": "n_pipes / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "short_share": "n_short_words / greatest(n_words, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}

_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_SYMBOL, _UPPER, _DIGIT, _PUNCT = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_PUNCT[list(b"!?.,;:")] = True


def _ranked(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each distinct row of the columns, and how many rows have it, both by row; exact."""
    order = np.lexsort(cols)
    new = np.zeros(len(order), bool)
    for c in cols:
        new[1:] |= c[order][1:] != c[order][:-1]
    group = np.cumsum(new)
    out = np.empty(len(order), np.int64)
    out[order] = group
    return out, np.bincount(group)[out] if len(order) else out


def _measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The statistics of some texts, all at once."""
    n, w = len(texts), Words(texts, lower=False)
    buf, base = w.buf, w.base

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags)])
        return total[base[1:] - 1] - total[base[:-1]]

    lead = np.concatenate([[0], np.cumsum(_LEAD[buf])])
    chars = lead[w.end] - lead[w.start]
    out = {"n_words": w.count, "word_chars": np.bincount(w.doc, chars, n).astype(np.int64), "n_chars": per_text(_LEAD[buf])}
    out |= {k: per_text(m[buf]) for k, m in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_digits", _DIGIT), ("n_punct", _PUNCT))}
    out["n_pipes"] = np.bincount(w.doc[(w.end - w.start == 1) & (buf[w.start] == 124)], minlength=n)
    out["n_short_words"] = np.bincount(w.doc[chars <= 2], minlength=n)
    same, _ = numbered(buf, w.start, w.end, w.hash)  # exact
    word, _ = _ranked(same, w.doc)
    first = np.zeros(len(word), bool)
    first[np.unique(word, return_index=True)[1]] = True
    out["n_distinct_words"] = np.bincount(w.doc[first], minlength=n)
    # words of 5-word windows that a text has twice or more; word numbers differ from text to text
    k = len(word) - 4
    repeated = np.zeros(len(word) + 1, np.int64)
    if k > 0:
        at = np.flatnonzero(w.doc[:k] == w.doc[4:])
        if len(at):
            top = np.int64(word.max() + 1)
            two, _ = _ranked(word[:-1] * top + word[1:])
            four, _ = _ranked(two[:-2] * np.int64(two.max() + 1) + two[2:])
            _, times = _ranked(four[at] * top + word[at + 4])
            hits = at[times > 1]
            np.add.at(repeated, hits, 1)
            np.add.at(repeated, hits + 5, -1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(repeated)[:-1] > 0], minlength=n)
    lines, dups = [], []
    for t in texts:
        own = t.split(b"\n")
        full = [x for x in own if x.strip(b" \t\n\x0b\x0c\r")]
        lines.append(len(full))
        dups.append(len(full) - len(set(full)))
    return out | {"n_lines": np.array(lines), "n_dup_lines": np.array(dups)}


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs but the text, and STATISTICS (long) of each row's whole text; columns of these names are replaced.

    A null text has no words. Texts stay where they are read.
    """

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["_t"].to_list()
            parts = [_measure(texts[i:j]) for i, j in chunks(texts, 1 << 19)]
            yield b.drop(columns="_t").assign(**{k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in STATISTICS})

    own = docs.withColumn("_t", text_bytes(text)).drop(*STATISTICS, text)
    cols = exact(own)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != "_t"), *(f"{k} long" for k in STATISTICS)])
    return as_in(cols.mapInPandas(work, schema), own)


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, x: pd.DataFrame) -> np.ndarray:
        v = x[self.feature].to_numpy()
        return v > self.cut if self.above else v <= self.cut

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>' if self.above else '<='} {self.cut!r}D"


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[tuple[tuple[Condition, ...], bool], ...]
    default: bool

    def column(self) -> Column:
        """Keep or not: an ordered conditional expression."""
        out = None
        for conditions, keep in self.rules:
            when = F.expr(" AND ".join(c.sql() for c in conditions))
            out = F.when(when, F.lit(keep)) if out is None else out.when(when, F.lit(keep))
        return F.lit(self.default) if out is None else out.otherwise(F.lit(self.default))

    def __str__(self) -> str:
        said = [f"if {' and '.join(f'{c.feature} {">" if c.above else "<="} {c.cut:.4g}' for c in r)}: {'keep' if k else 'drop'}" for r, k in self.rules]
        return "\n".join([*said, f"else: {'keep' if self.default else 'drop'}"])


def _grow(x: pd.DataFrame, y: np.ndarray) -> list[Condition]:
    """Conditions for y, each with the largest gain over what is still covered."""
    rule: list[Condition] = []
    mask = np.ones(len(y), bool)
    while len(rule) < MAX_CONDITIONS and mask.any() and not y[mask].all():
        p0, n0 = y[mask].sum(), mask.sum()
        best, found = 0.0, None
        for f in FEATURES:
            v = x[f].to_numpy()
            for cut in np.unique(np.quantile(v[mask], np.linspace(0, 1, CUTS), method="lower"))[:-1]:
                up = mask & (v > cut)
                for above, m in ((True, up), (False, mask & ~up)):
                    p, n = y[m].sum(), m.sum()
                    if p < LEAST_COVER:
                        continue
                    gain = p * (np.log2(p / n) - np.log2(p0 / n0))
                    if gain > best + 1e-9:
                        best, found = gain, Condition(f, above, float(cut))
        if found is None:
            break
        rule.append(found)
        mask &= found.holds(x)
    return rule


def _covers(rule: list[Condition], x: pd.DataFrame) -> np.ndarray:
    return reduce(np.logical_and, (c.holds(x) for c in rule), np.ones(len(x), bool))


def learn(x: pd.DataFrame, y: np.ndarray, prune: np.ndarray) -> DecisionList:
    """Rules for dropping. x: features; y: whether to drop; prune: which rows are for pruning."""
    left, rules = np.ones(len(y), bool), []
    while len(rules) < MAX_RULES and (y & left & ~prune).sum() >= LEAST_COVER:
        g, t = left & ~prune, left & prune
        rule = _grow(x[g], y[g])
        if not rule:
            break

        def worth(r: list[Condition], t=t) -> float:
            m = _covers(r, x[t])
            return (y[t][m].sum() - (~y[t][m]).sum()) / max(1, m.sum())

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        m = _covers(rule, x) & left
        if m.sum() < LEAST_COVER or y[m & prune].sum() < LEAST_PRECISION * (m & prune).sum() or not (m & prune).any():
            break
        rules.append((tuple(rule), False))
        left &= ~m
    return DecisionList(tuple(rules), True)


def fit(docs: DataFrame, labels: DataFrame) -> DecisionList:
    """A list learned from at most SAMPLE_ROWS rows of labels (quality 0 or 1), copies of a text once."""
    own = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").groupBy("text").agg(F.min("q").alias("q"))
    feats = statistics(rows.withColumn("h", F.xxhash64("text"))).select("q", "h", *(F.expr(e).cast("double").alias(k) for k, e in FEATURES.items()))
    seen = feats.toPandas().sort_values("h", ignore_index=True)  # SAMPLE_ROWS rows at most
    if not len(seen):
        return DecisionList((), True)
    return learn(seen[list(FEATURES)], seen["q"].to_numpy() == 0, (seen["h"].to_numpy() % 3) == 0)


def judged(docs: DataFrame, rules: DecisionList) -> DataFrame:
    """Statistics, base_failed and kept of each row of docs.

    base_failed: fewer than 10 words, or over a fifth of the words in repeated windows. Such rows are not kept; for
    the others the decision list decides. Null and empty texts have no words and fail. Repeated rows are judged one
    by one, empty tables give no rows, columns named as results are replaced.
    """
    failed = F.expr("n_words < 10 OR 100 * n_repeat_words > 20 * n_words")
    return statistics(docs).withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & rules.column())


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs.select("doc_id", "text"), rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def base_quality_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 returns, but the learned verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(docs.select("doc_id", "text"), DecisionList((), True)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g), range(5) AS k(j) WHERE n > 1 GROUP BY doc_id),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
"""
