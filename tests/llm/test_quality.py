import re

import numpy as np
import pandas as pd
from verdigris.llm import quality as Q

CASES = ["", None, "one", "a b c d e f a b c d e x", "x\nx\n \nx\ny", "#a *b $c <d> |e|", "the  cat\tsat\r\non é à 漢字 \x85 \xa0 z", "w " * 300, "a b c d e\n" * 4, "\n\n", "p q r s t u p q r s t v p q r s t"]


def brute(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    rep = len({i + j for v in at.values() if len(v) > 1 for i in v for j in range(5)})
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), rep


def test_statistics(spark):
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(CASES)], "doc_id long, text string, n_words int")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) for r in Q.judged(docs, Q.DecisionList((), True)).collect()}
    for i, t in enumerate(CASES):
        b = brute(t)
        failed = b[0] < 10 or 100 * b[4] > 20 * b[0]
        assert got[i] == (*b, failed, not failed), t
    assert Q.judged(docs.limit(0), Q.DecisionList((), True)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in Q.statistics(docs.select("doc_id", "text")).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs.collect()}


def test_learning(spark):
    rng = np.random.default_rng(1)
    x = pd.DataFrame({f: rng.random(3000) for f in Q.FEATURES})
    drop = ((x["upper_share"] > 0.8) | ((x["n_words"] <= 0.3) & (x["pipe_share"] > 0.5))).to_numpy()
    rules = Q.learn(x, drop, rng.random(3000) < 0.33)
    keep = np.ones(3000, bool)
    for r, _ in rules.rules:
        keep &= ~Q._covers(list(r), x)
    assert ((~keep) == drop).mean() > 0.97, str(rules)
    assert spark.range(1).select(*(Q.F.lit(5).alias(s) for s in Q.STATISTICS)).select(rules.column().alias("k")).first().k in (True, False)
