import random
import re

import numpy as np
import pytest
from verdigris.llm import ngram_join as J


def shingle_set(t, width=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(texts, width=3, percent=90):
    s = {k: shingle_set(t, width) for k, t in texts.items()}
    root = {k: k for k in s}
    by = {}
    for k in s:
        for g in s[k]:
            by.setdefault(g, []).append(k)
    pairs = {(a, b) for v in by.values() if len(v) < 400 for a in v for b in v if a < b}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        i = len(s[a] & s[b])
        if 100 * i >= percent * (len(s[a]) + len(s[b]) - i):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {k: (len(s[k]), find(k)) for k in s}


def rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def near_copies(seed, n, lengths=(3, 8, 12, 19, 30, 80, 300)):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts, k = {}, 0
    passage = [rng.choice(vocabulary) for _ in range(25)]
    while k < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice(lengths))]
        if rng.random() < 0.3:
            base = passage + base
        for _ in range(rng.choice([1, 1, 2, 5])):
            own = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts[k] = " ".join(own)
            k += 1
    return texts


def test_edges_of_similarity():
    rng = np.random.default_rng(2)
    for n in [10, 15, 18, 19, 20, 57, 100, 190, 191, 1000]:
        for _ in range(30):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            d = 2 * n // 19  # as many differences as a link allows
            b = np.unique(np.concatenate([a[d // 2 :], rng.integers(0, 2**64, d - d // 2, dtype=np.uint64)]))
            rng.shuffle(c := a.copy())
            c = np.unique(np.concatenate([c[d // 2 :], rng.integers(0, 2**64, d - d // 2, dtype=np.uint64)]))
            for x in (b, c):
                if J.linked(a, x):
                    assert np.intersect1d(J.signatures(a), J.signatures(x)).size


@pytest.mark.parametrize("blocks", [(4000, 2_000_000), (5, 200)])
def test_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(J, "BLOCK_DOCS", blocks[0])
    monkeypatch.setattr(J, "BLOCK_SHINGLES", blocks[1])
    texts = near_copies(blocks[0], 500)
    docs = spark.createDataFrame([(k * 7 + 1, t, "x") for k, t in texts.items()], "doc_id long, text string, n string")
    want = brute({k * 7 + 1: t for k, t in texts.items()})
    assert rows(J.joined(docs)) == want
    assert len({c for _, c in want.values()}) < len(texts) - 50  # the fixture has links


@pytest.mark.parametrize(("width", "percent", "small", "docs"), [(5, 80, 64, 4000), (5, 80, 1, 4000), (5, 80, 1, 7), (2, 95, 64, 4000), (4, 85, 3, 4000)])
def test_other_rules(spark, monkeypatch, width, percent, small, docs):
    monkeypatch.setattr(J, "SMALL", small)
    monkeypatch.setattr(J, "BLOCK_DOCS", docs)
    texts = near_copies(width, 400, (5, 8, 20, 47, 90, 300))
    docs = spark.createDataFrame([(k, t) for k, t in texts.items()], "doc_id long, text string")
    assert rows(J.joined(docs, rule=J.Rule(width, percent))) == brute(texts, width, percent)


def test_edges_of_similarity_at_80():
    rng = np.random.default_rng(4)
    for n in [5, 9, 12, 31, 100, 333, 2000]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            d = rng.integers(0, 2 * n // 9 + 1)
            b = np.unique(np.concatenate([rng.permutation(a)[d // 2 :], rng.integers(0, 2**64, d - d // 2, dtype=np.uint64)]))
            if J.linked(a, b, J.Rule(5, 80)):
                assert len(a) < 5 or np.array_equal(a, b) or np.intersect1d(J.signatures(a, 80), J.signatures(b, 80)).size


def test_long_sets_do_not_tie_by_empty_parts():
    """Unlike sets of several hundred thousand shingles share no signature."""
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        a, b = (np.unique(rng.integers(0, 2**64, 400_000, dtype=np.uint64)) for _ in range(2))
        assert not np.intersect1d(J.signatures(a, percent), J.signatures(b, percent)).size


def test_ids(spark):
    """Ids of any type; rows that share an id and not a text are two documents."""
    docs = spark.createDataFrame([("b", "x y z w"), ("a", "X y  z w"), ("c", "p q r"), (None, "p q r")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in J.joined(docs).collect()} == {("b", "a"), ("a", "a"), ("c", "c"), (None, None)}
    big = 2**53 + 1
    docs = spark.createDataFrame([(1, "x y z w"), (1, "quite another text here"), (1, "quite another text here"), (2, "X y z w"), (big, "quite another TEXT here"), (None, "x")], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id or 0, r.component_id) for r in J.joined(docs).collect() if r.doc_id) == [(1, 1), (1, 1), (1, 1), (2, 1), (big, 1)]


def test_odd_rows(spark):
    data = [(1, None), (2, ""), (3, " \n\t"), (4, "One"), (5, "one"), (6, "a b"), (7, "b a"), (8, "a b c"), (9, "A  B\nc"), (9, "A  B\nc"), (None, "a b c")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in J.joined(docs).collect()}
    assert got == {(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 1, 8), (9, 1, 8), (None, 1, None)}
    assert J.joined(docs.limit(0)).count() == 0


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(J.joined(docs)) == brute({r.doc_id: r.text for r in docs.collect()})
