import random
import re

import numpy as np
import pytest
import xxhash
from verdigris.llm import ngram_join, simhash as S


def plain(text):
    """A fingerprint bit by bit."""
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    """(doc_id, fingerprint) to components by all pairs of distinct fingerprints."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    a = np.array(fps, np.uint64)
    for i, f in enumerate(fps):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 2):
            root[find(fps[i + 1 + j])] = find(f)
    least = {}
    for k, f in rows:
        least[find(f)] = min(least.get(find(f), k), k)
    return {(k, f"{f:016x}", least[find(f)]) for k, f in rows}


def found(df):
    return [tuple(r) for r in df.collect()]


TEXTS = ["", None, " \n", "a", "A b", "a B\tc", "a b  c d", "É x É x y", "one\x1ctwo three", "x " * 70000, "w " * 3, "Z\x0bz\x0cz"]


def test_fingerprints(monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 1000)
    rng = random.Random(4)
    for t in [*TEXTS, *(" ".join(rng.choices(["a", "Bc", "d\n", "é", "\t"], k=rng.randrange(40))) for _ in range(500))]:
        assert S.fingerprint((t or "").encode()) == plain(t)


def test_spark_hashes_alike(spark):
    """The seed and the bytes are those of Spark's own xxhash64."""
    row = spark.sql("SELECT xxhash64('a b c') AS h").first()
    assert row.h % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42) == S.fingerprint(b"A b  c")


@pytest.mark.parametrize("m", [2, 3, 4])
def test_thresholds_lose_no_link(m):
    """Every allocation adds up, is of the least cost, and meets each neighbour within the radius."""
    rng = np.random.default_rng(m)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fp = np.unique(np.concatenate([base, *(base ^ S.flips(list(range(64)), 1)[1][rng.integers(0, 64, 60)] for _ in range(4))]))
    x = S._bits(fp.view(np.int64)).astype(float)
    groups = S.grouped_bits(x.T @ x, len(fp), m)
    assert sorted(b for g in groups for b in g) == list(range(64))
    counts = [np.bincount(S._packed(fp, s), minlength=1 << len(s)) for g in groups for s in S.subs(g)]
    plan = S.Allocator.of(groups, counts, len(fp))
    t, cost = plan.allocate(fp), plan.costs(fp)
    assert ((t + 1).sum(1) == 3).all() and (t >= -1).all()
    import itertools

    every = [u for u in itertools.product(range(4), repeat=m) if sum(u) == 3]
    best = np.min([sum(cost[:, i, k] for i, k in enumerate(u)) for u in every], 0)
    assert np.allclose(sum(cost[np.arange(len(fp)), i, t[:, i] + 1] for i in range(m)), best)
    for q, own in zip(fp, t, strict=True):
        for y in np.concatenate([q ^ f for f in S.flips(list(range(64)), 2)]):
            assert any(np.bitwise_count((q ^ y) & np.uint64(S.mask(g))) <= k for g, k in zip(groups, own, strict=True))


@pytest.mark.parametrize("bucket", [1024, 3])
def test_links_of_crowds(spark, monkeypatch, bucket):
    """Chains, a crowd around one fingerprint, and strangers; also where nearly all buckets are dealt out anew."""
    monkeypatch.setattr(S, "BUCKET", bucket)
    rng = np.random.default_rng(bucket)
    one = S.flips(list(range(64)), 1)[1]
    fps = [int(x) for x in rng.integers(0, 2**64, 400, dtype=np.uint64)]
    for _ in range(30):
        f = np.uint64(rng.integers(0, 2**64, dtype=np.uint64))
        for _ in range(12):
            f = f ^ one[rng.integers(0, 64)] ^ one[rng.integers(0, 64)] ^ (one[rng.integers(0, 64)] if rng.random() < 0.4 else np.uint64(0))
            fps.append(int(f))
    centre = np.uint64(rng.integers(0, 2**64, dtype=np.uint64))
    for _ in range(600):
        fps.append(int(centre ^ np.bitwise_or.reduce(one[rng.integers(0, 64, rng.integers(0, 5))], initial=np.uint64(0))))
    rows = [(i * 3 + 1, f) for i, f in enumerate(fps)]
    distinct = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in sorted(set(fps))], "fp long")
    label = {r.node % 2**64: r.label % 2**64 for r in ngram_join.components(S.links(distinct)).collect()}
    groups = {}
    for k, f in rows:
        groups.setdefault(label.get(f, f), []).append(k)
    got = {(k, f"{f:016x}", min(groups[label.get(f, f)])) for k, f in rows}
    assert got == brute(rows)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = found(S.joined(docs))
    assert len(got) == docs.count() and set(got) == brute([(r.doc_id, plain(r.text)) for r in docs.collect()])
    assert len({c for *_, c in got}) < len(got)


def test_odd_rows(spark):
    rows = [(7, None), (3, ""), (3, ""), (9, "One two\tthree"), (4, "one  TWO three"), (4, "quite another text of some words"), (2**53 + 1, "one two three"), (None, "one two three"), (5, "x " * 30000)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, fp int, label int").coalesce(1)
    got = found(S.joined(docs))
    want = brute([(k, plain(t)) for k, t in rows if k is not None])
    assert set(got) == want | {(None, f"{plain('one two three'):016x}", None)} and len(got) == len(rows)
    assert {c for k, _, c in got if k in (3, 7)} == {3} and {c for k, _, c in got if k in (9, 2**53 + 1)} == {4}
    assert S.joined(docs.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "x y z w"), ("a", "X y  z w")], "doc_id string, text string")
    assert {c for *_, c in found(S.joined(named))} == {"a"}


def test_long_paths_take_few_rounds(spark, monkeypatch):
    """A path of 1,000 edges in rising order, a star, and a path among them: at most 15 rounds."""
    rounds = []
    plain_write = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, name: rounds.append(name) or plain_write(df, name))
    edges = [(i, i + 1) for i in range(1000)] + [(5000, 5001 + i) for i in range(300)]
    got = {r.node: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1001), 0), **dict.fromkeys(range(5000, 5301), 5000)}
    assert rounds.count("parents") <= 15
