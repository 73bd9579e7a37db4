import hashlib
import random

import pandas as pd
import pytest
from verdigris.llm import passage_dedup as D


def brute(texts):
    """texts: doc_id to bytes."""
    seen, out = set(), {}
    for k in sorted(texts):
        t = texts[k]
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            s = t[i : i + 100]
            if s in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(s)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[k] = (len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest())
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randrange(10, 60))) for _ in range(12)]
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.25:
            t = rng.choice(texts)
            if rng.random() < 0.7 and t:
                i = rng.randrange(len(t))
                t = t[:i] + word() + t[i + rng.randrange(4) :]
        else:
            t = " ".join(rng.choice(passages) if rng.random() < 0.2 else word() for _ in range(rng.randrange(0, 90)))
        texts.append(t)
    return [*texts, "x" * 500, "x" * 99, "x" * 100, "xy" * 130, "", "é" * 49, "é" * 60]


def rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


@pytest.mark.parametrize(("seed", "group"), [(1, 20_000), (2, 3)])
def test_against_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(D, "GROUP", group)
    texts = corpus(seed, 150)
    docs = spark.createDataFrame([(len(texts) * 3 - 2 * i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n string").repartition(5)
    assert rows(D.cleaned(docs)) == brute({len(texts) * 3 - 2 * i: t.encode() for i, t in enumerate(texts)})


@pytest.mark.parametrize("size", [1, 7, 10_000])
def test_groups_over_batches(size):
    """The state carried from batch to batch: any cut of the sorted rows gives the same."""
    rng = random.Random(size)
    data = sorted({(rng.randrange(12), rng.randrange(3), rng.randrange(6), rng.randrange(4)) for _ in range(150)})
    frame = pd.DataFrame(data, columns=["key", "c", "doc", "start"])
    frame["p"] = frame.pop("start") * 65536 + 5 * 256 + 3
    whole = pd.concat(D._grouped([frame])).sort_values(["doc", "start", "off", "a"]).reset_index(drop=True)
    cut = pd.concat(D._grouped([frame[i : i + size] for i in range(0, len(frame), size)])).sort_values(["doc", "start", "off", "a"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(whole, cut, check_dtype=False)
    first = frame.groupby(["key", "c"]).head(1)
    several = first[first.groupby("key")["c"].transform("size") > 1]
    assert len(whole[whole["off"] >= 0]) == len(several) and len(whole[whole["off"] < 0]) == len(frame) - len(first)


def test_odd_rows(spark):
    a, b = "abc def " * 40, "".join(chr(97 + i * i % 23) for i in range(300))
    docs = spark.createDataFrame([(5, b), (5, b), (None, b), (7, None), (8, a), (9, b[50:250])], "doc_id long, text string")
    got = rows(D.cleaned(docs))
    want = brute({-1: b.encode(), 5: b.encode(), 7: b"", 8: a.encode(), 9: b[50:250].encode()})
    assert got == {None if k == -1 else k: v for k, v in want.items()}
    assert D.cleaned(docs).count() == 6 and D.cleaned(docs.limit(0)).count() == 0


@pytest.mark.parametrize("group", [20_000, 0])
def test_repeated_row_holds_a_passage_first(spark, monkeypatch, group):
    monkeypatch.setattr(D, "GROUP", group)
    b = "".join(chr(97 + i * i % 23) + chr(97 + i * 7 % 26) for i in range(200))
    docs = spark.createDataFrame([(5, b), (5, b), (5, b), (9, b[50:250]), (9, b[50:250])], "doc_id long, text string").repartition(5)
    got = rows(D.cleaned(docs))
    assert got == brute({5: b.encode(), 9: b[50:250].encode()})
    assert got[5][1] == 0 and got[9][1] == 200


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(D.cleaned(docs)) == brute({r.doc_id: r.text.encode() for r in docs.collect()})


def test_ids(spark):
    """Ids of any type, several texts under one id, the least long."""
    b = "".join(chr(97 + i * i % 23) + chr(97 + i * 7 % 26) for i in range(100))
    docs = spark.createDataFrame([("z", b), ("y", b), (None, b[:150])], "doc_id string, text string")
    assert {r.doc_id: r.n_removed for r in D.cleaned(docs).collect()} == {None: 0, "y": 150, "z": 200}
    assert {(r.doc_id, r.start) for r in D.repeats(docs).collect()} >= {("z", 0)}
    docs = spark.createDataFrame([(1, b), (1, "x" + b), (-(2**63), b[:120]), (None, b[:110])], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed) for r in D.cleaned(docs).collect())
    assert got[:2] == [(-(2**63), 120, 110), (0, 110, 0)] and {x[1] for x in got[2:]} == {200, 201} and sum(x[2] for x in got[2:]) in (200 + 120, 201 + 119, 200 + 119)
