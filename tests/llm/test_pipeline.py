import hashlib

import corpus_pipeline as C
import public_tokenizers as P
import tiktoken
from verdigris.llm import bpe, toxicity

from .test_ngram_join import brute
from .test_pii import brute as spans


def test_stages_one_by_one(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    score = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    out = C.drop_toxic(spark, docs, sf)
    held = {k: t for k, t in held.items() if score[k] < 0.7}
    assert out.schema == docs.schema and {r.doc_id: r.text for r in out.collect()} == held

    out = C.drop_near_copies(spark, C.written(out, "t"), sf)
    held = {k: held[k] for k, (_, c) in brute(held, 5, 80).items() if c == k}
    assert out.schema == docs.schema and {r.doc_id: r.text for r in out.collect()} == held

    items = [r.text.lower().split() for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    shingles = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]
    out = C.drop_leaks(spark, C.written(out, "t"), sf)
    clean = {}
    for k, t in held.items():
        w = t.lower().split()
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        if not any(len(s & own) >= 0.8 * len(s) for s in shingles):
            clean[k] = t
    assert {r.doc_id: r.text for r in out.collect()} == clean

    out = C.redact(spark, C.written(out, "t"), sf)
    assert out.schema == docs.schema
    safe = {r.doc_id: r.text for r in out.collect()}
    assert set(safe) == set(clean)
    for k, t in clean.items():
        assert not spans(safe[k]) and (safe[k] == t) == (not spans(t))

    out = C.encode(spark, C.written(out, "t"), sf)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).monoid.ranks, special_tokens={})
    for r in out.collect():
        ids = library.encode_ordinary(safe[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(safe[r.doc_id].encode()).hexdigest())
    assert sorted(map(tuple, C.run(spark, sf).collect())) == sorted(map(tuple, out.collect()))


def odd(spark):
    base = " ".join(f"w{i}" for i in range(100))
    near = base.replace("w50", "other")
    rows = [(1, base, 1), (1, "quite another text that is not a copy of it", 2), (1, base, 1), (2, near, 3), (3, None, 4), (4, "", 5), (4, "", 5), (None, base, 6), (2**53 + 1, "call +1 (555) 123-4567 or mail a.b@example.com", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t int")
    for c in ("digits", "cands", "base", "spans", "added", "found", "row", "score", "_t", "digest", "n", "_added", "held"):
        docs = docs.withColumn(c, docs["t"])
    return docs.coalesce(1)


def test_odd_rows(spark):
    sf, docs = "/root/testdata/sf0.001", odd(spark)
    every = sorted((r.doc_id or 0, r.text or "", r.t) for r in docs.collect())
    out = C.drop_toxic(spark, docs, sf)
    assert out.schema == docs.schema and sorted((r.doc_id or 0, r.text or "", r.score) for r in out.collect()) == every

    out = C.drop_near_copies(spark, docs, sf)
    assert out.schema == docs.schema
    assert sorted((r.doc_id or 0, (r.text or "")[:5], r.t) for r in out.collect()) == [(0, "w0 w1", 6), (1, "quite", 2), (1, "w0 w1", 1), (3, "", 4), (4, "", 5), (4, "", 5), (2**53 + 1, "call ", 7)]

    assert sorted((r.doc_id or 0, r.text or "", r.n) for r in C.drop_leaks(spark, docs, sf).collect()) == every

    out = C.redact(spark, docs, sf)
    assert out.schema == docs.schema
    got = {r.t: (r.text, r.base, r.spans, r.cands) for r in out.collect()}
    assert got[7] == ("call [PHONE] or mail [EMAIL]", 7, 7, 7) and got[4] == (None, 4, 4, 4) and got[5][0] == ""

    out = C.encode(spark, docs, sf)
    assert out.count() == 9 and {r.doc_id for r in out.collect()} == {1, 2, 3, 4, None, 2**53 + 1}
    for _, stage in C.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_leaks_go_row_by_row(spark):
    """Clean rows stay beside leaking ones of the same id or of none; nothing is joined or shuffled."""
    sf = "/root/testdata/sf0.001"
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    rows = [(None, leak), (None, "a clean text"), (7, f"before {leak} after"), (7, "another clean text"), (8, "clean too"), (8, None)]
    docs = spark.createDataFrame([(*r, {"k": i}) for i, r in enumerate(rows)], "doc_id long, text string, held map<string,int>").coalesce(1)
    out = C.drop_leaks(spark, docs, sf)
    assert out.schema == docs.schema and sorted(r.held["k"] for r in out.collect()) == [1, 3, 4, 5]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_near_copies_of_rows_with_maps(spark):
    rows = [(1, "one two three four five six", 1), (1, "one two three four five six", 0), (2, "One two three four five six", 2), (3, "others", 3)]
    docs = spark.createDataFrame([(k, t, {"k": i}) for k, t, i in rows], "doc_id long, text string, held map<string,int>")
    out = C.drop_near_copies(spark, docs, "")
    assert out.schema == docs.schema and sorted(r.held["k"] for r in out.collect()) == [0, 3]
