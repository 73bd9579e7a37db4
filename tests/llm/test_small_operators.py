"""Defined results for odd rows of the URL, sharding, decontamination and toxicity operators."""

import random
import zlib

from pyspark.sql import functions as F
from verdigris.llm import decontaminate, sharding, toxicity, url_filter
from verdigris.llm.common import setting


def test_urls(spark):
    urls = {1: None, 2: "", 3: "no scheme/en/", 4: "HTTP://Example.COM/en/x", 5: "http://www.example.com/en/?q#f", 6: "http://a.b.net/es/1", 7: "http://net/fr/", 8: "http://example.com", 9: "http://example.com/EN/", 10: "http://myexample.com/en/", 11: "x://y://z.com/", 12: "http://com./", 13: "http:///en/", 14: "http://É.com/a\nb", 15: "http://a..com/", 16: "http://xnet/es/"}
    pages = spark.createDataFrame([*urls.items(), (5, urls[5])], "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = [tuple(r) for r in url_filter.judge(pages, url_filter.RULES).collect()]
    want = {
        1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("", "", None, "allow"), 4: ("example.com", "/en/x", "example.com/en/", "block"), 5: ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        6: ("a.b.net", "/es/1", "net/es/", "block"), 7: ("net", "/fr/", "net/fr/", "block"), 8: ("example.com", "", None, "allow"), 9: ("example.com", "/EN/", "com/", "allow"), 10: ("myexample.com", "/en/", "com/", "allow"),
        11: ("y:", "//z.com/", None, "allow"), 12: ("com.", "/", None, "allow"), 13: ("", "/en/", None, "allow"), 14: ("É.com", "/a\nb", "com/", "allow"), 15: ("a..com", "/", "com/", "allow"), 16: ("xnet", "/es/", None, "allow"),
    }
    assert sorted(got) == sorted([*((k, *v) for k, v in want.items()), (5, *want[5])])
    assert url_filter.judge(pages.limit(0), url_filter.RULES).count() == 0


def test_many_rules(spark, monkeypatch):
    """Nested rules at random, swept in blocks, against a plain search."""
    monkeypatch.setattr(url_filter, "RULES_PER_SWEEP", 7)
    rng = random.Random(8)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    path = lambda: "/" + "/".join(rng.choice("xy") for _ in range(rng.randrange(0, 4)))
    rules = list({(host(), path()): rng.choice(["allow", "block"]) for _ in range(60)}.items())
    rules = [(*k, v) for k, v in rules]
    urls = {i: (host(), path()) for i in range(400)}
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p) in urls.items()], "page_id long, url string")
    for r in url_filter.judge(pages, rules, default="none").collect():
        h, p = urls[r.page_id]
        fit = [(len(a) + 1, len(b), a + b, v) for a, b, v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        assert (r.rule, r.verdict) == ((max(fit)[2], max(fit)[3]) if fit else (None, "none"))


def test_shards(spark):
    rows = [(i, f"text {i}" if i % 7 else None, "x") for i in range(4000)] + [(5, "text 5", "x"), (5, "text 5", "x"), (None, "n", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = sharding.assign(docs, 16).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        t = rows[r.doc_id][1] if r.doc_id is not None else "n"
        assert (r.size, r.text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        assert r.grown_shard in (r.shard, 16)
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert all(180 < len(v) < 320 for v in by.values()) and 170 < sum(r.grown_shard == 16 for r in out) < 310
    assert {(r.doc_id, r.shard) for r in out} == {(r.doc_id, r.shard) for r in sharding.assign(docs.repartition(7), 16).collect()}
    assert len({r.shard for r in out if r.doc_id == 5}) == 1
    assert sharding.assign(docs.limit(0), 16).count() == 0


def test_tree_moves_rows_into_the_new_shard_only(spark):
    ids = spark.range(600).select(F.col("id").cast("string").alias("k"))
    r = ids.select(*(sharding.descend(F.col("k"), sharding.tree(n)).alias(f"n{n}") for n in range(1, 42))).collect()
    for n in range(1, 41):
        assert all(x[f"n{n + 1}"] in (x[f"n{n}"], n) for x in r) and any(x[f"n{n + 1}"] == n for x in r)


def test_shard_count_alone_decides(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(500)], "doc_id long, text string")
    for n in (3, 16, 17):
        now = {r.doc_id: r.grown_shard for r in sharding.assign(docs, n).collect()}
        assert now == {r.doc_id: r.shard for r in sharding.assign(docs, n + 1).collect()}


def test_weights_move_rows_into_the_grown_shard_only(spark):
    ids = spark.range(2000).select(F.col("id").cast("string").alias("k"))
    heavy = sharding.tree(8, weights={5: 3.0})
    r = ids.select(sharding.descend(F.col("k"), sharding.tree(8)).alias("a"), sharding.descend(F.col("k"), heavy).alias("b")).collect()
    assert all(x.b in (x.a, 5) for x in r) and 480 < sum(x.b == 5 for x in r) < 720


def test_containment(spark):
    item = "one two three four five six seven eight nine ten"
    docs = {1: f"before it {item.upper()} and after", 2: "one two three four five six", 3: "ONE two three four five SIX seven eight nine x " * 3, 4: None, 5: "", 6: "say hello world now", 7: "hello  world", 8: "hello there world"}
    frame = spark.createDataFrame([*docs.items(), (1, docs[1])], "doc_id long, text string").withColumn("item_id", F.lit(0))
    items = spark.createDataFrame([(10, item), (11, "Hello World"), (12, None), (13, ""), (10, item)], "item_id long, text string")
    got = sorted(tuple(r) for r in decontaminate.matches(frame, items).collect())
    assert got == [(1, 10, 6, 6), (1, 10, 6, 6), (3, 10, 5, 6), (6, 11, 1, 1), (7, 11, 1, 1)]
    assert decontaminate.matches(frame.limit(0), items).count() == 0 == decontaminate.matches(frame, items.limit(0)).count()
    assert {r.doc_id for r in decontaminate.clean(frame, items).collect()} == {2, 4, 5, 8}


def test_segments():
    rng = random.Random(3)
    for _ in range(200):
        s = toxicity.np.array([rng.choice([2.0, 0.5, 1.0]) if rng.random() < 0.2 else -toxicity.DRIFT for _ in range(rng.randrange(0, 60))])
        found = toxicity.segments(s)
        best = max((s[i:j].sum() for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=0.0)
        assert abs(max((x for *_, x in found), default=0.0) - max(best, 0.0)) < 1e-9
        assert all(abs(s[a:b].sum() - x) < 1e-9 and x > 0 for a, b, x in found)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))


def test_toxicity(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [word() for _ in range(rng.randrange(5, 80))]
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile!", "rotten,", "AWFUL"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame([*rows, (1000, None), (1001, ""), (None, "vile thing")], "doc_id long, text string").withColumn("score", F.lit("old"))
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i] >= 0.7) == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert got[1000] == got[1001] < 0.5 and all(0 <= v <= 1 for v in got.values())
    found = toxicity.passages(docs, model).collect()
    text = dict(rows)
    assert {r.doc_id for r in found} and all(any(w in text.get(r.doc_id, "vile thing").encode()[r.start : r.end].decode().lower() for w in ("vile", "rotten", "awful")) for r in found)
    empty = toxicity.fit(docs, lab.limit(0))
    assert toxicity.scored(docs.limit(0), empty).count() == 0 and toxicity.scored(docs, empty).count() == 603


def test_large_url_ids_beside_nulls(spark):
    pages = spark.createDataFrame([(2**53 + 1, "http://a.com/"), (None, "http://b.net/es/")], "page_id long, url string").coalesce(1)
    with setting(spark, "spark.sql.shuffle.partitions", "1"):
        got = {tuple(r) for r in url_filter.judge(pages, url_filter.RULES).collect()}
    assert got == {(2**53 + 1, "a.com", "/", "com/", "allow"), (None, "b.net", "/es/", "net/es/", "block")}
    long = "/" + "x" * 70_000
    rules = [("b.com", "/", "block"), ("com", long, "allow"), ("com", long + "y", "block")]
    pages = spark.createDataFrame([("p", "http://a.com" + long + "yz"), ("q", "http://a.b.com" + long)], "page_id string, url string")
    assert {(r.page_id, r.verdict) for r in url_filter.judge(pages, rules).collect()} == {("p", "block"), ("q", "block")}


def test_large_ids_beside_nulls(spark):
    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "one two three four five six"), (None, "x")], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(big, "one two three four five six")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.matches(docs, items).collect()] == [(big, big, 2, 2)]
    model = toxicity.Model(toxicity.np.zeros(0, toxicity.np.uint64), toxicity.np.zeros(0))
    out = toxicity.scored(docs, model)
    assert out.schema["doc_id"].dataType.simpleString() == "bigint" and {r.doc_id for r in out.collect()} == {big, None}
