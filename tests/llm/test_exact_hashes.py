"""Words that collide under any polynomial modulo a power of two must not be taken as equal."""

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer
from verdigris.llm import decontaminate, ngram_join, passage_dedup, quality, textkit, token_files


def thue_morse(n, swap=False):
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(n))


@pytest.fixture(params=[1024, 4096])
def pair(request):
    return thue_morse(request.param), thue_morse(request.param, True)


def test_spans_and_numbers(pair):
    buf = np.frombuffer(" ".join([*pair, pair[0], "a", "ab", "a"]).encode(), np.uint8)
    w = textkit.Words([buf.tobytes()])
    for family in (0, 1, 2):
        h = textkit.span_hash(w.buf, w.start, w.end, family)
        assert h[0] == h[2] != h[1] and h[3] == h[5] != h[4]
    number, first = textkit.numbered(w.buf, w.start, w.end, np.zeros(6, np.uint64))  # all hashes collide
    assert number.tolist() == [0, 1, 0, 2, 3, 2] and first.tolist() == [0, 1, 3, 4]


def test_repeated_windows(pair):
    a, b = pair
    x = quality._measure([f"{a} 1 2 3 4 {b} 1 2 3 4".encode(), f"{a} 1 2 3 4 {a} 1 2 3 4".encode()])
    assert x["n_repeat_words"].tolist() == [0, 10] and x["n_distinct_words"].tolist() == [6, 5]


def test_matches(spark, pair):
    a, b = pair
    docs = spark.createDataFrame([(1, f"x {a} p q r s t"), (2, f"x {b} p q r s t")], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"{a} p q r s")], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.matches(docs, items).collect()] == [(1, 7, 1, 1)]


def test_matches_compare_bytes():
    """Hashes of two items that agree must not make a match."""
    index = decontaminate.build([(7, b"one two three four five six")], 0.8)[5]
    w = textkit.Words([b"uno dos tres cuatro cinco seis"])
    index.hashes = [np.sort(textkit.shingles(w, 5)[0])]
    index.tables = {2: decontaminate.Table(index.hashes, [0])}
    assert list(index.search(w, 5)) == []


def test_links(spark, pair):
    a, b = pair
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a} x y"), (4, f"{b} x y"), (5, f"{a}  x y")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in ngram_join.joined(docs).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 3)}


def test_links_compare_bytes(monkeypatch):
    """Hashes that agree must not make a link."""
    monkeypatch.setattr(ngram_join, "sets", lambda texts, width: [(np.arange(20, dtype=np.uint64),) for _ in texts])
    for texts, want in (([b"a b c", b"a b d"], []), ([b"a b c", b"A b  c"], [(5, 6)])):
        rows = [(0, 5 + i, i, t, 0) for i, t in enumerate(texts)]
        assert ngram_join._task(rows, ngram_join.Rule()) == want


def test_passages(spark, pair):
    a, b = pair
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    seen, want = set(), {}
    for k, t in ((1, a), (2, b), (3, a)):
        gone = bytearray(len(t))
        for i in range(len(t) - 99):
            gone[i : i + 100] = b"\x01" * 100 if t[i : i + 100] in seen else gone[i : i + 100]
            seen.add(t[i : i + 100])
        kept = bytes(c for c, g in zip(t.encode(), gone, strict=True) if not g)
        want[k] = (sum(gone), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in passage_dedup.cleaned(docs).collect()} == want


def test_token_ids(spark, pair):
    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = spark.createDataFrame([(1, pair[0]), (2, pair[1]), (3, pair[0])], "doc_id long, text string")
    want = {k: zlib.crc32(np.array([*library.encode(pair[k % 2 == 0], add_special_tokens=False).ids, 2], "<u4").tobytes()) for k in (1, 2, 3)}
    assert {r.doc_id: r.ids_crc32 for r in token_files.read(token_files.write(docs, path)).collect()} == want
