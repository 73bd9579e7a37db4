import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer
from verdigris.llm import token_files as T
from verdigris.llm.common import setting

PATH = P.path("word_bpe_49k.json")
CASES = ["", None, "The cat, the CAT!! don't", "É!!! ÇA? naïve… §5 § x ~ a~b ~~ ~", "a" * 400, "1,234.5%%% ###", "<|endoftext|> <|startoftext|>", "é å   x y", "日本語。 😀😀", "...", "!!!!!!!!!!!!!!!!!!!!!!x", "ß ſ İ Σ ΑΣ", "a\x00b\x1cc", "2 # 2", "\n\t \r", "it's'll 'd x's."]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["the", "and", "thereby", "idiot.", "éclair", "Über,", "x" * 9, "42", "##", "a-b"]) for _ in range(n))


def test_encoder(library):
    texts = [*(c or "" for c in CASES), words(1, 500)]
    flat, n = T.Encoder(PATH)([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [library(t) for t in texts]


def no_pair_twice(seq):
    """Of a run of one id, places that overlap count once."""
    places: dict = {}
    for i, p in enumerate(zip(seq.tolist(), seq[1:].tolist(), strict=False)):
        if places.get(p, [-2])[-1] != i - 1 or p[0] != p[1]:
            places.setdefault(p, []).append(i)
    return all(len(v) == 1 for v in places.values())


@pytest.mark.parametrize("ids", [[], [5], [5, 5], [5] * 3, [5] * 1000, [1, 2] * 700 + [3], list(range(50)) * 2, [1, 1, 2, 1, 1, 2, 2, 2, 1] * 40])
def test_nothing_repeats(ids):
    ids = np.array(ids, np.uint32)
    row = T.compress(ids, np.array([len(ids)]), 49408)
    seq, rules, rounds = T._arrays(row)
    assert no_pair_twice(seq) and (T.expand(seq, rules, rounds) == ids).all() and (T.expand_all(seq, rules, rounds) == ids).all()


def test_added_tokens(library):
    texts = ["end <|endoftext|> here", "a<|EndOfText|>b", "x<|startoftext|><|endoftext|>y", "plain", ""]
    flat, n = T.Encoder(PATH)([t.encode() for t in texts])
    assert [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])] == [library(t) for t in texts]


def test_round_trip_and_random_access():
    rng = np.random.default_rng(3)
    lengths = np.r_[rng.integers(0, 300, 60), 0, 5000, 1]
    ids = np.where(rng.random(lengths.sum()) < 0.7, rng.integers(0, 6, lengths.sum()), rng.integers(0, 49408, lengths.sum())).astype(np.uint32)
    ids[-4000:] = 7  # pairs that overlap in a row
    row = T.compress(ids, np.cumsum(lengths), 49408)
    seq, rules, rounds = T._arrays(row)
    assert len(rules) and len(seq) < len(ids)
    assert (T.expand(seq, rules, rounds) == ids).all()
    for i, part in enumerate(np.split(ids, np.cumsum(lengths)[:-1])):
        assert (T.document(row, i) == part).all()
    for i, j in [(0, 1), (0, len(ids)), (17, 9000), (len(ids) - 3, len(ids)), (5, 5)]:
        assert (T.ids_between(row, i, j) == ids[i:j]).all()
    assert (T.expand_all(seq, rules, rounds) == ids).all()
    assert no_pair_twice(seq)
    assert np.frombuffer(row["expansions"], "<u4").tolist() == [len(T.expand(np.array([49408 + i]), rules, rounds)) for i in range(len(rules))]


def test_files(spark, library):
    texts = [*CASES, words(2, 3000), words(3, 10), words(3, 10)]
    rows = [(i * 3 % 31, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in T.read(T.write(docs, PATH)).collect()}
    start, want = 0, {}
    for k, t, _ in sorted(rows):
        ids = [*library(t), 2]
        want[k] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert got == want
    assert T.read(T.write(docs.limit(0), PATH)).count() == 0
    one = spark.createDataFrame([(None, "a"), (2**53 + 1, "b")], "doc_id long, text string").coalesce(1)
    with setting(spark, "spark.sql.shuffle.partitions", "1"):
        assert {r.doc_id for r in T.read(T.write(one, PATH)).collect()} == {None, 2**53 + 1}
    odd = spark.createDataFrame([(None, "a"), (2**60 + 1, "b"), (2**60 + 1, "b")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.start) for r in T.read(T.write(odd, PATH)).collect()) == [(0, 0), (2**60 + 1, 2), (2**60 + 1, 4)]


def test_blocks_hold_what_they_say(spark, monkeypatch):
    """A block ends with the document that fills it, also where many documents are encoded together."""
    texts = [words(i, 400) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    with setting(spark, "spark.sql.shuffle.partitions", "1"):
        blocks = T.write(docs, PATH).select("block", "n_ids", "lengths").orderBy("part", "block").collect()
    assert len(blocks) > 1 and all(b.n_ids - b.lengths[-1] < T.BLOCK for b in blocks)
