import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from verdigris.llm import bpe


@pytest.fixture(scope="module")
def pair():
    own = bpe.encoder(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.monoid.ranks, special_tokens={})


CASES = ["", " ", "a", "  two  spaces ", "line\nline\n\nline\n", " lead", "tab\tand\r\nmore", "x y  z", "<|endoftext|>", "don't we'll", "1234 5678", "çé ñ 漢字 😀!!", "a" * 5000, "=" * 3001, " " * 777, "ab" * 999, "\n" * 55, "a\n b \n c", "\x1c a", "a\x85b c"]


@pytest.mark.parametrize("text", CASES)
def test_as_the_library(pair, text):
    own, library = pair
    assert own(text) == library.encode_ordinary(text)
    assert own.monoid.decode(own(text)) == text.encode()


def test_random_pieces(pair):
    own, library = pair
    rng = random.Random(5)
    alphabets = ["ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "éèçaeu", "=-_*#", "0123456789"]
    for _ in range(1500):
        a = rng.choice(alphabets)
        text = "".join(rng.choice(a) for _ in range(rng.randrange(1, 300)))
        assert own(text) == library.encode_ordinary(text)


def test_join_is_associative(pair):
    m = pair[0].monoid
    rng = random.Random(6)
    for _ in range(300):
        a, b, c = ("".join(rng.choice("thenrsion") for _ in range(rng.randrange(0, 40))).encode() for _ in range(3))
        x = m.join(m.join(m.tree(a), m.tree(b)), m.tree(c))
        assert x == m.join(m.tree(a), m.join(m.tree(b), m.tree(c))) == m.merge(a + b + c)


def test_rows(spark, pair):
    rows = [(1, "the cat", "x"), (2, None, "x"), (2, "", "y"), (None, "the cat", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).collect()}
    ids = pair[1].encode_ordinary("the cat")
    full = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(b"the cat").hexdigest())
    none = (0, hashlib.sha256(b"").hexdigest(), hashlib.sha256(b"").hexdigest())
    assert got == {(1, *full), (None, *full), (2, *none)}
    assert bpe.digests(docs.limit(0), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).count() == 0
