import random

from verdigris.llm import colbwt


def test_suffix_order(tmp_path):
    rng = random.Random(4)
    for n in (1, 3, 8):
        texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 25))).encode() for _ in range(n)]
        symbols, lcp, doc, start = colbwt.construct(texts, str(tmp_path))
        want = sorted(((t[i:], d, i) for d, t in enumerate(texts) for i in range(len(t) + 1)), key=lambda x: ([c + 1 for c in x[0]] + [0], x[1]))
        assert [(d, s) for d, s in zip(doc.tolist(), start.tolist(), strict=True)] == [(d, i) for _, d, i in want]
        assert symbols.tolist() == [texts[d][i - 1] + 1 if i else 0 for _, d, i in want]
        for k in range(1, len(want)):
            a, b = want[k - 1][0], want[k][0]
            assert lcp[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


def test_repeats(tmp_path):
    rng = random.Random(9)
    passage = "".join(rng.choice("abcde ") for _ in range(60))
    texts = ["".join(rng.choice([passage, "xy", "z ", passage[:40]]) for _ in range(rng.randrange(0, 12))).encode() for _ in range(14)]
    seen, want = set(), set()
    for d, t in enumerate(texts):
        for i in range(len(t) - 29):
            if t[i : i + 30] in seen:
                want.add((d, i))
            seen.add(t[i : i + 30])
    assert colbwt.repeated(texts, str(tmp_path), 30) == want
