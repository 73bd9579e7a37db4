import hashlib
import itertools
import random
import re

import duckdb
import pytest
from verdigris.llm import conversations as C

FORM = re.compile(r"(s?(ua)+)?")


def faults(rows):
    """(blank, duplicate, truncated) of each row (turn, role, text) by its first fault."""
    seen, out = set(), []
    for _, role, text in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", text)
        kind = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append(kind)
    return out


def brute(rows):
    """cost, audit, sha256: every edit sequence of a few rows, inserts of up to two turns at each place."""
    inserts = [()] + [(x,) for x in "ua"] + [(x, y) for x in "ua" for y in "ua"]
    options = []
    for (_, role, text), fault in zip(rows, faults(rows), strict=True):
        options.append(inserts)
        own = [("D", 2, None)]
        if fault not in ("blank", "duplicate"):
            more = 5 * (fault == "truncated")
            own += [("K", more, (role, text)), ("R", 1 + more, ("user", text)), ("R", 1 + more, ("assistant", text))]
        options.append(own)
    options.append(inserts)
    best = None
    for pick in itertools.product(*options):
        cost, audit, lines, initials = 0, "", [], []
        for x in pick:
            if x and isinstance(x[0], str) and x[0] in "DKR":
                cost, audit = cost + x[1], audit + x[0]
                lines += [f"{x[2][0]}:{x[2][1]}"] if x[2] else []
                initials += [x[2][0][:1] or "?"] if x[2] else []
            else:
                cost, audit = cost + 5 * len(x), audit + "I" * len(x)
                lines += [{"u": "user:", "a": "assistant:"}[y] for y in x]
                initials += x
        if FORM.fullmatch("".join(initials)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, "\n".join(lines))
    return best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest()


def counts(rows):
    turns = [t for t, *_ in rows if t is not None]
    f, initials = faults(rows), [r[:1] for _, r, _ in rows]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(f.count(k) for k in ("blank", "duplicate", "truncated")), sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])))


def invented(rng, n):
    rows = []
    for k in range(n):
        turn = rng.choice([None, k, k, k + rng.randrange(3)])
        rows.append((turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), rng.choice([f"Text {k}.", f"Text {k}", "Same!", "", " \n", "Why?\t", f"é{k}!"])))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))


def coded(rows):
    out = []
    for turn, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        out.append((turn, role, text, hashlib.sha256(text.encode()).hexdigest(), 0 if not body else 1 + 2 * ("sua".find(role[0]) if role[:1] and role[0] in "sua" else 3) + (body[-1] not in ".!?")))
    return out


def test_edits_against_every_sequence():
    rng = random.Random(12)
    for n in (0, 1, 1, 2, 2, 2, 3, 3, 3, 3, 3, 3):
        for _ in range(4 if n == 3 else 15):
            rows = invented(rng, n)
            assert C.repair(coded(rows)) == (*counts(rows), *brute(rows)), rows


@pytest.mark.parametrize(("rows_", "bytes_", "n"), [(10_000, 1 << 20, 4), (3, 1 << 20, 5), (10_000, 20, 3), (10_000, 1 << 20, 40)])
def test_pieces(spark, monkeypatch, rows_, bytes_, n):
    """Conversations of many pieces come out as whole ones."""
    monkeypatch.setattr(C, "LONG", rows_)
    monkeypatch.setattr(C, "LONG_BYTES", bytes_)
    monkeypatch.setattr(C, "partitions", lambda spark: n)
    rng = random.Random(n)
    held = {f"v{k}": invented(rng, rng.choice([1, 2, 5, 9, 30])) for k in range(12)} | {"n": invented(rng, 150), "v99": [(1, "user", "Same!")] * 40}
    flat = [(c, *r) for c, rows in held.items() for r in rows]
    rng.shuffle(flat)
    got = {r.c: tuple(r)[1:] for r in C.repaired(spark.createDataFrame(flat, "c string, turn long, role string, text string")).collect()}
    assert got == {c: C.repair(coded(rows)) for c, rows in held.items()}


def test_odd_rows(spark):
    rows = [(1, None, None, None, 5), (1, 0, "user", "Hi.", 5), (1, 1, "assistant", "Yes.", 5), (None, 0, "user", "Hello!", 5), (None, None, "user", "Hello!", 5), (3, 4, "system", "S.", 5), (3, 4, "system", "S.", 5), (3, 2**62, "", "x.", 5), (4, 0, "user", "a b " * 50000, 5)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost int")
    got = {r.conv_id: tuple(r)[1:] for r in C.audited(table.select("conv_id", "turn", "role", "text", "cost"), spark.createDataFrame([(1,), (None,), (3,), (4,), (9,), (9,)], "conv_id long")).collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {
        1: (0, 1, 0, 0, 1, 2, "DKK", digest("user:Hi.\nassistant:Yes.")),
        None: (0, 0, 1, 0, 1, 4, "DD", digest("")),
        3: (2**62 - 4 + 1 - 2, 0, 1, 0, 2, 4, "RDR", digest("user:S.\nassistant:x.")),
        4: (0, 0, 0, 1, 0, 2, "D", digest("")),
        9: (0, 0, 0, 0, 0, 0, "", digest("")),
    }
    assert C.audited(table.limit(0), table.limit(0)).count() == 0


def test_damage_and_whole_table(spark):
    """The damaged table against SQL, with rows that hold nulls and ties too."""
    sf = "/root/testdata/sf0.001"
    extra = "SELECT * FROM (VALUES (CAST(NULL AS BIGINT), CAST(3 AS BIGINT), 'user', 'Hi.'), (NULL, NULL, NULL, NULL), (7000, 1, 'tool', 'x'), (7000, 1, 'user', 'Hm.'), (7001, NULL, '', 'y.')) AS t(conv_id, turn, role, text)"
    c = duckdb.connect()
    c.sql(f"CREATE TABLE conversations AS SELECT conv_id, turn, role, text FROM '{sf}/conversations.parquet' UNION ALL {extra}")
    want = c.sql(C.ORACLE)
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").unionAll(spark.sql(extra))
    got = C.audited(C.damaged(rows), rows)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)
