"""Conversation structure repair: the cheapest edits that give a dialogue its form, the least of them by letters.

A conversation is repaired when its roles' initials read (s?(ua)+)?: nothing, or an optional system turn and pairs of
user and assistant. Rows are kept (K, 0), given the role user or assistant (R, 1) or deleted (D, 2; the only edit for
blank and duplicate rows); empty turns of user or assistant are inserted anywhere (I, 5); truncated rows that stay
cost 5 more.

The edits are arcs between (row, state of the form). Forward and backward minimum costs tell which arcs are tight, that is on
some cheapest path: forward + arc + backward = total. The tight arcs form an acyclic graph whose paths are all optimal
edits; a walk holds the frontier of states it can be in and takes the least letter that leaves it at each step. As any state
has one role that it lets R and I give, a frontier here is one state and the letters decide the repaired rows.

Rows are range partitioned by conversation and place, so a conversation of any length is dealt over as many
tasks as it fills. What lies within a partition is repaired there. Conversations that are cut at its ends, or exceed LONG rows or
LONG_BYTES of text, go on as pieces: a piece is a (min, +) matrix of four states, these are multiplied along the
conversation forwards and backwards, then each piece says where it leaves from each state, and last it walks from the
state that it is entered in. Only the hash of a conversation is taken in one stream, by its nature, holding no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, partitions, small_batches, written

LONG, LONG_BYTES = 10_000, 8 << 20
INF = 1 << 60
BLANKS = " \t\n\x0b\x0c\r"
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. The role that each lets follow, and the state then.
NEXT = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
START, END = [0, INF, INF, INF], [0, 10, 5, 0]  # END: what inserts complete
LETTERS = "sua"


def _arcs(code: int) -> list[list[tuple[str, int, int, int]]]:
    """By state: (letter, cost, state after, rows taken) for a row of a code; -1: no row. Codes: 0 delete only, else
    1 + 2 * initial (s, u, a, another) + truncated."""
    out = []
    for q, (role, to) in NEXT.items():
        own = [("I", 5, to, 0)]
        if code >= 0:
            own.append(("D", 2, q, 1))
        if code > 0:
            initial, more = (code - 1) // 2, 5 * ((code - 1) % 2)
            own.append(("R", 1 + more, to, 1))
            if initial < 3 and (LETTERS[initial] == role[0] or (initial, q) == (0, 0)):
                own.append(("K", more, to if initial else 1, 1))
        out.append(own)
    return out


ARCS = {code: _arcs(code) for code in range(-1, 9)}


def _inserted(f: list[int]) -> list[int]:
    """Forward costs at a place, with inserts there."""
    u = min(f[2], f[0] + 5, f[1] + 5, f[3] + 5)
    return [f[0], f[1], u, min(f[3], u + 5)]


def forward(codes: list[int], f: list[int]) -> list[list[int]]:
    """Costs to reach each state at each place, inserts there included; after them what the last row leads to, without."""
    out = []
    for code in codes:
        f = _inserted(f)
        out.append(f)
        to = [INF] * 4
        for q, arcs in enumerate(ARCS[code]):
            for _, c, r, taken in arcs:
                if taken and f[q] + c < to[r]:
                    to[r] = f[q] + c
        f = to
    return [*out, f]


def backward(codes: list[int], b: list[int]) -> list[list[int]]:
    """Costs from each state at each place to the end, b at the last."""
    out = [b]
    for code in reversed(codes):
        b = [min(c + b[r] for _, c, r, taken in arcs if taken) for arcs in ARCS[code]]
        b[2] = min(b[2], b[3] + 5)
        b = [min(b[0], b[2] + 5), min(b[1], b[2] + 5), b[2], min(b[3], b[2] + 5)]
        out.append(b)
    return out[::-1]


def walk(codes: list[int], ahead: list[list[int]], back: list[list[int]], total: int, frontier: frozenset[int], ends: bool) -> tuple[list[list[tuple[str, int]]], frozenset[int]]:
    """The (letter, state after) before and with each row, after the last where the conversation ends, and the frontier then."""
    out = []
    for i, code in enumerate([*codes, -1] if ends else codes):
        own, arcs, taken = [], ARCS[code], 0
        while not taken:
            tight = [(letter, r, step) for q in frontier for letter, c, r, step in arcs[q] if ahead[i][q] + c + back[i + step][r] == total]
            if not tight:
                break  # only at the end
            least = min(tight)[0]
            frontier, taken = frozenset(r for letter, r, _ in tight if letter == least), min(t for letter, _, t in tight if letter == least)
            own.append((least, min(frontier)))
        out.append(own)
    return out, frontier


def lines(edits: list[tuple[str, int]], role: str, text: str) -> list[str]:
    """The repaired rows of some edits, role and text being those of the row that the last may take."""
    return [f"{role}:{text}" if x == "K" else f"{NEXT[2 if q == 3 else 0][0]}:{text if x == 'R' else ''}" for x, q in edits if x != "D"]


def _seen(rows: list[tuple]) -> list[bool]:
    seen, out = set(), []
    for r in rows:
        k = (r[1], r[3])
        out.append(k in seen)
        seen.add(k)
    return out


def _stats(rows: list[tuple], codes: list[int], again: list[bool]) -> list[int]:
    """minimum, maximum and number of turns (None, None, 0 without), blank, duplicate, truncated, illegal."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1][:1] for r in rows]
    return [
        min(turns, default=None), max(turns, default=None), len(set(turns)), sum(r[4] == 0 for r in rows), sum(a and r[4] > 0 for a, r in zip(again, rows, strict=True)),
        sum(c > 0 and c % 2 == 0 for c in codes), sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:])),
    ]


def _gaps(low: int | None, high: int | None, n: int) -> int:
    return 0 if low is None else min(high - low + 1 - n, 2**63 - 1)


def repair(rows: list[tuple]) -> tuple:
    """gaps, blank, duplicate, truncated, illegal, cost, audit, sha256 of a conversation: rows (turn, role, text, digest, code)."""
    again = _seen(rows)
    codes = [0 if a else r[4] for a, r in zip(again, rows, strict=True)]
    ahead, back = forward(codes, START), backward(codes, END)
    total = back[0][0]
    ahead[-1] = _inserted(ahead[-1])
    edits, _ = walk(codes, ahead, back, total, frozenset([0]), True)
    text = "\n".join(x for e, r in zip(edits, [*rows, (None, "", "", "", 0)], strict=True) for x in lines(e, r[1], r[2]))
    low, high, n, *counts = _stats(rows, codes, again)
    return (_gaps(low, high, n), *counts, total, "".join(x for e in edits for x, _ in e), hashlib.sha256(text.encode()).hexdigest())


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROW = "turn string, role string, text string, digest string, code int"
_FIELDS = ["turn", "role", "text", "digest", "code"]


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns, dtype=object)  # whole numbers beside nulls stay exact


def _rows(b: pd.DataFrame) -> list[tuple]:
    turn = [None if t is None or t != t else int(t) for t in b["turn"]]
    return list(zip(turn, b["role"], b["text"], b["digest"], b["code"].tolist(), strict=True))


def _runs(b: pd.DataFrame, by: list[str]) -> Iterator[tuple[int, int]]:
    k = b[by].to_numpy(object)
    edge = np.flatnonzero(np.append(True, (k[1:] != k[:-1]).any(1))).tolist()
    yield from zip(edge, [*edge[1:], len(b)], strict=True)


_OPEN = ["c", "pid", "idx", *_FIELDS]
_RESULT = [x.split()[0] for x in RESULT.split(", ")]


def _within(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of conversations that begin and end in this partition; the rows of the others, numbered."""
    from pyspark import TaskContext

    pid, columns, none = TaskContext.get().partitionId(), [*_OPEN, *_RESULT], (None,) * len(_RESULT)
    c, held, size, cut, idx, first = None, [], 0, True, 0, True

    def flushed() -> list[tuple]:
        nonlocal held, size, idx
        out = [(c, pid, idx + i, None if r[0] is None else str(r[0]), *r[1:], *none) for i, r in enumerate(held)]
        idx, held, size = idx + len(held), [], 0
        return out

    for b in batches:
        out, rows, names = [], _rows(b), b["c"].to_list()
        for i, j in _runs(b, ["c"]) if len(b) else []:
            if names[i] != c:
                if c is not None:
                    if cut:
                        out += flushed()
                    else:
                        out.append((c, *(None,) * (len(_OPEN) - 1), *repair(held)))
                        held, size = [], 0
                    first = False
                c, cut = names[i], first
            held += rows[i:j]
            size += sum(len(r[2]) for r in rows[i:j])
            cut = cut or len(held) > LONG or size > LONG_BYTES
            if cut:
                out += flushed()
        yield _frame(out, columns)
    yield _frame(flushed(), columns)


def _by_piece(batches: Iterable[pd.DataFrame], done, state) -> Iterator[pd.DataFrame]:
    """Rows by (c, pid, idx), one piece held at a time; done(c, pid, rows, batch's row) gives a frame."""
    last, held, about = None, [], None
    for b in batches:
        out = []
        for i, j in _runs(b, ["c", "pid"]) if len(b) else []:
            k = (b["c"].iloc[i], int(b["pid"].iloc[i]))
            if k != last and last is not None:
                out.append(done(*last, held, about))
                held = []
            if k != last:
                about = state(b.iloc[i])
            last = k
            held += list(zip(_rows(b.iloc[i:j]), b["again"].iloc[i:j].tolist(), b["idx"].iloc[i:j].tolist(), strict=True))
        if out:
            yield pd.concat(out, ignore_index=True)
    if last is not None:
        yield done(*last, held, about)


def _codes(held: list[tuple]) -> list[int]:
    return [0 if again else r[4] for r, again, _ in held]


PIECE = "c string, pid int, n long, matrix array<long>, stats array<string>, ends array<string>"


def _measured(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each piece: its matrix, its counts, and the turn and initial of its first and last row."""

    def done(c, pid, held, _):
        codes, rows = _codes(held), [r for r, *_ in held]
        matrix = [x for q in range(4) for x in forward(codes, [0 if p == q else INF for p in range(4)])[-1]]
        text = lambda x: None if x is None else str(x)
        stats = [text(x) for x in _stats(rows, codes, [a for _, a, _ in held])]
        return _frame([(c, pid, len(rows), matrix, stats, [text(rows[0][0]), rows[0][1][:1], text(rows[-1][0]), rows[-1][1][:1]])], ["c", "pid", "n", "matrix", "stats", "ends"])

    return _by_piece(batches, done, lambda _: None)


COMBINED = "c string, pid int, ahead array<long>, back array<long>, last boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _combined(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Costs before and after each piece, and the counts of its conversation; the pieces of one are held at a time."""

    def done(pieces: list) -> list[tuple]:
        ms = [np.minimum(np.array(p.matrix, np.int64).reshape(4, 4), INF) for p in pieces]
        f, fs = np.array(START), []
        for m in ms:
            fs.append(f)
            f = np.minimum((f[:, None] + m).min(0), INF)
        b, bs = np.array(END), []
        for m in reversed(ms):
            bs.append(b)
            b = np.minimum((m + b[None]).min(1), INF)
        stats = [[None if x is None else int(x) for x in p.stats] for p in pieces]
        n, illegal = sum(s[2] for s in stats), sum(s[6] for s in stats)
        for x, y in zip(pieces, pieces[1:]):
            n -= x.ends[2] is not None and x.ends[2] == y.ends[0]
            illegal += (x.ends[3] or "") + (y.ends[1] or "") not in ("su", "ua", "au")
        low, high = min((s[0] for s in stats if s[0] is not None), default=None), max((s[1] for s in stats if s[1] is not None), default=None)
        counts = (_gaps(low, high, n), *(sum(s[k] for s in stats) for k in (3, 4, 5)), illegal, int(b[0]))
        return [(p.c, p.pid, f.tolist(), b.tolist(), p is pieces[-1], *counts) for p, f, b in zip(pieces, fs, bs[::-1], strict=True)]

    held, columns = [], [x.split()[0] for x in COMBINED.split(", ")]
    for b in batches:
        out = []
        for p in b.itertuples(index=False):
            if held and held[0].c != p.c:
                out += done(held)
                held = []
            held.append(p)
        yield _frame(out, columns)
    yield _frame(done(held) if held else [], columns)


def _about(r: pd.Series) -> tuple:
    return list(map(int, r["ahead"])), list(map(int, r["back"])), int(r["cost"]), bool(r["last"]), r.get("state")


def _walked(held: list[tuple], about: tuple, state: int) -> tuple[list[list[tuple[str, int]]], frozenset[int]]:
    codes, (f, b, total, last, _) = _codes(held), about
    ahead, back = forward(codes, f), backward(codes, b)
    ahead[-1] = _inserted(ahead[-1])
    return walk(codes, ahead, back, total, frozenset([state]), last)


def _led(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(c, pid, to): the state that the walk leaves a piece in, by the state that it enters it in; -1 where that is not optimal."""

    def done(c, pid, held, about):
        codes, (f, b, total, _, _) = _codes(held), about
        ahead, back = forward(codes, f), backward(codes, b)
        # an entry is optimal where its cost and what is left add up; otherwise no walk begins there
        to = [min(_walked(held, about, q)[1]) if f[q] + back[0][q] == total and ahead[0][q] == f[q] else -1 for q in range(4)]
        return _frame([(c, pid, to)], ["c", "pid", "to"])

    return _by_piece(batches, done, _about)


def _entered(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(c, pid, state): the state in which the walk enters each piece. Pieces come in order."""
    last, state = None, 0
    for b in batches:
        out = []
        for c, pid, to in zip(b["c"], b["pid"].tolist(), b["to"], strict=True):
            state = 0 if c != last else state
            out.append((c, pid, state))
            last, state = c, int(to[state])
        yield _frame(out, ["c", "pid", "state"])


def _edited(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(c, pid, idx, letters, part): the edits of each row and the repaired rows that they give, or null for none."""

    def done(c, pid, held, about):
        edits, _ = _walked(held, about, int(about[4]))
        ends, out = len(held) < len(edits), []
        for k, (r, _, idx) in enumerate(held):
            own = edits[k] + (edits[-1] if ends and k + 1 == len(held) else [])
            got = lines(edits[k], r[1], r[2]) + (lines(edits[-1], "", "") if ends and k + 1 == len(held) else [])
            out.append((c, pid, idx, "".join(x for x, _ in own), "\n".join(got) if got else None))
        return _frame(out, ["c", "pid", "idx", "letters", "part"])

    return _by_piece(batches, done, _about)


def _streamed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(c, audit, repaired_sha256) of conversations whose edits come in order; letters and a hash are held."""
    last, letters, digest, empty = None, [], hashlib.sha256(), True
    for b in batches:
        out = []
        for c, x, part in zip(b["c"], b["letters"], b["part"], strict=True):
            if c != last:
                if last is not None:
                    out.append((last, "".join(letters), digest.hexdigest()))
                last, letters, digest, empty = c, [], hashlib.sha256(), True
            letters.append(x)
            if part is not None:
                digest.update((part if empty else "\n" + part).encode())
                empty = False
        yield _frame(out, ["c", "audit", "repaired_sha256"])
    yield _frame([(last, "".join(letters), digest.hexdigest())] if last is not None else [], ["c", "audit", "repaired_sha256"])


def repaired(rows: DataFrame) -> DataFrame:
    """c, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conversation c of rows (c
    string, turn long, role string, text string; of these only turn may be null)."""
    spark = rows.sparkSession
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.expr(" ".join(f"WHEN left(role, 1) = '{x}' THEN {i}" for i, x in enumerate(LETTERS)).join(["CASE ", " ELSE 3 END"]))
    code = F.when(end == "", 0).otherwise(1 + 2 * initial + (~F.right(end, F.lit(1)).isin(".", "!", "?")).cast("int"))
    typed = rows.select("c", "turn", "role", F.sha2("text", 256).alias("digest"), F.monotonically_increasing_id().alias("uid"), "text", code.cast("int").alias("code"))
    order = ["c", "turn", "role", "digest", "uid"]
    n = partitions(spark)
    with small_batches(spark):
        placed = typed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("c", F.col("turn").cast("string").alias("turn"), "role", "text", "digest", "code")
        first = written(placed.mapInPandas(_within, f"c string, pid int, idx long, {ROW}, {RESULT}"), "conversations")
        open_ = first.where("pid IS NOT NULL").select(*_OPEN)
        place = F.struct("pid", "idx")
        firsts = open_.groupBy("c", "role", "digest").agg(F.min(place).alias("first"))
        open_ = written(open_.join(firsts.hint("merge"), ["c", "role", "digest"]).select(*_OPEN, (F.col("first") < place).alias("again")), "pieces")
        by_piece = lambda df: df.repartition(n, "c", "pid").sortWithinPartitions("c", "pid", "idx")
        measured = by_piece(open_).mapInPandas(_measured, PIECE)
        about = written(measured.repartition(n, "c").sortWithinPartitions("c", "pid").mapInPandas(_combined, COMBINED), "costs")
        vectors = about.select("c", "pid", "ahead", "back", "cost", "last")
        led = by_piece(open_.join(vectors.hint("merge"), ["c", "pid"])).mapInPandas(_led, "c string, pid int, to array<int>")
        entered = led.repartition(n, "c").sortWithinPartitions("c", "pid").mapInPandas(_entered, "c string, pid int, state int")
        edited = by_piece(open_.join(vectors.join(entered, ["c", "pid"]).hint("merge"), ["c", "pid"])).mapInPandas(_edited, "c string, pid int, idx long, letters string, part string")
        streamed = edited.repartition(n, "c").sortWithinPartitions("c", "pid", "idx").mapInPandas(_streamed, "c string, audit string, repaired_sha256 string")
        counts = about.where("last").select("c", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")
        out = written(first.where("pid IS NULL").select("c", *_RESULT).unionByName(counts.join(streamed, "c")), "repaired")
    discard(first, open_, about)
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults, chosen by crc32 of conv_id:turn modulo 20; nulls are one space each."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(own("conv_id"), F.lit(":"), own("turn")).cast("binary")) % 20
    out = rows.select("conv_id", "turn", own("role").alias("role"), own("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def audited(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 for each conv_id of conversations,
    by its rows (conv_id, turn, role, text); further columns are not read.

    A conversation without rows gives zeros, an empty audit and the hash of an empty text. Rows are taken by turn, nulls
    first, then by role and by the hash of the text; rows that are there twice are duplicates. A null role or text is one
    space; a null conv_id is a conversation of its own, and ids may be of any type that casts to a string. A role that does
    not begin with s, u or a (an empty one too) can be reroled or deleted, not kept. Texts and conversations of any length are taken
    whole. Empty tables give no rows. gaps that no long can hold count as the greatest.
    """
    name = F.when(F.col("conv_id").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("conv_id").cast("string")))
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    found = repaired(rows.select(name.alias("c"), F.col("turn").cast("long").alias("turn"), own("role"), own("text")))
    every = conversations.select("conv_id").distinct().select("conv_id", name.alias("c"))
    none = {c: F.coalesce(F.col(c), F.lit({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}.get(c, 0))).alias(c) for c in _RESULT}
    return every.join(found.hint("merge"), "c", "left").select("conv_id", *(none[c].cast("string" if c in ("audit", "repaired_sha256") else "long").alias(c) for c in _RESULT))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return audited(damaged(rows), rows)


def _oracle() -> str:
    """The cheapest and least edits to each state, row by row: of two ways to a state, neither audit begins with the other."""
    candidate = lambda w, cost, letter, line="''": f"CASE WHEN {w} IS NOT NULL THEN {{'c': {w}.c + {cost}, 'a': {w}.a || '{letter}', 't': {w}.t || {line}}} END"
    best = lambda *x: f"list_min(list_filter([{', '.join(x)}], lambda z: z IS NOT NULL))"
    line = lambda role, text="''": f"chr(10) || {role} || ':' || {text}"
    deleted = lambda w: candidate(w, 2, "D")
    kept = lambda w, x: f"CASE WHEN ok AND initial = '{x}' THEN {candidate(w, 'extra', 'K', line('role', 'text'))} END"
    given = lambda w, role: f"CASE WHEN ok THEN {candidate(w, '(extra + 1)', 'R', line(repr(role), 'text'))} END"
    put = lambda w, role: candidate(w, 5, "I", line(repr(role)))
    x0, x1 = best(deleted("w0")), best(deleted("w1"), kept("w0", "s"))
    x2 = best(deleted("w2"), *(kept(w, "u") for w in ("w0", "w1", "w3")), *(given(w, "user") for w in ("w0", "w1", "w3")))
    x3 = best(deleted("w3"), kept("w2", "a"), given("w2", "assistant"))
    closed = f"SELECT *, {best('y3', put('w2', 'assistant'))} AS w3 FROM (SELECT *, {best('y2', put('w0', 'user'), put('w1', 'user'), put('y3', 'user'))} AS w2 FROM "
    return rf"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) AS t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))), '..'), lambda b: CAST('0x' || b AS BIGINT))),
    lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS INTEGER) + 1])), 4294967295) % 20 AS d FROM conversations, crc),
e AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM k WHERE d <> 0),
n AS (SELECT *, left(role, 1) AS initial, regexp_replace(text, '[ \t\n\x0B\f\r]+$', '') AS body,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM e),
r AS (SELECT *, body = '' AS blank, body <> '' AND again AS duplicate, body <> '' AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS truncated, body <> '' AND NOT again AS ok,
  CASE WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS extra, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS former FROM n),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
  count(*) FILTER (former IS NOT NULL AND former || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last FROM r GROUP BY conv_id),
z AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS w0 FROM s),
z1 AS (SELECT conv_id, i, w0, CASE WHEN false THEN w0 END AS w1, CASE WHEN false THEN w0 END AS y2, CASE WHEN false THEN w0 END AS y3 FROM z),
z2 AS ({closed}z1)),
p(conv_id, i, w0, w1, w2, w3) AS (SELECT conv_id, i, w0, w1, w2, w3 FROM z2
  UNION ALL SELECT conv_id, i, w0, w1, w2, w3 FROM ({closed}(SELECT r.conv_id, r.i, {x0} AS w0, {x1} AS w1, {x2} AS y2, {x3} AS y3 FROM p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i + 1)))),
f AS (SELECT s.*, {best('w0', 'w3')} AS w FROM s JOIN p ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = s.last)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(w.c, 0) AS BIGINT) AS cost, coalesce(w.a, '') AS audit, sha256(coalesce(substr(w.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE = _oracle()
