"""Exact removal of repeated 100-byte passages across all documents.

Every 100-byte string has an anchor: of its 32-byte substrings the one with the least hash (the last of equals).
Equal strings have equal anchors at equal offsets, so each string is compared only within its anchor's group, and a
text has about one anchor in 35 bytes. Neighbouring strings with one anchor form a run; its context is all bytes
that they cover. Anchors and contexts, or anchors and strings, are compared by one 64-bit hash of each, of independent families.
1. Runs with the same anchor and context are equal in all their strings: all but the first in (doc_id, start) repeat.
2. Where an anchor has several contexts, the first run of each is resolved string by string: the contexts of one
   anchor meet in one task, unless they are more than GROUP; those are dealt out by string.
3. The bytes under repeated strings are removed.

Column-wise construction of the collection's suffix order (one symbol of each document a round) is in colbwt.py; it
needs as many rounds over the collection's files as the longest document has bytes, see the README.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pyspark.sql.types import IntegralType

from .common import chunks, discard, partitions, text_bytes, written
from .textkit import eights, mix, rolling, span_hash

LENGTH = 100
ANCHOR = 32
#: Contexts of one anchor that are resolved in one task at most (each has under 200 bytes).
GROUP = 20_000
_LOW = (1 << 31) - 1  # places in a text: Spark's texts are shorter
_NULL = -(1 << 63)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1]) if len(ends) else np.zeros(0, np.int64)


def anchored(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text, start, strings, offset, anchor, context) of each run; start: of the first string in its text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    long = np.flatnonzero(sizes >= LENGTH)
    if not len(long):
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    n = len(buf) - ANCHOR + 1
    key = rolling(buf, ANCHOR) * np.uint64(0xD6E8FEB86659FD93)
    key ^= key >> np.uint64(32)
    low = np.uint64(_LOW)
    m = (key & ~low) | (low - (np.arange(n, dtype=np.uint64) & low))
    span = 1
    while 2 * span <= LENGTH - ANCHOR + 1:
        m = np.minimum(m[:-span], m[span:])
        span *= 2
    if rest := LENGTH - ANCHOR + 1 - span:
        m = np.minimum(m[:-rest], m[rest:])
    at = _ranges(base[long], sizes[long] - LENGTH + 1)  # strings within one text
    doc = np.repeat(long, sizes[long] - LENGTH + 1)
    anchor = (low - (m[at] & low)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    start, anchor, doc = at[first], anchor[first], doc[first]
    offset = anchor - start
    view = eights(buf)
    context = mix(span_hash(buf, start, start + count + LENGTH - 1, 1, view) + mix((offset * 256 + count).astype(np.uint64)))
    return doc, start - base[doc], count, offset, span_hash(buf, anchor, anchor + ANCHOR, 0, view).view(np.int64), context.view(np.int64)


def _runs(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, c, doc, p), p = start << 16 | n << 8 | off. A run that repeats within the batch is known to repeat: it
    has ~p and leaves the key's group."""
    for b in batches:
        ids, texts = b["doc"].to_numpy(np.int64), b["_t"].to_list()
        parts = []
        for i, j in chunks(texts):
            d, *rest = anchored(texts[i:j])
            parts.append((ids[i + d], *rest))
        if not parts:
            continue
        doc, start, n, off, a, c = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((start, doc, c, a))
        doc, start, n, off, a, c = (x[order] for x in (doc, start, n, off, a, c))
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (c[1:] != c[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))
        keep = new | (doc != doc[first]) | (start != start[first])  # repeated rows of a table are one document
        p = start << 16 | n << 8 | off
        key = np.where(new, a, mix(doc.view(np.uint64)).view(np.int64))
        yield pd.DataFrame({"key": key, "c": np.where(new, c, 0), "doc": doc, "p": np.where(new, p, ~p)})[keep]


def _grouped(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of _runs: repeated runs get off -1; first runs of the contexts of an anchor with several keep off.

    Of the group that a batch ends in, only its last context's first place and its first run, if that has not been
    given out, are carried on.
    """
    columns = ["doc", "start", "n", "off", "a"]
    last: tuple | None = None  # key, c, doc and start of the context's first run
    held: list | None = None
    for b in batches:
        known = b[b["p"] < 0]
        place = ~known["p"].to_numpy()
        out = [pd.DataFrame({"doc": known["doc"], "start": place >> 16, "n": place >> 8 & 255, "off": -1, "a": 0})]
        b = b[b["p"] >= 0]
        if len(b):
            key, c, doc, place = (b[x].to_numpy() for x in ("key", "c", "doc", "p"))
            start, n, off = place >> 16, place >> 8 & 255, place & 255
            new_key, new_c = np.ones(len(b), bool), np.ones(len(b), bool)
            new_key[1:] = key[1:] != key[:-1]
            new_c[1:] = new_key[1:] | (c[1:] != c[:-1])
            if last is not None and key[0] == last[0]:
                new_key[0] = False
                new_c[0] = c[0] != last[1]
            elif last is not None:
                held = None
            first = np.maximum.accumulate(np.where(new_c, np.arange(len(b)), -1))
            fd = np.where(first >= 0, doc[first], last[2] if last else 0)
            fs = np.where(first >= 0, start[first], last[3] if last else 0)
            again = ~new_c & ((doc != fd) | (start != fs))
            out.append(pd.DataFrame({"doc": doc[again], "start": start[again], "n": n[again], "off": -1, "a": 0}))
            # contexts of each key: with those before the batch, if it goes on
            reps = np.flatnonzero(new_c)
            group = np.cumsum(new_key)[reps]  # 0: the key of the batch before
            size = np.bincount(group, minlength=int(new_key.sum()) + 1)
            if size[0]:
                if held is not None:
                    out.append(pd.DataFrame([held], columns=columns))
                    held = None
                size[0] = 2
            many = reps[size[group] > 1]
            out.append(pd.DataFrame({"doc": doc[many], "start": start[many], "n": n[many], "off": off[many], "a": key[many]}))
            if new_key.any():
                i = int(np.flatnonzero(new_key)[-1])
                held = [int(x) for x in (doc[i], start[i], n[i], off[i], key[i])] if size[-1] == 1 else None
            last = (key[-1], c[-1], int(fd[-1]), int(fs[-1]))
        yield pd.concat([x for x in out if len(x)] or out[:1])[columns]


def _of_runs(batches: Iterable[pd.DataFrame]) -> Iterator[tuple]:
    """(doc, text, starts, counts, offsets, anchors) of (doc, text, runs) rows."""
    for b in batches:
        for doc, t, *lists in zip(b["doc"], b["_t"], b["start"], b["n"], b["off"], b["a"], strict=True):
            yield doc, t, *(np.asarray(x, np.int64) for x in lists)


def _contexts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (a, doc, p, bytes): the context of each run that is to be resolved."""
    for doc, t, starts, counts, offs, names in _of_runs(batches):
        raw = [t[s : s + n + LENGTH - 1] for s, n in zip(starts.tolist(), counts.tolist(), strict=True)]
        yield pd.DataFrame({"a": names, "doc": doc, "p": starts << 16 | counts << 8 | offs, "bytes": raw})


def _windows(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (a, w, doc, pos): a hash of each string of the runs that are to be resolved."""
    for doc, t, starts, counts, offs, names in _of_runs(batches):
        pos, inside = _ranges(starts, counts), _ranges(np.zeros(len(counts), np.int64), counts)
        w = _named(np.frombuffer(t, np.uint8), pos, np.repeat(offs, counts) - inside)
        yield pd.DataFrame({"a": np.repeat(names, counts), "w": w.view(np.int64), "doc": doc, "pos": pos})


def _named(buf: np.ndarray, pos: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """A hash of the strings at pos and of where their anchor lies in them."""
    return mix(span_hash(buf, pos, pos + LENGTH, 2) + mix(shift.astype(np.uint64)))


def _strings(a: np.ndarray, doc: np.ndarray, p: np.ndarray, raw: list[bytes]) -> pd.DataFrame:
    """(doc, start, n): runs of strings that an earlier row of the same anchor has, for rows in order of (a, doc, start)."""
    start, n, off = p >> 16, p >> 8 & 255, p & 255
    base = np.cumsum([0, *map(len, raw)])[:-1]
    inside = _ranges(np.zeros(len(n), np.int64), n)
    row = np.repeat(np.arange(len(n)), n)
    w = _named(np.frombuffer(b"".join(raw), np.uint8), base[row] + inside, off[row] - inside)
    order = np.lexsort((row, w, a[row]))
    again = np.zeros(len(row), bool)
    again[order[1:]] = (w[order][1:] == w[order][:-1]) & (a[row][order][1:] == a[row][order][:-1])
    at = np.flatnonzero(again)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (row[at][1:] != row[at][:-1])
    first = np.flatnonzero(new)
    return pd.DataFrame({"doc": doc[row[at[first]]], "start": (start[row] + inside)[at[first]], "n": np.diff(np.append(first, len(at)))})


def _resolved(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows of _contexts; the rows of a batch's last anchor (GROUP at most) wait for the next batch."""
    held: pd.DataFrame | None = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        a = b["a"].to_numpy()
        cut = int(np.searchsorted(a, a[-1])) if len(a) else 0
        held = b[cut:].reset_index(drop=True)
        if cut:
            yield _strings(a[:cut], b["doc"].to_numpy()[:cut], b["p"].to_numpy()[:cut], b["bytes"].to_list()[:cut])
    if held is not None and len(held):
        yield _strings(held["a"].to_numpy(), held["doc"].to_numpy(), held["p"].to_numpy(), held["bytes"].to_list())


def _cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for t, starts, counts in zip(b["_t"], b["start"], b["n"], strict=True):
            if starts is None or not len(starts):
                rows.append((len(t), 0, 0, hashlib.sha256(t).hexdigest()))
                continue
            edge = np.zeros(len(t) + 1, np.int64)
            np.add.at(edge, np.asarray(starts, np.int64), 1)
            np.add.at(edge, np.asarray(starts, np.int64) + np.asarray(counts, np.int64) + LENGTH - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
            rows.append((len(t), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
        yield pd.concat([b[["doc"]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256"])], axis=1)


def _numbered(docs: DataFrame, text: str, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(doc, _t) with doc a long in the order of the ids, null first; and (doc, id) where doc isn't the id itself: for
    ids that aren't whole numbers or that name several texts, which are documents in the order of their digests."""
    own = docs.select(F.col(key).alias("id"), text_bytes(text).alias("_t"))
    plain = isinstance(docs.schema[key].dataType, IntegralType)
    if plain:
        several = own.groupBy("id").agg(F.min(F.xxhash64("_t")).alias("a"), F.max(F.xxhash64("_t")).alias("b"))
        plain = several.where(f"a <> b OR CAST(id AS STRING) = '{_NULL}'").isEmpty()
    if plain:
        return own.select(F.coalesce(F.col("id").cast("long"), F.lit(_NULL)).alias("doc"), "_t"), None
    own = own.withColumn("digest", F.md5("_t"))
    names = own.select("id", "digest").distinct().repartitionByRange(partitions(docs.sparkSession), "id", "digest").sortWithinPartitions("id", "digest")
    names = written(names.select("id", "digest", F.monotonically_increasing_id().alias("doc")), "ids")
    cols = own.alias("o").join(names.alias("n"), F.col("o.id").eqNullSafe(F.col("n.id")) & (F.col("o.digest") == F.col("n.digest")))
    return cols.select("doc", "_t"), names


def _found(cols: DataFrame) -> DataFrame:
    """(doc, start, n, off, a) of runs: off -1 for those known to repeat, else to be resolved."""
    found = cols.mapInPandas(_runs, "key long, c long, doc long, p long")
    found = found.repartition(partitions(cols.sparkSession), "key").sortWithinPartitions("key", "c", "doc", "p")
    return written(found.mapInPandas(_grouped, "doc long, start int, n short, off short, a long"), "runs")


def _dealt_by_string(texts: DataFrame) -> DataFrame:
    """(doc, start, n) of repeated strings, each string a row: no group meets in one task but that of equal strings."""
    place = F.struct("doc", "pos")
    strings = texts.mapInPandas(_windows, "a long, w long, doc long, pos int")
    marked = strings.withColumn("first", F.min(place).over(Window.partitionBy("a", "w"))).where(F.col("first") != place).select("doc", "pos").distinct()
    before = Window.partitionBy("doc").orderBy("pos")
    runs = marked.withColumn("g", F.col("pos") - F.row_number().over(before)).groupBy("doc", "g")
    return runs.agg(F.min("pos").alias("start"), F.count("*").cast("int").alias("n")).select("doc", "start", "n")


def _repeats(cols: DataFrame) -> DataFrame:
    """(doc, start, n): runs of n 100-byte strings that also start earlier, by document; cols: (doc, _t)."""
    spark = cols.sparkSession
    runs = _found(cols)
    reps = runs.where("off >= 0").distinct()
    large = written(reps.groupBy("a").count().where(F.col("count") > GROUP).select("a"), "large_groups")

    def texts(of: DataFrame) -> DataFrame:
        lists = of.groupBy("doc").agg(F.collect_list(F.struct("start", "n", "off", "a")).alias("x")).select("doc", "x.start", "x.n", "x.off", "x.a")
        return cols.join(lists, "doc").dropDuplicates(["doc"])  # a row that is there twice gives its contexts once

    contexts = texts(reps.join(large, "a", "left_anti")).mapInPandas(_contexts, "a long, doc long, p long, bytes binary")
    contexts = contexts.repartition(partitions(spark), "a").sortWithinPartitions("a", "doc", "p")
    known = runs.where("off < 0").select("doc", "start", F.col("n").cast("int").alias("n"))
    out = known.unionAll(contexts.mapInPandas(_resolved, "doc long, start int, n int"))
    if not large.isEmpty():
        out = out.unionAll(_dealt_by_string(texts(reps.join(large, "a", "left_semi"))))
    out = written(out, "repeats")
    discard(runs, large)
    return out


def repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, start, n: runs of n 100-byte strings that also start earlier; a row for each run of a document."""
    cols, names = _numbered(docs, text, key)
    out = _repeats(cols)
    return _with_ids(out, names, docs.schema[key].dataType.simpleString())


def _with_ids(out: DataFrame, names: DataFrame | None, kind: str) -> DataFrame:
    rest = [c for c in out.columns if c != "doc"]
    if names is None:
        return out.select(F.when(F.col("doc") != _NULL, F.col("doc")).cast(kind).alias("doc_id"), *rest)
    return out.join(names, "doc", "left").select(F.col("id").alias("doc_id"), *rest)


def cleaned(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row.

    A null text is empty; texts under 100 bytes lose nothing, texts of any length are taken whole. doc_id names a
    document, of any type that has an order: repeated rows are one document and get equal results; several texts
    under one id are documents in the order of their md5. A null doc_id comes before all others. Empty tables give no rows; further columns are not read. Copies of a run within
    a batch are settled where they are read, so a group of copies reaches its anchor's task once for each batch.
    """
    cols, names = _numbered(docs, text, key)
    gone = _repeats(cols).groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("x")).select("doc", "x.start", "x.n")
    out = cols.join(gone, "doc", "left").mapInPandas(_cut, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return _with_ids(out, names, docs.schema[key].dataType.simpleString())


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Brute force: every 100-byte string, hex digits taking the place of bytes.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, i, md5(substr(x, 2 * i + 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d)),
a AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
b AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM a)),
c AS (SELECT doc_id, k, min(i) AS lo, max(i) + 100 AS hi FROM b GROUP BY doc_id, k),
e AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM c),
f AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(x, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS y FROM e JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(y, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN f USING (doc_id)
"""
