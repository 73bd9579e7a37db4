"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are short, documents long: containment |Q & X| / |Q|, not similarity, says whether X holds Q. The items are
partitioned by size (shingles) into geometric classes. An item of a class with at most u shingles is indexed by its
m = floor((1 - t) * u) + 1 least shingle hashes, a MinHash signature just long enough that a document with
containment t or more must hold one of them: it can miss m - 1 at most. So the search has no false negatives.
Each document probes with all its shingles; candidates are verified by exact shingle containment: the bytes of the
document's words are compared, hashes only propose. Each class has its own signature table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_in, chunks, exact, text_bytes
from .textkit import Words, runs, shingles, shingles_at

WIDTH = 5
THRESHOLD = 0.8
#: Items are held by the executors in blocks of at most so many bytes of text; each block is one pass over the documents.
BLOCK_BYTES = 32 << 20


class Table:
    """The signatures of the items of one size class: sorted keys, the items that have them, a filter before both."""

    def __init__(self, keys: list[np.ndarray], owners: list[int]) -> None:
        key, own = np.concatenate(keys), np.repeat(owners, [len(k) for k in keys])
        order = np.argsort(key, kind="stable")
        self.key, self.owner = key[order], own[order]
        bits = max(16, int(8 * len(key)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[(self.key >> self.shift).astype(np.int64)] = True

    def probe(self, h: np.ndarray, doc: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) of the texts that hold a signature of an item."""
        near = np.flatnonzero(self.seen[(h >> self.shift).astype(np.int64)])
        lo, hi = np.searchsorted(self.key, h[near], "left"), np.searchsorted(self.key, h[near], "right")
        n = hi - lo
        items = self.owner[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        return set(zip(np.repeat(doc[near], n).tolist(), items.tolist(), strict=True))


class Index:
    """Size classes and exact shingle sets of one block of items, for one shingle width."""

    def __init__(self, ids: list[int], hashes: list[np.ndarray], exact: list[frozenset[bytes]], threshold: float) -> None:
        self.ids, self.hashes, self.exact, self.threshold = ids, hashes, exact, threshold
        classes: dict[int, tuple[list, list]] = {}
        for i, s in enumerate(hashes):
            upper = 1 << (len(s) - 1).bit_length()  # the size class: (upper / 2, upper]
            m = min(len(s), int((1 - threshold) * upper + 1e-9) + 1)
            keys, owners = classes.setdefault(upper, ([], []))
            keys.append(s[:m])  # sorted: the least hashes
            owners.append(i)
        self.tables = {u: Table(*x) for u, x in classes.items()}

    def search(self, w: Words, width: int) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, shared shingles, item's shingles) of each pair at the threshold or above."""
        h, doc, at = shingles_at(w, width)
        if not len(h):
            return
        edge = runs(doc, len(w.count))
        pairs = set().union(*(t.probe(h, doc) for t in self.tables.values()))
        for d, i in sorted(pairs):
            own = slice(edge[d], edge[d + 1])
            hits = at[own][np.isin(h[own], self.hashes[i])]
            if len(hits) >= self.threshold * len(self.exact[i]) - 1e-9:
                shared = len({b" ".join(w.text(p + j) for j in range(width)) for p in hits.tolist()} & self.exact[i])
                if shared >= self.threshold * len(self.exact[i]) - 1e-9:
                    yield d, i, shared, len(self.exact[i])


def build(items: list[tuple[int, bytes]], threshold: float) -> dict[int, Index]:
    """An index for each shingle width: WIDTH, or all words of an item that has fewer."""
    out: dict[int, tuple[list, list, list]] = {}
    for k, t in items:
        words = t.lower().split()  # ASCII case and white space, as in Words
        if words:
            n = min(WIDTH, len(words))
            ids, hashes, exact = out.setdefault(n, ([], [], []))
            ids.append(k)
            hashes.append(np.unique(shingles(Words([t]), n, whole=False)[0]))
            exact.append(frozenset(b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)))
    return {n: Index(*x, threshold) for n, x in out.items()}


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    block, size = [], 0
    for r in items.toLocalIterator():
        if block and size + len(r["_t"]) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r["item_id"], bytes(r["_t"])))
        size += len(block[-1][1])
    if block:
        yield block


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, item_id, n_shared, n_item for each document that holds ``threshold`` or more of an item's 5-word shingles.

    Words are compared with A-Z lower-cased. An item with fewer than five words is one shingle of all its words and
    matches where these stand in a row; items without words match nothing. Null texts are empty; repeated rows are
    searched one by one; empty tables give no rows; further columns are not read. Nothing is shuffled: items come
    to the executors in blocks of BLOCK_BYTES, one pass over the documents for each block.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(key).alias("doc_id"), text_bytes(text).alias("_t"))
    cols, names = exact(own), exact(items.select("item_id"))
    schema = f"doc_id {cols.schema['doc_id'].dataType.simpleString()}, item_id {names.schema['item_id'].dataType.simpleString()}, n_shared long, n_item long"
    out = None
    for block in _blocks(exact(items.select("item_id", text_bytes("text").alias("_t")).dropDuplicates())):
        index = spark.sparkContext.broadcast(build(block, threshold))

        def search(batches: Iterable[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for b in batches:
                ids, texts, rows = b["doc_id"].to_list(), b["_t"].to_list(), []
                for i, j in chunks(texts):
                    w = Words(texts[i:j])
                    for n, x in index.value.items():
                        rows += [(ids[i + d], x.ids[q], s, m) for d, q, s, m in x.search(w, n)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "n_shared", "n_item"])

        found = cols.mapInPandas(search, schema)
        out = found if out is None else out.unionAll(found)
    return as_in(as_in(spark.createDataFrame([], schema) if out is None else out, own), items.select("item_id"))


def _test(index: Broadcast):
    """Whether a text holds an item of the index."""

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            texts, found = b.to_list(), np.zeros(len(b), bool)
            for i, j in chunks(texts):
                w = Words(texts[i:j])
                for n, x in index.value.items():
                    for d, *_ in x.search(w, n):
                        found[i + d] = True
            yield pd.Series(found)

    return holds


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows whose own text holds no item, with all their columns, which may be of any types and names.

    Each row is judged where it is read, by its text alone: rows that share an id, or have none, don't go with each other.
    Null and empty texts hold nothing and stay; repeated rows are judged alike. Nothing is joined or shuffled.
    """
    spark = docs.sparkSession
    for block in _blocks(exact(items.select("item_id", text_bytes("text").alias("_t")).dropDuplicates())):
        docs = docs.where(~_test(spark.sparkContext.broadcast(build(block, threshold)))(text_bytes(text)))
    return docs


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH split(kind, id, w) AS (
  SELECT 'd', doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') FROM documents
  UNION ALL
  SELECT 'q', item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') FROM benchmark),
s AS (SELECT DISTINCT kind, id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT kind, id, w, unnest(range(1, len(w) - 3)) AS i FROM split)),
n AS (SELECT id, count(*) AS n_item FROM s WHERE kind = 'q' GROUP BY id)
SELECT d.id AS doc_id, q.id AS item_id, count(*) AS n_shared, any_value(n.n_item) AS n_item
FROM s AS q JOIN s AS d ON q.g = d.g AND q.kind = 'q' AND d.kind = 'd' JOIN n ON n.id = q.id
GROUP BY d.id, q.id HAVING 10 * count(*) >= 8 * any_value(n.n_item)
"""
