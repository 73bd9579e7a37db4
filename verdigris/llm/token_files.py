"""Token-id files compressed by Re-Pair grammars.

Documents are range-partitioned by id, encoded, and written in blocks of about BLOCK ids. In a block, pairs of
neighbouring ids are replaced by nonterminals, the most frequent first, until no pair occurs twice: pairs are counted
exactly, and in one round all those are replaced whose occurrences overlap no more frequent pair's, as their
replacements don't touch each other; a pair that a round leaves with one occurrence waits for the next count. A block stores
its rules, the expansion length of each rule and the compressed sequence. By the expansion lengths any range of ids, so any
document, is decoded by itself.

File format: a Parquet table of blocks (part, block, doc_ids, n_ids, lengths, rules, expansions, rounds, ids, width):
arrays of little-endian numbers; ids and rules have ``width`` bytes each (2, 3 or 4, as the block's symbols need), expansions
four; rounds: the first nonterminal of each round; blocks are in the order (part, block).
"""

from __future__ import annotations

import functools
import itertools
import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, exact, partitions, text_bytes, written
from .textkit import Words, eights, mix, numbered, span_hash
from .textkit import _unlike as unlike

BLOCK = 1 << 17
#: Bytes of texts that are encoded together.
TEXTS = 4 << 20
MEMORY = 1_000_000  # distinct units that a worker remembers
_BUCKETS = 16  # bits of the filter before pairs are counted
#: Signs that can stand between words that are encoded together: the first that the file has one id for.
_MARKS = "™®©€•…|~"
_TAIL = np.zeros(256, bool)
_TAIL[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "'"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[b for b in range(128) if chr(b).isalnum()]] = True


def gathered(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """flat[start:start + length] of all pairs, one after the other."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    return flat[np.repeat(start - (ends - length), length) + np.arange(ends[-1])]


def _numbered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As ``numbered``, by a table of the hashes in place of their order; all spans of a number are compared with its first."""
    hashes = span_hash(buf, start, end)
    at, seen = pd.factorize(hashes)
    first = np.empty(len(seen), np.int64)
    first[at[::-1]] = np.arange(len(at) - 1, -1, -1)
    return numbered(buf, start, end, hashes) if unlike(eights(buf), buf, start, end, first[at]) else (at, first)


class Encoder:
    """Ids of whole texts by a tokenizers file whose pre-tokenizer drops white space: distinct words are encoded once.

    A word's closing ASCII punctuation is encoded apart where letters or digits stand before it, as the
    pre-tokenizer cuts there too. A text with the string of an added token anywhere goes to the library as a whole, which
    gives that token's id.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content.lower().encode() for t in self.library.get_added_tokens_decoder().values()]
        single = [(c, ids[0]) for c in _MARKS if len(ids := self.ids_of(c)) == 1]
        self.sign, self.mark = single[0] if single else ("", None)
        merges = self.library.model.tokenize
        self.merges = merges if all([t.id for t in merges(w)] == self.ids_of(w.upper()) for w in ("a", "the", "of", "tokenizer", "zqxjkvb", "internationalisation")) else None
        self.clear()

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def ids_of(self, text: str) -> list[int]:
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids  # without places in the text

    def learn(self, keys: list[bytes]) -> None:
        words = [k.decode("utf-8", "replace") for k in keys]
        odd = [self.mark is None or self.sign in w or not w.isprintable() for w in words]
        # a word of ASCII letters is one piece, whose bytes stand for themselves: its merges are the model's alone
        plain = [i for i, w in enumerate(words) if w.isascii() and w.isalpha()] if self.merges else []
        known = set(plain)
        together, apart = [i for i, x in enumerate(odd) if not x and i not in known], [i for i, x in enumerate(odd) if x and i not in known]
        flat, length = [], []
        for k in range(0, len(plain), 4096):
            each = [[t.id for t in self.merges(words[i].lower())] for i in plain[k : k + 4096]]
            flat.append(np.fromiter(itertools.chain.from_iterable(each), np.uint32))
            length.append(np.fromiter(map(len, each), np.int64, len(each)))
        for k in range(0, len(together), 4096):
            some = together[k : k + 4096]
            ids = np.array(self.ids_of(f" {self.sign} ".join([words[i] for i in some])), np.uint32)
            at = np.flatnonzero(ids == self.mark)
            if len(at) != len(some) - 1:
                raise ValueError("a word holds the id of the sign between words")
            flat.append(ids[ids != self.mark])
            length.append(np.diff(at, prepend=-1, append=len(ids)) - 1)
        for i in apart:
            flat.append(np.array(self.ids_of(words[i]), np.uint32))
            length.append(np.array([len(flat[-1])]))
        flat, length = np.concatenate(flat), np.concatenate(length)
        n = len(self.known)
        while n + len(keys) > len(self.start):
            self.start, self.length = np.concatenate([self.start, self.start]), np.concatenate([self.length, self.length])
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        ends = self.used + np.cumsum(length)
        self.start[n : n + len(keys)], self.length[n : n + len(keys)] = ends - length, length
        self.used += len(flat)
        self.known.update(zip([keys[i] for i in plain + together + apart], range(n, n + len(keys)), strict=True))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the number of each text's."""
        if len(self.known) > MEMORY:
            self.clear()
        every = b"\n".join(texts).lower()
        if any(a in every for a in self.added):
            return self.with_added(texts)
        w = Words(texts)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cut = w.end.copy()
        moved = np.arange(len(cut))
        for _ in range(8):
            moved = moved[_TAIL[w.buf[cut[moved] - 1]] & (cut[moved] > w.start[moved])]
            cut[moved] -= 1
        latin = (w.buf[cut - 2] == 0xC3) & (w.buf[cut - 1] >= 0x80) & (w.buf[cut - 1] != 0x97) & (w.buf[cut - 1] != 0xB7)
        ok = (cut > w.start) & (cut < w.end) & (_ALNUM[w.buf[cut - 1]] | (latin & (cut - w.start >= 2)))
        cut = np.where(ok, cut, w.end)
        start, end = np.stack([w.start, cut], 1).ravel(), np.stack([cut, w.end], 1).ravel()
        own = np.repeat(w.doc, 2)
        full = end > start
        start, end, own = start[full], end[full], own[full]
        at, first = _numbered(w.buf, start, end)
        raw, known = w.buf.tobytes(), self.known
        keys = [raw[s:e] for s, e in zip(start[first].tolist(), end[first].tolist(), strict=True)]
        if new := [k for k in keys if k not in known]:
            self.learn(new)
        index = np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))[at]
        begins, lengths = self.start[index], self.length[index]
        return gathered(self.flat, begins, lengths), np.bincount(own, lengths, len(texts)).astype(np.int64)


    def with_added(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        whole = {i for i, t in enumerate(texts) if any(a in t.lower() for a in self.added)}
        flat, n = self([b"" if i in whole else t for i, t in enumerate(texts)])
        each = np.split(flat, np.cumsum(n)[:-1])
        for i in whole:
            each[i] = np.array(self.ids_of(texts[i].decode("utf-8", "replace")), np.uint32)
        return np.concatenate(each), np.array([len(x) for x in each], np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def replaceable(seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One round over the pairs that begin at ``at``: (places, rule of each, pairs by rule, places to look at again).

    Each pair has two places or more, no places overlap. A pair found once is not looked at again until a replacement
    beside it makes a new one.
    """
    none = np.zeros(0, np.int64)
    key = seq[at].astype(np.uint64) << np.uint64(32) | seq[at + 1]
    bucket = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BUCKETS)).astype(np.int64)
    again = np.bincount(bucket, minlength=1 << _BUCKETS)[bucket] > 1  # no other pair can occur twice
    at, key = at[again], key[again]
    held = none
    same = np.flatnonzero(seq[at] == seq[at + 1])
    if len(same):  # of a run of one id, every other place
        place = at[same]
        new = np.ones(len(place), bool)
        new[1:] = place[1:] != place[:-1] + 1
        order = np.arange(len(place))
        odd = same[(order - np.maximum.accumulate(np.where(new, order, 0))) % 2 == 1]
        held, at, key = at[odd], np.delete(at, odd), np.delete(key, odd)
    own, pairs = pd.factorize(key)
    n = np.bincount(own, minlength=len(pairs))
    many = n > 1
    if not many.any():
        return none, none, none, none
    rank = np.zeros(len(pairs), np.int64)  # 0: occurs once
    twice = np.flatnonzero(many)
    rank[twice[np.lexsort((mix(pairs[twice]), n[twice]))]] = np.arange(1, len(twice) + 1)
    weight = np.zeros(len(seq) + 1, np.int64)
    weight[at + 1] = rank[own]
    mine = weight[at + 1]
    top = (mine > weight[at]) & (mine > weight[np.minimum(at + 2, len(seq))])
    often = np.bincount(own[top], minlength=len(pairs)) > 1
    keep = top & often[own]
    return at[keep], (np.cumsum(often) - 1)[own[keep]], pairs[often], np.concatenate([held, at[many[own] & ~keep]])


def compress(ids: np.ndarray, ends: np.ndarray, vocabulary: int) -> dict:
    """A block: ids of documents that end at ``ends``."""
    seq, top = ids.astype(np.uint32), vocabulary
    rules, size, rounds = [np.zeros((0, 2), np.uint32)], np.ones(vocabulary, np.int64), []
    look = np.arange(max(len(seq) - 1, 0))
    while len(look) > 1:
        at, r, pairs, later = replaceable(seq, look)
        if not len(pairs):
            break
        left, right = (pairs >> np.uint64(32)).astype(np.uint32), pairs.astype(np.uint32)
        seq[at] = (r + top).astype(np.uint32)
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        live = np.zeros(len(seq), bool)
        live[later] = live[at] = True
        before = at - 1  # the symbol before: if that place is gone, the one that took it in
        live[np.where(keep[before], before, before - 1)[at > 0]] = True
        seq, live = seq[keep], live[keep]
        look = np.flatnonzero(live[:-1])
        rounds.append(top)
        rules.append(np.stack([left, right], 1))
        size = np.concatenate([size, size[left] + size[right]])
        top += len(pairs)
    width = 2 if top <= 1 << 16 else 3 if top <= 1 << 24 else 4
    return {"lengths": np.diff(ends, prepend=0).tolist(), "rules": _packed(np.concatenate(rules).ravel(), width), "expansions": size[vocabulary:].astype("<u4").tobytes(), "rounds": rounds or [vocabulary], "ids": _packed(seq, width), "width": width}


def _packed(x: np.ndarray, width: int) -> bytes:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def _unpacked(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(-1, width)
    return out.view("<u4").ravel()


def expand(seq: np.ndarray, rules: np.ndarray, rounds: list[int]) -> np.ndarray:
    """The ids that a compressed sequence stands for."""
    seq, base = seq.astype(np.uint32), rounds[0]
    for r in reversed(rounds):
        pair = seq >= r
        if not pair.any():
            continue
        out = np.empty(len(seq) + int(pair.sum()), np.uint32)
        at = np.arange(len(seq)) + np.cumsum(pair) - pair
        one = rules[seq[pair] - np.uint32(base)]
        out[at] = seq
        out[at[pair]], out[at[pair] + 1] = one[:, 0], one[:, 1]
        seq = out
    return seq


def expand_all(seq: np.ndarray, rules: np.ndarray, rounds: list[int]) -> np.ndarray:
    """As expand, for a whole block: each rule's ids are put together once, from those of its two sides."""
    base, n = rounds[0], rounds[0] + len(rules)
    flat, start, length = [np.arange(base, dtype=np.uint32)], np.arange(n), np.ones(n, np.int64)
    known = flat[0]
    for lo, hi in zip(rounds, [*rounds[1:], n], strict=True):
        own = rules[lo - base : hi - base]
        own_length = length[own].sum(1)
        length[lo:hi], start[lo:hi] = own_length, len(known) + np.cumsum(own_length) - own_length
        known = np.concatenate([known, gathered(known, start[own].ravel(), length[own].ravel())])
    return gathered(known, start[seq], length[seq])


def _arrays(row: pd.Series) -> tuple[np.ndarray, np.ndarray, list[int]]:
    return _unpacked(row["ids"], row["width"]), _unpacked(row["rules"], row["width"]).reshape(-1, 2), [int(x) for x in row["rounds"]]


def ids_between(row: pd.Series, i: int, j: int) -> np.ndarray:
    """Random access: the ids i .. j - 1 of a block. Expansion lengths say which symbols hold them; only these are decoded."""
    seq, rules, rounds = _arrays(row)
    size = np.concatenate([np.ones(rounds[0], np.int64), np.frombuffer(row["expansions"], "<u4").astype(np.int64)])[seq]
    end = np.cumsum(size)
    p, q = int(np.searchsorted(end, i, "right")), int(np.searchsorted(end, j, "left")) + 1
    out = expand(seq[p:q], rules, rounds)
    skip = i - int(end[p] - size[p]) if p < len(seq) else 0
    return out[skip : skip + j - i]


def document(row: pd.Series, n: int) -> np.ndarray:
    """The ids of document n of a block, nothing else decoded."""
    ends = np.cumsum(row["lengths"])
    return ids_between(row, int(ends[n - 1]) if n else 0, int(ends[n]))


def write(docs: DataFrame, path: str, end_id: int = 2, vocabulary: int = 49_408, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Write the token files of docs into the shared folder; the table of blocks, read back.

    Null texts are empty (one end id); texts of any length are taken whole. Repeated rows are written one by one, next
    to each other; null ids come first; empty tables give no blocks; further columns are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    cols = docs.select(F.col(key).alias("doc_id"), text_bytes(text).alias("_t"))
    cols = exact(cols.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "_t"))

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, encode, block = TaskContext.get().partitionId(), encoder(path), 0
        ids, lengths, names, held = [], [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal ids, lengths, names, held, block
            own = compress(np.concatenate(ids), np.cumsum(np.concatenate(lengths)), vocabulary)
            out = pd.DataFrame([{"part": part, "block": block, "doc_ids": names, "n_ids": held, **own}])
            ids, lengths, names, held, block = [], [], [], 0, block + 1
            return out

        for b in batches:
            all_ids, texts = b["doc_id"].tolist(), b["_t"].to_list()
            for i, j in chunks(texts, TEXTS):
                flat, n = encode(texts[i:j])
                # room for the end id after each document
                out = np.full(len(flat) + j - i, end_id, np.uint32)
                ends = np.cumsum(n + 1)
                keep = np.ones(len(out), bool)
                keep[ends - 1] = False
                out[keep] = flat
                first = 0
                while first < j - i:  # the documents up to the one that fills the block
                    begin = int(ends[first - 1]) if first else 0
                    last = min(int(np.searchsorted(ends, begin + BLOCK - held)) + 1, j - i)
                    ids.append(out[begin : ends[last - 1]])
                    lengths.append(n[first:last] + 1)
                    names += all_ids[i + first : i + last]
                    held += len(ids[-1])
                    first = last
                    if held >= BLOCK:
                        yield flush()
        if held:
            yield flush()

    names = cols.schema["doc_id"].dataType.simpleString()
    schema = f"part int, block int, doc_ids array<{names}>, n_ids long, lengths array<long>, rules binary, expansions binary, rounds array<int>, ids binary, width int"
    return written(cols.mapInPandas(work, schema).withColumn("doc_ids", F.col("doc_ids").cast(f"array<{kind}>")), "token_files")


def read(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files."""
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, row in b.iterrows():
                flat, n = expand_all(*_arrays(row)).astype("<u4"), np.asarray(row["lengths"], np.int64)
                if len(flat) != n.sum():
                    raise ValueError(f"block {row['block']} of part {row['part']} is damaged")
                ends = np.cumsum(n)
                raw, at = memoryview(flat.tobytes()), (ends - n).tolist()
                crc = [zlib.crc32(raw[4 * s : 4 * e]) for s, e in zip(at, ends.tolist(), strict=True)]
                yield pd.DataFrame({"part": row["part"], "block": row["block"], "doc_id": list(row["names"]), "at": at, "n_tokens": n, "ids_crc32": crc})

    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("p"))  # a row for each partition
    within = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("part", "block", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("o")).join(parts, "part")
    own = blocks.select("part", "block", F.col("doc_ids").cast("array<string>").alias("names"), "lengths", "rules", "rounds", "ids", "width")
    docs = own.mapInPandas(work, "part int, block int, doc_id string, at long, n_tokens long, ids_crc32 long")
    return docs.join(offsets, ["part", "block"]).select(F.col("doc_id").cast(kind).alias("doc_id"), (F.col("p") + F.col("o") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return read(write(spark.read.parquet(f"{sf_dir}/documents.parquet"), P.path("word_bpe_49k.json")))
