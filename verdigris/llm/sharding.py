"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. A shard's draw is -ln(u) / weight, u from a hash of the row's key and the shard's
name; an inner node's draw is the least draw below it, which is distributed as a draw of the sum of the weights below it.
At each node the row goes to the child with the least draw, so children get rows in proportion to their weights, and
a change of weights moves rows only out of or into the subtrees whose weights changed: into a shard that grew, out of one
that shrank. Shard s always stands in rack s // per_rack, so the tree of n + 1 shards is that of n with one more leaf: the key
and the number of shards decide alone, and one more shard takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions

UNIT = float(1 << 52)


@dataclass(frozen=True)
class Node:
    name: str
    weight: float
    children: tuple["Node", ...] = ()
    shard: int | None = None

    def leaves(self) -> list["Node"]:
        return [self] if self.shard is not None else [x for c in self.children for x in c.leaves()]


def tree(n_shards: int, per_rack: int = 2, per_region: int = 4, weights: dict[int, float] | None = None) -> Node:
    """The tree of ``n_shards`` shards, of weight 1 where ``weights`` doesn't say else."""
    inner = lambda name, nodes: Node(name, sum(x.weight for x in nodes), tuple(nodes))
    regions = []
    for r in range(0, n_shards, per_region):
        racks = []
        for k in range(r, min(r + per_region, n_shards), per_rack):
            racks.append(inner(f"k{k}", [Node(f"s{s}", (weights or {}).get(s, 1.0), shard=s) for s in range(k, min(k + per_rack, r + per_region, n_shards))]))
        regions.append(inner(f"r{r}", racks))
    return inner("root", regions)


def hashed(*of: Column) -> Column:
    """52 bits of a hash, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *of).cast("binary")), 1, 13), 16, 10).cast("long")


def draw(key: Column, leaf: Node) -> Column:
    return -F.log((hashed(key, F.lit(leaf.name)).cast("double") + 1.0) / UNIT) / F.lit(leaf.weight)


def descend(key: Column, node: Node, draws: dict[str, Column] | None = None) -> Column:
    """The shard of a key, as one nested conditional expression. draws: those of the shards by name, where columns hold them."""
    of = draws or {x.name: draw(key, x) for x in node.leaves()}

    def least(n: Node) -> Column:
        each = [of[x.name] for x in n.leaves()]
        return each[0] if len(each) == 1 else F.least(*each)

    def go(n: Node) -> Column:
        if n.shard is not None:
            return F.lit(n.shard)
        if len(n.children) == 1:
            return go(n.children[0])
        out, best = None, least(n)
        for c in n.children[:-1]:
            here = least(c) == best
            out = F.when(here, go(c)) if out is None else out.when(here, go(c))
        return out.otherwise(go(n.children[-1]))

    return go(node)


def assign(docs: DataFrame, n_shards: int = 16, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law 'key', shard, slot, grown_shard for each row of docs.

    size: UTF-8 bytes plus 1. grown_shard: the shard once one more is added. slot: 0, 1, 2 ... within a shard, in the
    order of a hash of the row, whatever the cluster. The texts are not shuffled: a row is reduced to its size and
    checksum where it is read. Equal rows are counted first and get neighbouring slots; slots come from the counts of
    fine buckets (shard, range of the hash) and running sums within a bucket, so no task sorts a shard. A null key is a
    key of its own; a null text is empty, texts of any length are taken whole; an empty table gives an empty result;
    further columns are ignored.
    """
    spark = docs.sparkSession
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    larger, smaller = tree(n_shards + 1), tree(n_shards)
    rows = docs.select(F.col(key).alias("doc_id"), (F.octet_length(raw).cast("long") + 1).alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("_n"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.select("*", hashed(F.lit("slot"), name, F.col("size"), F.col("text_crc32")).alias("_h"), *(draw(name, x).alias(f"_{x.name}") for x in larger.leaves()))
    draws = {x.name: F.col(f"_{x.name}") for x in larger.leaves()}
    rows = rows.select("doc_id", "size", "text_crc32", "_n", "_h", descend(name, smaller, draws).alias("shard"), descend(name, larger, draws).alias("grown_shard"))
    fine = max(16, 4 * partitions(spark) // n_shards)
    rows = rows.withColumn("_b", F.floor(F.col("_h") / F.lit(UNIT) * fine).cast("int"))
    before = Window.partitionBy("shard").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    # at most n_shards * fine rows, whatever the input
    offsets = rows.groupBy("shard", "_b").agg(F.sum("_n").alias("c")).select("shard", "_b", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("shard", "_b").orderBy("_h", "doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("_r", F.coalesce(F.sum("_n").over(within), F.lit(0)))
    placed = numbered.join(F.broadcast(offsets), ["shard", "_b"]).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias("_i"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_o") + F.col("_r") + F.col("_i")).cast("long").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)


def _oracle(n: int = 16) -> str:
    """The flat rule that the descent amounts to: the shard with the least draw. crc32 byte by byte from its polynomial."""
    h = lambda *of: f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(of)})), 1, 13) AS BIGINT)"
    return f"""
WITH RECURSIVE bits(i, k, c) AS (SELECT i, 0, CAST(i AS BIGINT) FROM range(256) AS t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS name, hex(encode(coalesce(text, ''))) AS x FROM documents),
e AS (SELECT doc_id, name, CAST(length(x) // 2 + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(x, '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS INTEGER) + 1])), 4294967295) AS text_crc32 FROM d, crc),
f AS (SELECT *, {h("'slot'", 'name', 'size', 'text_crc32')} AS h, [-ln((CAST('0x' || substr(md5(name || '|s' || s), 1, 13) AS BIGINT) + 1.0) / 4503599627370496.0) for s in range({n + 1})] AS draws FROM e),
g AS (SELECT *, list_position(draws[1:{n}], list_min(draws[1:{n}])) - 1 AS shard, list_position(draws, list_min(draws)) - 1 AS grown_shard FROM f)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard FROM g
"""


ORACLE = _oracle()
