"""URL filters by a sort-merge range join over reversed-host keys.

A host's key is its labels in reverse, each followed by a dot (``com.example.www.``). A rule's host covers the
interval of keys that begin with its own key, and such intervals nest or are disjoint. The urls are sorted by key
over the cluster; each partition is swept once, together with the rules in key order: a stack holds the rules whose
intervals contain the current key, the innermost on top, and the first from the top whose path is a prefix wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_in, ascii_lower, exact, partitions

#: Rules that one sweep takes at most; more are swept in blocks of this size, the longest match carried along.
RULES_PER_SWEEP = 200_000
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def key_of(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "." if host else ""


def sweep(batches: Iterable[pd.DataFrame], rules: list[tuple[str, str, str, str]]) -> Iterator[pd.DataFrame]:
    """rules: (host key, path, rule, verdict), sorted; batches: sorted by host key.

    The stack and the place in the rules live on from batch to batch.
    """
    stack: list[tuple[str, list[tuple[str, str, str]]]] = []
    at, last, table = 0, None, []
    for b in batches:
        rule, verdict = b["rule"].to_numpy(object, copy=True), b["verdict"].to_numpy(object, copy=True)
        rank = b["rank"].to_numpy(object, copy=True)
        for i, (key, path) in enumerate(zip(b["key"], b["path"], strict=True)):
            if key != last:
                last = key
                while at < len(rules) and rules[at][0] <= key:
                    host, p, name, said = rules[at]
                    while stack and not host.startswith(stack[-1][0]):
                        stack.pop()
                    if stack and stack[-1][0] == host:
                        stack[-1][1].append((p, name, said))
                    else:
                        stack.append((host, [(p, name, said)]))
                    at += 1
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                # innermost host first, then the longest path
                table = [(f"{len(h):09d}.{len(p):09d}", p, n, s) for h, own in reversed(stack) for p, n, s in reversed(own)]
            for long, p, name, said in table:
                if path.startswith(p):
                    if long > rank[i]:
                        rule[i], verdict[i], rank[i] = name, said, long
                    break
        yield b.assign(rule=rule, verdict=verdict, rank=rank)


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages. rules: (host, path, verdict).

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest host wins, then
    the longest path, then, among the same rules given twice, the first. A url that no rule fits gets a null rule and
    the default verdict. Null urls have empty host and path; ids may be null or of any type; repeated rows are judged
    one by one; urls of any length are judged whole; an empty table gives no rows; further columns are not read. Only
    page_id, host, path and the key are shuffled; sorting by (key, path, page_id) ranges splits even one hot host.
    """
    spark = pages.sparkSession
    table = sorted({(key_of(h), p, h + p): v for h, p, v in reversed(rules)}.items())
    table = [(*k, v) for k, v in table]
    cols = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    cols = cols.select("page_id", "host", "path", host_key(F.col("host")).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"), F.lit("").alias("rank"))
    own, cols = cols, cols.repartitionByRange(partitions(spark), "key", "path", "page_id").sortWithinPartitions("key")
    cols = exact(cols)  # whole ids beside nulls
    for i in range(0, len(table), RULES_PER_SWEEP):
        cols = cols.mapInPandas(partial(sweep, rules=table[i : i + RULES_PER_SWEEP]), cols.schema)
    return as_in(cols, own).select("page_id", "host", "path", "rule", "verdict")


#: The rules that the query judges by.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


ORACLE = r"""
WITH u AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, host, path, arg_max(h || p, length(h) * 65536 + length(p)) AS rule, arg_max(v, length(h) * 65536 + length(p)) AS verdict
  FROM u JOIN r ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p) GROUP BY ALL)
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM u LEFT JOIN (SELECT DISTINCT * FROM m) m ON u.page_id IS NOT DISTINCT FROM m.page_id AND u.host = m.host AND u.path = m.path
"""
