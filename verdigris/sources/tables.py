"""Scans, sinks and the views that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
LABELS = [f"y{i}" for i in range(5)]
MASKED = [f"m{i}" for i in range(5)]
NUMERIC = ["x1", "x2", "x3"]
CATEGORICAL = ["c1"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header; types are inferred (one more pass) unless a schema is given."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_parts(df: DataFrame, path: str, *by: str) -> None:
    """Node snapshots: one folder for each value of the columns."""
    df.write.mode("errorifexists").partitionBy(*by).parquet(path)


def labelled_columns(df: DataFrame, labels: list[str]) -> DataFrame:
    """Features renamed col_0.., labels label_0..; TRUE and FALSE as 1 and 0, other strings stay."""
    def flag(c: str):
        return F.when(F.upper(F.col(c).cast("string")) == "TRUE", 1).when(F.upper(F.col(c).cast("string")) == "FALSE", 0).otherwise(F.expr(f"try_cast(`{c}` AS INT)"))

    features = [c for c in df.columns if c not in labels]
    return df.select(*(F.col(c).alias(f"col_{i}") for i, c in enumerate(features)), *(flag(c).alias(f"label_{i}") for i, c in enumerate(labels)))


def customer_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each customer: node, three numeric and one categorical feature, five labels, and the labels masked
    to -1 where the row counts as unlabelled (the fixture's rule)."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count("*").alias("n"),
        F.sum("o_totalprice").alias("tot"),
        *(F.sum(F.when(F.col("o_orderpriority") == p, 1).otherwise(0)).alias(f"p{i}") for i, p in enumerate(PRIORITIES)),
    )
    c = table(spark, sf_dir, "customer")
    sup = F.col("c_custkey") % 10 >= 7
    y = [F.when(F.coalesce(F.col(f"p{i}"), F.lit(0)) >= 3, 1).otherwise(0) for i in range(5)]
    return c.join(orders, c["c_custkey"] == orders["o_custkey"], "left").select(
        F.col("c_custkey").alias("row_id"),
        F.col("c_mktsegment").alias("node"),
        F.col("c_nationkey").cast("string").alias("c1"),
        F.col("c_acctbal").alias("x1"),
        F.coalesce("n", F.lit(0)).cast("double").alias("x2"),
        F.round(F.coalesce("tot", F.lit(0.0)), 2).alias("x3"),
        sup.alias("sup"),
        *(y[i].alias(LABELS[i]) for i in range(5)),
        *(F.when(sup, y[i]).otherwise(-1).alias(MASKED[i]) for i in range(5)),
    )


def docs_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their labels; -1 where there is none."""
    d, lab = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("row_id"), "n_chars", "lang", "source",
        F.coalesce("quality", F.lit(-1)).alias("label_0"), F.coalesce("toxic", F.lit(-1)).alias("label_1"),
    )


#: Rows whose labels and trees go to one task.
SCORED = 50_000


def scores(spark: SparkSession, sf_dir: str, trees: int = 0) -> DataFrame:
    """row_id, label, y, prob for each customer and label; with trees also tree, and leaf of each row in it. With trees, rows are dealt to
    tasks of about SCORED rows by row_id: a row of each label and tree follows, so what a task groups would grow with the table else."""
    wide = customer_ml(spark, sf_dir)
    if trees:
        tasks = -(-table(spark, sf_dir, "customer").count() // SCORED)
        if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
            wide = wide.select("row_id", *LABELS).repartition(tasks, "row_id")
    labels = F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(y).alias("y")) for i, y in enumerate(LABELS)))).alias("l")
    long = wide.select("row_id", labels).select("row_id", "l.label", "l.y")
    if not trees:
        return long.withColumn("prob", hashed("row_id", "label"))
    long = long.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    leaf = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("leaf"), "tree", "row_id").cast("binary")), 1, 4), 16, 10).cast("int") % 8
    return long.withColumn("leaf", leaf).withColumn("prob", hashed("row_id", "label", "tree"))


def hashed(*cols: str):
    """A number in [0, 1) from the columns, rounded to 6 digits; the same in any engine that has md5."""
    part = F.substring(F.md5(F.concat_ws("|", *cols).cast("binary")), 1, 8)
    return F.round(F.conv(part, 16, 10).cast("double") / F.lit(4294967296.0), 6)


#: The same views for the oracles.
VIEWS = """
ord AS (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS tot,
  sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS p0, sum(CASE WHEN o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS p1,
  sum(CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1 ELSE 0 END) AS p2, sum(CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1 ELSE 0 END) AS p3,
  sum(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END) AS p4 FROM orders GROUP BY o_custkey),
cm0 AS (SELECT c_custkey AS row_id, c_mktsegment AS node, CAST(c_nationkey AS VARCHAR) AS c1, c_acctbal AS x1,
  CAST(coalesce(n, 0) AS DOUBLE) AS x2, round(coalesce(tot, 0), 2) AS x3, c_custkey % 10 >= 7 AS sup,
  CASE WHEN coalesce(p0, 0) >= 3 THEN 1 ELSE 0 END AS y0, CASE WHEN coalesce(p1, 0) >= 3 THEN 1 ELSE 0 END AS y1,
  CASE WHEN coalesce(p2, 0) >= 3 THEN 1 ELSE 0 END AS y2, CASE WHEN coalesce(p3, 0) >= 3 THEN 1 ELSE 0 END AS y3,
  CASE WHEN coalesce(p4, 0) >= 3 THEN 1 ELSE 0 END AS y4
  FROM customer LEFT JOIN ord ON c_custkey = o_custkey),
cm AS (SELECT *, CASE WHEN sup THEN y0 ELSE -1 END AS m0, CASE WHEN sup THEN y1 ELSE -1 END AS m1, CASE WHEN sup THEN y2 ELSE -1 END AS m2,
  CASE WHEN sup THEN y3 ELSE -1 END AS m3, CASE WHEN sup THEN y4 ELSE -1 END AS m4 FROM cm0),
dm AS (SELECT doc_id AS row_id, n_chars, lang, source, coalesce(quality, -1) AS label_0, coalesce(toxic, -1) AS label_1 FROM documents LEFT JOIN labels USING (doc_id)),
yl AS (SELECT row_id, node, sup, unnest([0, 1, 2, 3, 4]) AS label, unnest([y0, y1, y2, y3, y4]) AS y, unnest([m0, m1, m2, m3, m4]) AS m FROM cm),
sc AS (SELECT row_id, label, y, round(CAST(('0x' || substr(md5(concat_ws('|', row_id, label)), 1, 8)) AS BIGINT) / 4294967296.0, 6) AS prob FROM yl),
tr AS (SELECT unnest([0, 1, 2]) AS tree),
act AS (SELECT row_id, label, y, tree, CAST(('0x' || substr(md5(concat_ws('|', 'leaf', tree, row_id)), 1, 4)) AS INTEGER) % 8 AS leaf,
  round(CAST(('0x' || substr(md5(concat_ws('|', row_id, label, tree)), 1, 8)) AS BIGINT) / 4294967296.0, 6) AS prob FROM yl, tr),
xl AS (SELECT row_id, node, sup, unnest(['x1', 'x2', 'x3']) AS col, unnest([x1, x2, x3]) AS v FROM cm)
"""
