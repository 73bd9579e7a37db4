"""What rows meet on their way through a forest: explanation ranges, final decisions, heights and texts of the trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.forest import children, masked
from verdigris.operators.nearest import nearest
from verdigris.sources.shared import cut


def visits(routed: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """key, tree, node, level, side, cols: the splits on the way to each row's leaf, from the heap numbers alone."""
    depth = nodes.where("is_leaf").select("tree", "node", F.col("level").cast("int").alias("_depth"))
    way = routed.join(depth, ["tree", "node"]).where("_depth > 0").withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_depth") - 1)))
    way = way.select(key, "tree", "level", F.expr("shiftright(node, _depth - level)").alias("node"), F.expr("CAST(shiftright(node, _depth - level - 1) % 2 AS INT)").alias("side"))
    return way.join(nodes.where("NOT is_leaf").select("tree", "node", "cols"), ["tree", "node"])


def explanation_ranges(rows: DataFrame, df: DataFrame, nodes: DataFrame, members: DataFrame, routed: DataFrame, key: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """key, tree, col, op, v, bound, extended: for each numeric column of the splits that a row visits, its value and
    that of the nearest member of the side it goes to (ties to the least key): v <= bound where v is less, else v >= bound.

    Over the levels a '<=' keeps the greatest bound and a '>=' the least; extended is how often it moved. Categorical
    columns count in the distance; encode them to have ranges of their own. Only members of the winning sides are joined.
    """
    child, span = (cut(x) for x in children(members, df, nodes, key, numeric, categorical))
    way = cut(visits(routed, nodes, key))
    asked = masked(way.join(rows.select(key, *numeric, *categorical), key), ["tree", "node", "side", key], numeric, categorical)
    found = nearest(child, asked, ["tree", "node", "side"], key, numeric, categorical, span, digits=9)
    near = way.join(found.select(key, "tree", "node", F.col("nearest").alias("m")), [key, "tree", "node"])
    # values of the row and of its one member, fetched after the pairs are gone
    own, other = rows.select(key, *numeric), df.select(F.col(key).alias("m"), *(F.col(x).alias(f"m_{x}") for x in numeric))
    pairs = F.array(*(F.struct(F.lit(x).alias("col"), F.col(x).cast("double").alias("v"), F.col(f"m_{x}").cast("double").alias("b")) for x in numeric))
    steps = near.select(key, "tree", "level", "cols", "m").join(own, key).join(other, "m").select(key, "tree", "level", "cols", F.explode(pairs).alias("p")).where(F.array_contains("cols", F.col("p.col")))
    less = F.col("p.v") < F.col("p.b")
    steps = steps.select(key, "tree", "level", "p.col", "p.v", F.when(less, "<=").otherwise(">=").alias("op"), F.col("p.b").alias("bound"))
    way = Window.partitionBy(key, "tree", "col", "op").orderBy("level").rowsBetween(Window.unboundedPreceding, -1)  # a row for each level
    up = F.col("op") == "<="
    moved = F.when(up, F.col("bound") > F.max("bound").over(way)).otherwise(F.col("bound") < F.min("bound").over(way))
    steps = steps.withColumn("_moved", F.coalesce(moved, F.lit(False)).cast("long"))
    return steps.groupBy(key, "tree", "col", "op").agg(F.first("v").alias("v"), F.max("bound").alias("_hi"), F.min("bound").alias("_lo"), F.sum("_moved").alias("extended")).select(key, "tree", "col", "op", "v", F.when(up, F.col("_hi")).otherwise(F.col("_lo")).alias("bound"), "extended")


def heights(nodes: DataFrame) -> DataFrame:
    """tree, node, depth, cols, is_leaf: the levels of the subtree below each node, itself included. Every node counts
    for each of its ancestors; there are as many as it has levels."""
    up = nodes.select("tree", F.col("level").cast("int").alias("level"), "node").withColumn("h", F.explode(F.sequence(F.lit(0), F.col("level"))))
    deep = up.groupBy("tree", F.expr("shiftright(node, h)").alias("node")).agg((F.max("h") + 1).alias("depth"))
    return nodes.select("tree", "node", "cols", "is_leaf").join(deep, ["tree", "node"])


def text_lines(nodes: DataFrame) -> DataFrame:
    """tree, place, line: the trees as text, a line for each node, parents before children and left before right."""
    shift = F.expr("rpad(substring(bin(node), 2), 64, ' ')")
    place = F.row_number().over(Window.partitionBy("tree").orderBy(shift))  # the nodes of one tree
    what = F.when(F.col("is_leaf"), F.lit("leaf")).otherwise(F.array_join("cols", ", "))
    return nodes.select("tree", place.alias("place"), F.concat(F.expr("repeat('  ', CAST(level AS INT))"), F.col("node").cast("string"), F.lit(" "), what).alias("line"))
