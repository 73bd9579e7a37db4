"""Fit and predict from end to end: forest, completed labels, a forest for each leaf; folds, parameter sets and reports on top.

Folds are more trees of the same plans: a tree's bag is drawn from the rows outside its fold, all trees grow level by level together,
and a held-out row walks only the trees of its fold. Parameter sets differ in depth or draws and are grown one after the other.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators import forest as T
from verdigris.operators import leaf_forests as LF
from verdigris.operators import leaves as L
from verdigris.operators import metrics, paths, sampling
from verdigris.sources.shared import cut

LEAF = ["tree", "node"]


@dataclass
class Forest:
    """A semi-supervised multi-label forest over a table of numbers and categories; labels are 0, 1, or -1 where a row has none.

    numeric, categorical: the columns that trees split on; leaves predict from the numeric ones (encode categories to
    have them there too). reps, width: repetitions and columns of the label completion in a leaf.
    """

    key: str
    numeric: list[str]
    categorical: list[str]
    labels: list[str]
    config: T.Config = field(default_factory=T.Config)
    reps: int = 3
    width: int = 2
    leaf_trees: int = 12
    leaf_depth: int = 4
    fitted: dict[str, Any] = field(default_factory=dict, repr=False, compare=False)

    def get_params(self) -> dict[str, Any]:
        """All parameters by name, those of the config among them."""
        own = {k: v for k, v in self.__dict__.items() if k not in ("fitted", "config")}
        return {**own, **asdict(self.config)}

    def set_params(self, **params: Any) -> "Forest":
        """The same forest with other parameters, not fitted; an unknown name is an error."""
        inner = {k: v for k, v in params.items() if k in T.Config.__dataclass_fields__}
        outer = {k: v for k, v in params.items() if k not in inner}
        if unknown := set(outer) - set(self.get_params()):
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        return replace(self, config=replace(self.config, **inner), fitted={}, **outer)

    def fit(self, df: DataFrame, bags: DataFrame | None = None, rows: int | None = None) -> "Forest":
        """Grows the trees on df and trains their leaves. bags (tree, node 1, key): given members of the trees, of which each
        has about ``rows`` rows to draw from."""
        cols = [*self.numeric, *self.categorical]
        df = cut(df.select(self.key, *cols, *self.labels))
        nodes, members = T.grow(df, self.key, self.numeric, self.categorical, self.labels, self.config, bags, rows)
        leaf = nodes.where("is_leaf").select(*LEAF).join(members.select(*LEAF, self.key), LEAF).join(df, self.key)
        # a row is in many trees; in a leaf it has a name of its own
        named = leaf.withColumn("_name", F.concat_ws("_", "tree", self.key))
        done = L.completed_labels(named, LEAF, "_name", self.numeric, self.categorical, self.labels, self.reps, min(self.width, len(cols)))
        train = cut(done.join(named.select("_name", self.key, *self.numeric), "_name").select(*LEAF, self.key, *self.numeric, *self.labels))
        self.fitted = {"df": df, "nodes": nodes, "members": members, "train": train}
        return self

    def leaves(self) -> dict[str, DataFrame]:
        """The leaves' forests, trained when they are first asked for: rules and explanations don't need them."""
        if "leaves" not in self.fitted:
            self.fitted["leaves"] = LF.fit(self.fitted["train"], LEAF, self.key, self.numeric, self.labels, self.leaf_trees, self.leaf_depth)
        return self.fitted["leaves"]

    def routed(self, rows: DataFrame, trees: DataFrame | None = None) -> DataFrame:
        """key, tree, node: the leaf of each row in each tree, or in those that trees (key, tree) names for it."""
        f = self.fitted
        return T.route(rows, f["df"], f["nodes"], f["members"], self.key, self.numeric, self.categorical, trees)

    def by_tree(self, rows: DataFrame, trees: DataFrame | None = None) -> DataFrame:
        """tree, node, key, label, prob, pred: what each row's leaf in each tree says of it."""
        at = self.routed(rows, trees).join(rows.select(self.key, *self.numeric), self.key)
        return LF.predictions(self.leaves(), at, LEAF, self.key, self.numeric)

    def predict_with_proba(self, rows: DataFrame, trees: DataFrame | None = None) -> DataFrame:
        """key, label, vote, prob, pred: 1 where half of the trees or more say so; prob is their mean."""
        return T.vote(self.by_tree(rows, trees), self.key)

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.predict_with_proba(rows).select(self.key, "label", "pred")

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        return self.predict_with_proba(rows).select(self.key, "label", "prob")

    def long_labels(self, rows: DataFrame) -> DataFrame:
        """key, label, y for the known labels of rows."""
        s = F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(c).alias("y")) for i, c in enumerate(self.labels)))).alias("s")
        return rows.select(self.key, s).select(self.key, "s.*").where("y >= 0")

    def activations(self, rows: DataFrame) -> DataFrame:
        """key, tree, node, label, pred, prob, real, tp, tn, fp, fn of rows whose labels are known."""
        a = self.by_tree(rows).join(self.long_labels(rows), [self.key, "label"])
        p, y = F.col("pred") == 1, F.col("y") == 1
        return a.select(self.key, *LEAF, "label", "pred", "prob", F.col("y").alias("real"), *(c.cast("int").alias(k) for k, c in (("tp", p & y), ("tn", ~p & ~y), ("fp", p & ~y), ("fn", ~p & y))))

    def rules(self) -> DataFrame:
        """The trees' rules as a table: id (tree_node), tree, node, parent, is_leaf, cols, path, n, n_sup, limits (the range of each
        number among the members, as col:lo:hi) and probs (the share of ones by label among a leaf's completed members)."""
        f = self.fitted
        s = T.structure(f["nodes"], f["members"], f["df"], self.key, F.col(self.labels[0]) >= 0)
        limit = lambda c: F.concat(F.lit(f"{c}:"), F.round(F.min(c).cast("double"), 6).cast("string"), F.lit(":"), F.round(F.max(c).cast("double"), 6).cast("string"))
        limits = f["members"].join(f["df"].select(self.key, *self.numeric), self.key).groupBy(*LEAF).agg(F.concat_ws(" ", *map(limit, self.numeric)).alias("limits"))
        probs = f["train"].groupBy(*LEAF).agg(F.concat_ws(" ", *(F.round(F.avg(c), 6).cast("string") for c in self.labels)).alias("probs"))
        return s.join(limits, LEAF, "left").join(probs, LEAF, "left").select(F.concat_ws("_", *LEAF).alias("id"), *LEAF, "parent", "is_leaf", F.array_join("cols", " ").alias("cols"), F.array_join("path", " ").alias("path"), "n", "n_sup", "limits", "probs")

    def explanations(self, rows: DataFrame) -> DataFrame:
        """The ranges that decide each row's way (see ``paths.explanation_ranges``)."""
        f = self.fitted
        return paths.explanation_ranges(rows, f["df"], f["nodes"], f["members"], cut(self.routed(rows)), self.key, self.numeric, self.categorical)

    def rule_quality(self, activations: DataFrame) -> DataFrame:
        """id, n, macro and micro precision, recall and f1 of each leaf, by its activations."""
        activations = cut(activations.select(self.key, *LEAF, "label", "tp", "tn", "fp", "fn"))  # three looks at what a walk and its forests say
        c = cut(activations.groupBy(*LEAF, "label").agg(*(F.sum(k).alias(k) for k in ("tp", "tn", "fp", "fn"))))
        macro = metrics.rates(c, [*LEAF, "label"]).groupBy(*LEAF).agg(*(F.avg(k).alias(f"macro_{k}") for k in ("precision", "recall", "f1")))
        pooled = metrics.rates(c.groupBy(*LEAF).agg(*(F.sum(k).alias(k) for k in ("tp", "tn", "fp", "fn"))), LEAF).select(*LEAF, *(F.col(k).alias(f"micro_{k}") for k in ("precision", "recall", "f1")))
        n = activations.groupBy(*LEAF).agg(F.count_distinct(self.key).alias("n"))
        return macro.join(pooled, LEAF).join(n, LEAF).withColumn("id", F.concat_ws("_", *LEAF))

    def tree_text(self) -> DataFrame:
        """tree, place, line: every tree as text, with the rows of each node."""
        f = self.fitted
        n = f["members"].groupBy(*LEAF).agg(F.count("*").alias("n"))
        lines = paths.text_lines(f["nodes"]).withColumn("node", F.split(F.trim("line"), " ")[0].cast("long"))
        return lines.join(n, LEAF).select("tree", "place", F.concat("line", F.lit(" ("), F.col("n").cast("string"), F.lit(" rows)")).alias("line"))

    def save(self, path: str) -> None:
        """Writes nodes, members (one folder for each tree: the snapshots of its nodes), rules and leaf models below path."""
        f = self.fitted
        tables = {"nodes": f["nodes"], "rules": self.rules(), **{f"leaf_{k}": v for k, v in self.leaves().items()}}
        for name, t in tables.items():
            t.write.mode("errorifexists").parquet(f"{path}/{name}")
        f["members"].write.mode("errorifexists").partitionBy("tree").parquet(f"{path}/members")


def report(scored: DataFrame) -> DataFrame:
    """name, label, value: the metrics of scored (row_id, label, y, prob, pred), by label where they are, and the confusion counts."""
    pred, every = F.col("pred"), F.lit(None).cast("int").alias("label")
    c = cut(metrics.confusion(scored, pred, ["label"]))
    single = {
        "macro_ap": metrics.average_precision(scored, ["label"]).agg(F.avg("ap").alias("v")), "micro_ap": metrics.average_precision(scored, []).select(F.col("ap").alias("v")),
        "label_ranking_precision": metrics.label_ranking_precision(scored).select(F.col("lrap").alias("v")), "subset_accuracy": metrics.subset_accuracy(scored, pred).select(F.col("accuracy").alias("v")),
        "hamming_loss": metrics.hamming_loss(scored, pred).select(F.col("loss").alias("v")), "rank_auc": metrics.rank_auc(scored).select(F.col("auc").alias("v")),
        "macro_precision": metrics.rates(c, ["label"]).agg(F.avg("precision").alias("v")), "macro_f1": metrics.rates(c, ["label"]).agg(F.avg("f1").alias("v")),
    }
    out = [t.select(F.lit(k).alias("name"), every, F.col("v").cast("double").alias("value")) for k, t in single.items()]
    stack = lambda t, cols: t.select(F.col("label").cast("int").alias("label"), F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).cast("double").alias("value")) for k in cols))).alias("s")).select("s.name", "label", "s.value")
    out += [stack(metrics.rates(c, ["label"]), ["precision", "recall", "f1", "support"]), stack(c, ["tn", "fn", "tp", "fp"])]
    return reduce(DataFrame.unionByName, out)


def precision_score(scored: DataFrame) -> float:
    """A scorer for searches: the mean precision over labels."""
    return float(metrics.rates(metrics.confusion(scored, F.col("pred"), ["label"]), ["label"]).agg(F.avg("precision")).first()[0])


def write_report(path: str, forest: Forest, scored: DataFrame) -> None:
    """The report of a run as JSON lines: its parameters (name, text), then metrics and confusion counts."""
    spark = scored.sparkSession
    params = spark.createDataFrame([(k, str(v)) for k, v in sorted(forest.get_params().items())], "name string, text string")
    params.select("name", F.lit(None).cast("int").alias("label"), F.lit(None).cast("double").alias("value"), "text").unionByName(report(scored), allowMissingColumns=True).write.mode("errorifexists").json(path)


def write_summary(path: str, runs: list[tuple[dict[str, Any], DataFrame]]) -> None:
    """The summary of several runs as CSV: a row for each, with the parameters that differ and the metrics of its report."""
    spark = runs[0][1].sparkSession
    names = [k for k in runs[0][0] if len({str(p.get(k)) for p, _ in runs}) > 1]
    rows = []
    for i, (p, r) in enumerate(runs):
        values = {x["name"]: x["value"] for x in r.where("label IS NULL").collect()}  # a row for each metric
        rows.append((i, *(str(p.get(k)) for k in names), *(values[k] for k in sorted(values))))
    schema = ["run long", *(f"`{k}` string" for k in names), *(f"{k} double" for k in sorted(values))]
    spark.createDataFrame(rows, ", ".join(schema)).write.mode("errorifexists").option("header", True).csv(path)


def cross_validated(df: DataFrame, folds: DataFrame, k: int, forest: Forest, truth: list[str]) -> DataFrame:
    """key, fold, label, y, vote, prob, pred: each row scored by the trees of its fold (key, fold 0 .. k - 1), grown without that
    fold's rows. truth: the columns of the true labels, in the order of the forest's."""
    c, key = forest.config, forest.key
    df = cut(df.join(folds.select(key, "fold"), key))
    n = df.count()
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("_fold"), F.lit(f * c.trees + t).alias("tree"), F.lit(f"{c.seed}{f}_{t}").alias("seed")) for f in range(k) for t in range(c.trees)))).alias("s")
    own = df.select(key, *forest.labels, "fold", each).where("fold <> s._fold").select(key, *forest.labels, "s.tree", "s.seed")
    bags = cut(sampling.inverse_frequency_bags(own, forest.labels, c.bag, key).select("tree", F.lit(1).cast("long").alias("node"), key))
    fitted = replace(forest, fitted={}).fit(df, bags, n * (k - 1) // k)
    trees = df.select(key, F.explode(F.sequence(F.col("fold") * c.trees, F.col("fold") * c.trees + c.trees - 1).cast("array<int>")).alias("tree"))
    scored = fitted.predict_with_proba(df, trees)
    y = F.explode(F.array(*(F.struct(F.lit(i).alias("label"), F.col(x).alias("y")) for i, x in enumerate(truth)))).alias("s")
    return scored.join(df.select(key, "fold", y).select(key, "fold", "s.*"), [key, "label"]).select(key, "fold", "label", "y", "vote", "prob", "pred")


def searched(df: DataFrame, folds: DataFrame, k: int, forest: Forest, truth: list[str], sets: list[dict[str, Any]], score=precision_score) -> list[tuple[dict[str, Any], float]]:
    """(parameters, mean score over folds) of each parameter set, best first, ties in the order given. score: of rows (row_id, label,
    y, prob, pred)."""
    out = []
    for params in sets:
        scored = cut(cross_validated(df, folds, k, forest.set_params(**params), truth).withColumnRenamed(forest.key, "row_id"))
        out.append((params, sum(score(scored.where(F.col("fold") == f)) for f in range(k)) / k))
    return sorted(out, key=lambda x: -x[1])
