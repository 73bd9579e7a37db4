"""A corpus pipeline of five stages over documents: toxicity, near duplicates, decontamination, personal data, BPE.

Each stage is (name, function of (spark, docs, sf_dir)); a stage's rows are written as Parquet and read again as the
next one's docs. All stages but the last return the columns of documents. In all of them a null or empty text holds
nothing (not toxic, no copy, no leak, nothing to redact, no ids), a row's doc_id may be null, texts are taken whole, an
empty table gives an empty table, and columns beside doc_id and text may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from verdigris.llm import bpe, decontaminate, ngram_join, pii, toxicity
from verdigris.llm.common import discard, text_bytes, written

#: Near copies: five words, 80 of 100 shingles in common.
NEAR = ngram_join.Rule(width=5, percent=80)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; fitted on the labelled ones among docs. Repeated rows score alike."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.kept(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: the one with the least doc_id, of several texts under that id the
    one with the least md5, once where the row is repeated. Rows that share an id and not a text are different
    documents. Rows without doc_id or without words stay."""
    found = written(ngram_join.grouped(docs, rule=NEAR).where("group IS NOT NULL"), "near_copies")
    heads = found.where("doc_id = component_id").groupBy("group").agg(F.min("digest").alias("head"))
    gone = found.join(heads, "group").where("doc_id <> component_id OR digest <> head").select("doc_id", "digest", F.lit(True).alias("gone"))
    twice = found.groupBy("doc_id", "digest").count().where("count > 1").select("doc_id", "digest", F.lit(False).alias("gone"))
    marks = written(gone.unionAll(twice).groupBy("doc_id", "digest").agg(F.max("gone").alias("_gone")).select(F.col("doc_id").alias("_of"), F.col("digest").alias("_text"), "_gone"), "marks")
    discard(found)
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    # columns of any type have an order as JSON
    rest = F.to_json(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != "text"))).alias("_rest")
    rows = docs.select(own, rest, F.col("doc_id").alias("_id"), F.md5(text_bytes()).alias("_digest"))
    # the marks grow with the documents: the same join at every size, never a broadcast
    kept = rows.join(marks.hint("merge"), (F.col("_id") == F.col("_of")) & (F.col("_digest") == F.col("_text")), "left").where("_gone IS NULL OR NOT _gone")
    # of rows that are there twice the least; they are reduced where they are, in the order of the join
    once = kept.where("NOT _gone").groupBy("_id", "_digest").agg(F.min_by("_row", "_rest").alias("_row")).select("_row")
    out = kept.where("_gone IS NULL").select("_row").unionAll(once).select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
    out._holds = [marks]
    return out


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each judged by its own text."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text. A null text stays null."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's ids and of the bytes that they decode to."""
    import public_tokenizers as P

    return bpe.digests(docs, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("personal data", redact),
    ("bpe", encode),
]

#: Learned scores, components and encodings have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            after = written(out, name.replace(" ", "_"))
            discard(docs, *getattr(out, "_holds", []))  # what the stage has read
            out = after
        docs = out
    return docs
