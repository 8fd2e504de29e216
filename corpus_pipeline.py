"""The corpus pipeline: documents in, token ids of the mixed corpus out, one operator a stage.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents. Empty tables pass through;
null texts count as empty; columns beyond those of documents are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourcast.llm import bpe, common, jaccard_join, mixing, secret_scan, site_quality
from hourcast.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    weights = site_quality.learn(docs, common.load(spark, sf_dir, "labels"))
    scored = site_quality.scored(docs, weights, host="source", path="lang", carry=docs.columns)
    return scored.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: of the class with the smallest id, ids before none, its
    smallest row. Different documents under one id are different rows. Texts without words are no
    duplicates of others; of those, equal (id, text) count once where there is an id."""
    common.small_batches(spark)
    groups = jaccard_join.join_documents(docs, size=5, percent=75).where(F.col("class_key").isNotNull())
    classes = groups.groupBy("component_key", "class_key").agg(F.min("doc_id").alias("id"))
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "class_key")).alias("b")
    first = classes.groupBy("component_key").agg(best).select(F.col("b.class_key").alias("_key"))
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text").alias("text"), whole.alias("row"))
    key = jaccard_join.keyed(F.col("text")).alias("_key")
    one = docs.select(key, order.alias("_o")).where(F.col("_key").isNotNull()).groupBy("_key").agg(F.min("_o").alias("_o")).join(first, "_key", "left_semi")
    named, none = (docs.where(w).select(key, order.alias("_o")).where(F.col("_key").isNull()) for w in ("doc_id is not null", "doc_id is null"))
    named = named.groupBy("_o.id", "_o.text").agg(F.min("_o").alias("_o"))
    out = one.select("_o").unionByName(named.select("_o")).unionByName(none.select("_o"))
    return out.select("_o.row.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked in its text."""
    common.small_batches(spark)
    masked = docs.withColumn("text", secret_scan.redactor(secret_scan.learn(docs))(F.col("text")))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it."""
    common.small_batches(spark)
    return mixing.copies_of(docs, cycle=(1, 2, 3), cap=3.0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids) of every document of the mix."""
    common.small_batches(spark)
    ids = bpe.encode_documents(docs.select("doc_id", "text"), tokenizer_path())
    return ids.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("tokens", tokens)]

#: The learned stages cannot be said in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
