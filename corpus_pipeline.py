"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import decontaminate, language, quality, simhash
from docspark.llm.common import join_counted, materialise, shared_dir, sieve, sift, table
from docspark.llm.sentencepiece_codec import encode_documents


#: Clean documents score well above this, see the README.
QUALITY_FLOOR = 0.5
#: The least share of the predicted language in a document.
LANGUAGE_FLOOR = 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on their labels, scores at least ``QUALITY_FLOOR``."""
    network = quality.train(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.score(F.col("text"), network) >= QUALITY_FLOOR)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that makes up at least ``LANGUAGE_FLOOR`` of them; those without letters go."""
    model = language.train(docs)
    found = language.identify(F.col("text"), model)
    return docs.where((found["lang_pred"] != "und") & (found["score"] >= LANGUAGE_FLOOR))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates and all texts of similarity 0.8 (sets of five words): of each component the row with the
    smallest doc_id stays (null ids last, then the smaller hash of the text), of its copies one.

    A document is known by its id and its text: rows with one id (null included) and different texts are different documents,
    and only rows alike in both are copies of one.
    """
    row = [F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast(docs.schema["doc_id"].dataType)).alias("id"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_hash")]
    found = simhash.near_duplicates(docs.select(F.struct(*row).alias("row"), "text"), key="row", similarity=simhash.NEAR)
    judged = found.groupBy("row.no_id", "row.id", "row.text_hash").agg(F.count("*").alias("n"), F.bool_and(F.expr("row = component")).alias("kept"))
    judged = materialise(judged, "judged")
    named = docs.select(*row, F.struct("*").alias("document"))
    doubtful = sieve(judged.where("n > 1 or not kept"), "text_hash")  # any row outside it is kept and has no copies
    kept = sift(judged.where("kept").drop("kept"), "text_hash", doubtful)
    chosen = join_counted(sift(named, "text_hash", doubtful), kept, ["no_id", "id", "text_hash"], docs.count())
    copied = chosen.where("n > 1").dropDuplicates(["no_id", "id", "text_hash"])
    alone = sift(named, "text_hash", doubtful, "left_anti")
    return alone.select("document.*").unionByName(chosen.where("n = 1").unionByName(copied).select("document.*"))


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of what is left, and whether they decode to the text again."""
    coded = encode_documents(docs.select("doc_id", "lang", "source", "text"))
    return coded.select("doc_id", "lang", "source", F.size("pieces.ids").cast("long").alias("n_tokens"), F.col("pieces.ids").alias("ids"), F.coalesce(F.col("pieces.decoded") == F.coalesce("text", F.lit("")), F.lit(False)).alias("round_trip"))


STAGES = [
    ("quality_classifier", good_quality),
    ("language_id", known_language),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", without_benchmarks),
    ("sentencepiece", encode),
]

#: Training, near-duplicate search and tokenisation are beyond SQL; the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents. Each stage's output is kept in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/docspark-pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
