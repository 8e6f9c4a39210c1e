"""Catalog entities derived from the test tables, once as a DataFrame and once as SQL (CTEs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed extensions given to the documents by doc_id modulo 6.
EXTENSIONS = ("pdf", "docx", "xlsx", "pptx", "txt", "csv")
CHUNK = 1000


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document catalog: id, filename, file_type, file_size, content_hash, created_at, raw_text."""
    d = load(spark, sf_dir, "documents")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select(
        F.col("doc_id").alias("id"),
        F.concat(F.col("source"), F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), ext).alias("filename"),
        F.col("lang").alias("file_type"),
        F.col("n_chars").alias("file_size"),
        F.sha2("text", 256).alias("content_hash"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(cast(doc_id % 30 as int))").alias("created_at"),
        F.col("text").alias("raw_text"),
        F.col("source"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-size chunks: document_id, chunk_index, chunk_text, chunk_size, vectorized, vector_id, filename."""
    d = documents(spark, sf_dir)
    n = F.length("raw_text")
    index = F.explode(F.sequence(F.lit(0), F.expr(f"cast((length(raw_text) - 1) div {CHUNK} as int)")))
    c = d.where(n > 0).select("id", "filename", "raw_text", "created_at", index.alias("chunk_index"))
    c = c.withColumn("chunk_text", F.expr(f"substr(raw_text, chunk_index * {CHUNK} + 1, {CHUNK})"))
    c = c.withColumn("vectorized", (F.col("id") + F.col("chunk_index")) % 3 != 0)
    key = F.md5(F.concat_ws("_", F.col("id"), F.col("chunk_index")))
    return c.select(F.col("id").alias("document_id"), "chunk_index", "chunk_text", F.length("chunk_text").alias("chunk_size"), "vectorized", F.when(F.col("vectorized"), F.conv(F.substring(key, 1, 8), 16, 10).cast("long")).alias("vector_id"), "filename", "created_at")


DOCUMENTS_SQL = f"""
cat AS (
  SELECT doc_id AS id, source || '/doc_' || doc_id || '.' || (['{"','".join(EXTENSIONS)}'])[doc_id % 6 + 1] AS filename, lang AS file_type,
    n_chars AS file_size, sha256(text) AS content_hash, TIMESTAMP '2024-01-01' + to_days((doc_id % 30)::INT) AS created_at, text AS raw_text, source
  FROM documents)"""
CHUNKS_SQL = f"""{DOCUMENTS_SQL},
chunk0 AS (SELECT *, unnest(range(0, (length(raw_text) - 1) // {CHUNK} + 1))::INT AS chunk_index FROM cat WHERE length(raw_text) > 0),
chunk1 AS (SELECT *, substr(raw_text, chunk_index * {CHUNK} + 1, {CHUNK}) AS chunk_text, (id + chunk_index) % 3 <> 0 AS vectorized FROM chunk0),
chunks AS (
  SELECT id AS document_id, chunk_index, chunk_text, length(chunk_text)::INT AS chunk_size, vectorized,
    CASE WHEN vectorized THEN ('0x' || substr(md5(id || '_' || chunk_index), 1, 8))::BIGINT END AS vector_id, filename, created_at
  FROM chunk1)"""
