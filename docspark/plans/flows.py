"""Whole flows: documents to stored vectors, and questions to answers, as single plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.scalars import chunk_clean, chunk_uuid, confidence, preview, vector_id
from docspark.operators.chunking import semantic
from docspark.operators.best import product_topk
from docspark.operators.search import answer, bm25, embed, fuse, with_rows
from docspark.operators.similarity import deduplicate
from docspark.plans.fixtures import documents, load
from docspark.registry import query
from docspark.scratch import written

c = F.col


def ingest(docs: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Documents (id, filename, raw_text) to deduplicated chunks with ids and vectors; exact copies are stored once."""
    first = docs.groupBy(F.sha2("raw_text", 256).alias("content_hash")).agg(F.min_by(F.struct("id", "filename", "raw_text"), "id").alias("d")).select("content_hash", "d.*")
    clean = first.withColumn("clean", chunk_clean(c("raw_text")))
    kept = clean.withColumn("cut", semantic(c("clean"))).withColumn("kept", deduplicate(c("cut"), threshold))
    chunks = kept.select("id", "filename", "content_hash", F.posexplode_outer("kept").alias("chunk_index", "content")).where("content is not null")
    keyed = chunks.withColumn("chunk_id", chunk_uuid(c("filename"), c("chunk_index"), c("content"))).withColumn("vector_id", vector_id(c("id").cast("string"), c("chunk_index").cast("string")))
    return keyed.withColumn("vector", embed(c("content")))


def retrieve(chunks: DataFrame, questions: DataFrame, k: int = 5, method: str = "hybrid_rrf", weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """(query_id, rank, item, score) of the best chunks (item, content, vector) for a stated set of questions
    (query_id, text), by dense_only, sparse_only, hybrid_rrf, hybrid_weighted or hybrid_borda."""
    from pyspark.sql import Window

    if method not in ("dense_only", "sparse_only") and not method.startswith("hybrid_"):
        raise ValueError(f"unknown method {method}")
    asked = questions.select("query_id", embed(c("text")).alias("q"))
    rank = lambda df, n: df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "item"))).where(c("rank") <= n)
    dense = product_topk(chunks.select("item", "vector"), asked, 3 * k, "item", "vector", unit=True) if method != "sparse_only" else None
    if method == "dense_only":
        return dense.where(c("rank") <= k)
    most = k if method == "sparse_only" else 3 * k
    sparse = bm25(chunks.select(c("item").alias("doc_id"), c("content").alias("text")), questions, most).select("query_id", c("doc_id").alias("item"), "rank", "score")
    if method == "sparse_only":
        return sparse
    return rank(fuse(dense, sparse, method.removeprefix("hybrid_"), weights).withColumnRenamed("fused", "score"), k)


def ask(chunks: DataFrame, questions: DataFrame, k: int = 5, method: str = "hybrid_rrf", weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """Answer, confidence and sources for each question; questions without hits get the fixed refusal."""
    hits = with_rows(retrieve(chunks, questions, k, method, weights), chunks.select("item", "filename", "content"), "item")
    source = F.struct("rank", "filename", F.round("score", 3).alias("score"), preview(c("content"), 200).alias("preview"))
    by = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("sources"), F.max("score").alias("most"), F.count("*").alias("n"))
    joined = questions.join(by, "query_id", "left")
    n = F.coalesce("n", F.lit(0))
    text = F.concat(F.lit("Content: "), F.try_element_at("sources", F.lit(1))["preview"])
    return joined.select("query_id", answer(text, n).alias("answer"), F.round(confidence(F.coalesce("most", F.lit(0.0)), n), 4).alias("confidence"), "sources")


@query("flow_ingest")
def _(s: SparkSession, d: str) -> DataFrame:
    return ingest(documents(s, d)).select("id", "chunk_index", "chunk_id", "vector_id", F.length("content").alias("n_chars"), F.size("vector").alias("dimension"))


for _method in ("dense_only", "sparse_only", "hybrid_rrf", "hybrid_weighted", "hybrid_borda"):

    @query(f"flow_ask_{_method}")
    def _(s: SparkSession, d: str, m: str = _method) -> DataFrame:
        """Over chunks, so that every part of a text has a vector; ``embed`` takes 8,000 characters as one input."""
        stored = written(ingest(documents(s, d)).select(c("chunk_id").alias("item"), "filename", "content", "vector"), "chunks")  # cut and embedded once
        questions = load(s, d, "benchmark").select(c("item_id").alias("query_id"), "text")
        return ask(stored, questions, 5, m)
