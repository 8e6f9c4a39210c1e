"""BM25 top-k that leaves out postings which can't matter: impacts, their maxima by block of documents, bounds.

A posting's impact is what its term adds to a document's score. Documents lie in blocks of some ``BLOCK`` of like length, and for each term
and block the largest impact is kept. For a query:

1. its *first* terms are those with the largest impacts (the rare ones) that hold about ``SHARE`` of its postings; only their postings are
   summed for all documents, which gives each document a part of its score;
2. the best ``2 k`` documents by these parts are scored fully; the k-th of them is a floor that the k-th best of all can't be under;
3. a document whose part and the block's largest impacts of all other terms together stay under the floor is left out, and so is a whole
   block without first terms; only what remains has the other terms' postings read.

So the postings of words that most documents have are read for few documents. Results are exact: bounds are only ever too high.

That is for query sets of any size. Of a set with few terms (``FEW``) the documents' postings stay where the documents are: ``scan_topk``
writes each document's counts of the set's terms in one row, sends the terms' weights to the tasks and keeps each task's best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from docspark.operators.best import CELLS, Best, ranked
from docspark.scratch import written

c = F.col
K1, B = 1.5, 0.75
#: Documents of a block, the share of a query's postings that its first terms have, and how far sums of rounded numbers may differ.
BLOCK, SHARE, SLACK = 64, 0.15, 1e-6
#: The most pairs of a query and a term that are sent to the tasks.
FEW = 1 << 18


class Retrieved(NamedTuple):
    """``ranked`` (query_id, doc_id, score, rank); ``work`` (query_id, postings, summed): how many postings a query has, and how many were read."""

    ranked: DataFrame
    work: DataFrame


def tokenise(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit(r"[a-z0-9]+"), F.lit(0))


def if_few(rows: DataFrame, most: int = 1 << 20) -> Callable[[DataFrame], DataFrame]:
    """``broadcast`` if ``rows`` (a word and an id each) are at most ``most``; else a plain join, whose skewed keys are split at run time."""
    return F.broadcast if rows.limit(most + 1).count() <= most else lambda df: df


def impacts(corpus: DataFrame, terms: DataFrame, near: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """(term, doc_id, block, w) of the postings of ``terms``; idf is ln(1 + (N - df + 0.5) / (df + 0.5)). The corpus is read once: the number
    of documents and their mean length are observed by the job that counts terms."""
    seen = Observation()
    docs = corpus.select("doc_id", tokenise(c("text")).alias("ts")).select("doc_id", F.size("ts").alias("len"), "ts")
    docs = docs.observe(seen, F.count("*").alias("n"), F.avg("len").alias("mean_len"))
    postings = docs.select("doc_id", "len", F.explode("ts").alias("term")).join(near(terms.select("term").distinct()), "term")
    tf = written(postings.groupBy("term", "doc_id").agg(F.count("*").alias("tf"), F.first("len").alias("len")), "frequencies")
    n, mean_len = F.lit(seen.get["n"] or 0), F.lit(seen.get["mean_len"] or 1.0)
    weights = tf.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log(1 + (n - c("df") + 0.5) / (c("df") + 0.5)).alias("idf"))
    w = c("idf") * c("tf") * (K1 + 1) / (c("tf") + K1 * (1 - B + B * c("len") / mean_len))
    like, parts = F.floor(2 * F.log2(c("len") + 1)).cast("long"), max(1, (seen.get["n"] or 0) // (8 * block))  # lengths spread over some eight steps
    return tf.join(near(weights), "term").select("term", "doc_id", (like * (1 << 40) + F.pmod(F.xxhash64("doc_id"), F.lit(parts))).alias("block"), w.alias("w"))


def bm25_topk(corpus: DataFrame, queries: DataFrame, k: int, share: float = SHARE, block: int = BLOCK) -> Retrieved:
    """The ``k`` best documents of each query (query_id, text) by Okapi BM25, ties to the smaller doc_id."""
    terms = written(queries.select("query_id", F.explode(F.array_distinct(tokenise(c("text")))).alias("term")).distinct(), "terms")
    near = if_few(terms)
    postings = written(impacts(corpus, terms, near, block), "postings")
    maxima = written(postings.groupBy("term", "block").agg(F.max("w").alias("most"), F.count("*").alias("n")), "maxima")
    known = terms.join(near(maxima.groupBy("term").agg(F.max("most").alias("most"), F.sum("n").alias("df"))), "term")
    rare = Window.partitionBy("query_id").orderBy(F.desc("most"), "term")  # a query's terms are few
    upto, total = F.sum("df").over(rare), F.sum("df").over(Window.partitionBy("query_id"))
    split = written(known.select("query_id", "term", "df", ((upto <= total * share) | (upto == c("df"))).alias("first")), "split")
    first, others = (split.where(x).select("query_id", "term") for x in ("first", "not first"))

    parts = postings.join(near(first), "term").groupBy("query_id", "doc_id", "block").agg(F.sum("w").alias("part"), F.count("*").alias("n"))
    parts = written(parts, "parts")
    best = parts.withColumn("at", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("part"), "doc_id"))).where(c("at") <= 2 * k)
    whole = _with_others(best.select("query_id", "doc_id", "part"), others, postings, near)
    at = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    floor = whole.withColumn("at", at).where(c("at") == k).select("query_id", (c("score") - SLACK).alias("floor"))  # none: no document can be left out
    asked = split.select("query_id").distinct()
    floors = written(asked.join(floor, "query_id", "left").select("query_id", F.coalesce("floor", F.lit(float("-inf"))).alias("floor")), "floors")
    few = if_few(floors)

    bounds = maxima.join(near(others), "term").groupBy("query_id", "block").agg(F.sum("most").alias("bound")).join(few(floors), "query_id")
    bounds = written(bounds, "bounds")
    part_bounds = parts.join(bounds.select("query_id", "block", "bound"), ["query_id", "block"], "left").join(few(floors), "query_id")
    hopeful = part_bounds.where(c("part") + F.coalesce("bound", F.lit(0.0)) >= c("floor")).select("query_id", "doc_id", "part")
    # whole blocks that could reach the floor without a first term: documents that have none
    open_blocks = bounds.where(c("bound") >= c("floor")).select("query_id", "block")
    members = postings.join(open_blocks, "block").join(near(others), ["query_id", "term"]).select("query_id", "doc_id").distinct()
    bare = members.join(parts.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").withColumn("part", F.lit(0.0))
    scored = _with_others(hopeful.unionByName(bare), others, postings, near)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "doc_id"))
    ranked = scored.select("query_id", "doc_id", "score").withColumn("rank", rank).where(c("rank") <= k)
    read = parts.select("query_id", "n").unionByName(scored.select("query_id", "n")).groupBy("query_id").agg(F.sum("n").alias("summed"))
    work = split.groupBy("query_id").agg(F.sum("df").alias("postings")).join(read, "query_id")
    return Retrieved(ranked, work)


def _with_others(rows: DataFrame, others: DataFrame, postings: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` (query_id, doc_id, part) with ``score``, the part and the impacts of the query's other terms, and ``n``, their number."""
    asked = rows.join(near(others), "query_id", "left")
    met = asked.join(postings.select("term", "doc_id", "w"), ["term", "doc_id"], "left")
    return met.groupBy("query_id", "doc_id").agg((F.max("part") + F.coalesce(F.sum("w"), F.lit(0.0))).alias("score"), F.count("w").alias("n"))


def counted_terms(corpus: DataFrame, vocabulary: pa.Array) -> DataFrame:
    """(doc_id, len, terms, counts) of each row: its number of tokens, which terms of the vocabulary it has, and how often each."""
    shared, kind = corpus.sparkSession.sparkContext.broadcast(vocabulary), corpus.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            tokens = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
            at = pc.index_in(tokens.flatten(), value_set=known)
            met = at.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)[met]
            keys, counts = np.unique(row * len(known) + pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[met].astype(np.int64), return_counts=True)
            row, term = np.divmod(keys, max(1, len(known)))
            ends = np.r_[0, np.cumsum(np.bincount(row, minlength=len(sizes)))].astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, counts)]
            lengths = pc.list_value_length(tokens).cast(pa.int64())  # none of a null text, which counts as a document but not for the mean
            yield pa.RecordBatch.from_arrays([batch.column(0), lengths, *lists], ["doc_id", "len", "terms", "counts"])

    return corpus.select("doc_id", tokenise(c("text")).alias("ts")).mapInArrow(run, f"doc_id {kind}, len long, terms array<int>, counts array<int>")


def scan_topk(corpus: DataFrame, queries: DataFrame, k: int, few: int = FEW) -> DataFrame | None:
    """As ``bm25_topk``, (query_id, doc_id, score, rank); None if the queries have over ``few`` terms in all, or if ids repeat."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokenise(c("text")))).alias("term")).distinct()
    held = terms.limit(few + 1).toArrow().combine_chunks()
    if held.num_rows > few:
        return None
    column = lambda name: held[name].combine_chunks() if isinstance(held[name], pa.ChunkedArray) else held[name]
    vocabulary, ids = pc.unique(column("term")), pc.unique(column("query_id"))
    spark, names = corpus.sparkSession, ["query_id", "doc_id", "score"]
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, doc_id {corpus.schema['doc_id'].dataType.simpleString()}, score double"
    if not held.num_rows:
        return ranked(spark.createDataFrame([], schema), k, "doc_id")
    docs = written(counted_terms(corpus, vocabulary), "counts")
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return None
    n, mean_len = docs.agg(F.count("*"), F.avg("len")).first()
    df = docs.select(F.explode("terms").alias("term")).groupBy("term").count().toArrow()
    idf = np.zeros(len(vocabulary))
    found = df["count"].to_numpy().astype(np.float64)
    idf[df["term"].to_numpy()] = np.log(1 + (n - found + 0.5) / (found + 0.5))
    of = pc.index_in(column("term"), value_set=vocabulary).to_numpy()
    order = np.argsort(of, kind="stable")
    asked = pc.index_in(column("query_id"), value_set=ids).to_numpy()[order].astype(np.int64)
    ends = np.r_[0, np.cumsum(np.bincount(of, minlength=len(vocabulary)))]
    shared = spark.sparkContext.broadcast((ids, idf, asked, ends, float(mean_len or 1.0) or 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, idf, asked, ends, mean_len = shared.value
        best, size = Best(len(ids), k), max(1, CELLS // (2 * max(len(ids), 64)))
        for batch in batches:
            for low in range(0, batch.num_rows, size):
                part = batch.slice(low, size)
                sizes = pc.list_value_length(part.column(2)).to_numpy(zero_copy_only=False)
                term, tf = (part.column(x).flatten().to_numpy(zero_copy_only=False) for x in (2, 3))
                row = np.repeat(np.arange(part.num_rows), sizes)
                w = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * pc.fill_null(part.column(1), 0).to_numpy(zero_copy_only=False)[row] / mean_len))
                times = ends[term + 1] - ends[term]
                first = np.repeat(ends[term] - np.r_[0, np.cumsum(times)[:-1]] if len(term) else ends[:0], times)
                cell = np.repeat(row * len(ids), times) + asked[first + np.arange(len(first))]
                scores = np.bincount(cell, weights=np.repeat(w, times), minlength=part.num_rows * len(ids)).reshape(part.num_rows, len(ids))
                best.add(part.column(0), scores, scores > 0)
        yield from best.rows(ids, names)

    return ranked(docs.mapInArrow(run, schema), k, "doc_id")
