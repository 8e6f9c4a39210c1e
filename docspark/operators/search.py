"""Retrieval: dense, sparse and fused top-k, context and source shaping, diagnostics, evaluation, embedding."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions.scalars import confidence, embed_clean, key_terms, preview, words
from docspark.operators.best import product_topk
from docspark.operators.dense import block_topk, dense_index
from docspark.operators.sparse import K1, B, bm25_topk, if_few, scan_topk
from docspark.plans.fixtures import load
from docspark.registry import query
from docspark.scratch import written

c = F.col
RRF = 60
#: The most bytes of query vectors that are broadcast, and the queries of a block beyond that.
BROADCAST_BYTES, TILE = 64 << 20, 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def closeness(a: Column, b: Column) -> Column:
    """1 / (1 + squared distance)."""
    return 1 / (1 + squared_distance(a, b))


def against_queries(corpus: DataFrame, queries: DataFrame, most: int = BROADCAST_BYTES, tile: int = TILE) -> DataFrame:
    """Every row of ``corpus`` with every row of the stated query set (query_id, q), in blocks.

    The set is counted first. Up to ``most`` bytes of vectors it is broadcast and the corpus isn't shuffled. A larger set is
    dealt into blocks of about ``tile`` queries and the corpus into parts of 64 times as many rows, both by a hash of the whole
    row, so that a task run again deals alike (no column may be a map). A block and a part meet under a key of their own; the
    part is streamed past the block, so no task holds more than a block, however large both sides are.
    """
    n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
    if n * max(1, width) * 8 <= most:
        return corpus.join(F.broadcast(queries))
    blocks, parts = -(-n // tile), max(1, -(-corpus.count() // (64 * tile)))
    deal = lambda df, count: F.pmod(F.xxhash64(*df.columns), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = corpus.withColumn("part", deal(corpus, parts)).withColumn("block", every(blocks))
    right = queries.withColumn("block", deal(queries, blocks)).withColumn("part", every(parts))
    return left.join(right, ["block", "part"]).drop("block", "part")


def dense_topk(corpus: DataFrame, queries: DataFrame, k: int, score=cosine, threshold: float | None = None, most: int = BROADCAST_BYTES, tile: int = TILE) -> DataFrame:
    """(query_id, rank, vec_id, score). ``queries`` (query_id, q) is a stated set.

    Cosines and ``closeness`` of a set of up to ``most`` bytes are found by blocks with bounds, see ``dense``. Other scores and larger
    sets meet all of the corpus in tiles, see ``against_queries``; each task keeps a group limit of k a query before the ranks are shuffled.
    """
    if score in (cosine, closeness):
        n, width = queries.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
        if n * max(1, width) * 8 <= most:
            found = block_topk(dense_index(corpus, score is cosine), queries, k, threshold)
            if "q_label" in queries.columns:
                found = found.join(F.broadcast(queries.select("query_id", "q_label").dropDuplicates(["query_id"])), "query_id")
            return found if "label" in corpus.columns else found.drop("label")
    pairs = against_queries(corpus, queries, most, tile).where(c("vec_id") != c("query_id")).withColumn("score", score(c("embedding"), c("q")))
    if threshold is not None:
        pairs = pairs.where(c("score") >= threshold)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id"))
    return pairs.select("query_id", "vec_id", "score", *[x for x in ("label", "q_label") if x in pairs.columns]).withColumn("rank", rank).where(c("rank") <= k)


def bm25(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, doc_id, score) by Okapi BM25, see ``sparse``."""
    found = scan_topk(corpus, queries, k)
    return bm25_topk(corpus, queries, k).ranked if found is None else found


def fuse(a: DataFrame, b: DataFrame, method: str, weights: tuple[float, float] = (0.6, 0.4)) -> DataFrame:
    """(query_id, item, fused) of two ranked lists (query_id, item, rank, score), by rrf, weighted or borda."""
    by_query = Window.partitionBy("query_id")
    part = []
    for name, ranked in (("a", a), ("b", b)):
        low, high = F.min("score").over(by_query), F.max("score").over(by_query)
        value = {"rrf": 1 / (RRF + c("rank")), "borda": (F.count("*").over(by_query) - c("rank")).cast("double"), "weighted": F.when(high > low, (c("score") - low) / (high - low)).otherwise(1.0)}[method]
        part.append(ranked.select("query_id", "item", value.alias(name)))
    wa, wb = weights if method == "weighted" else (1.0, 1.0)
    return part[0].join(part[1], ["query_id", "item"], "full").select("query_id", "item", (F.coalesce("a", F.lit(0.0)) * wa + F.coalesce("b", F.lit(0.0)) * wb).alias("fused"))


def embed(t: Column, dimension: int = 64) -> Column:
    """A deterministic offline stand-in for a remote embedding model: hashed words, unit length; null for empty texts."""

    @F.arrow_udf("array<float>")
    def run(x: pa.Array) -> pa.Array:
        out, places = [], {}

        def place(w: str) -> int:
            """The place of a word's number, from ``dimension`` on if it is taken off."""
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            if len(places) > 100_000:
                places.clear()
            places[w] = at = h % dimension + (0 if h >> 63 else dimension)
            return at

        for text in x.to_pylist():
            at = [places[w] if w in places else place(w) for w in (text or "").lower().split()]
            counts = np.bincount(np.array(at, dtype=np.int64), minlength=2 * dimension)
            v = (counts[:dimension] - counts[dimension:]).astype(np.float64)
            norm = np.linalg.norm(v)
            out.append((v / norm).astype(np.float32).tolist() if norm else None)
        return pa.array(out, pa.list_(pa.float32()))

    clean = embed_clean(t)
    return F.when(clean != "", run(clean))


def context(hits: DataFrame) -> DataFrame:
    """The block of numbered passages that goes to a generator, by query."""
    part = F.format_string("--- Document %d: %s (Section %d) ---\nSimilarity: %.3f\nContent: %s", "rank", "filename", "section", "score", "content")
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("t"))))  # at most k for a query
    return hits.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n\n").alias("context"))


def citations(hits: DataFrame) -> DataFrame:
    part = F.concat(F.lit("- Document "), c("rank").cast("string"), F.lit(": "), c("filename"), F.lit(" (Page "), c("section").cast("string"), F.lit(")"))
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("t"))))
    return hits.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("citations"))


def answer(context_text: Column, found: Column) -> Column:
    """A deterministic extractive stand-in for a language model: the first passage's start, or a fixed refusal."""
    return F.when(found > 0, preview(F.regexp_extract(context_text, r"Content: ([^\n]*)", 1), 300)).otherwise("I could not find relevant documents for this question.")


# --- queries ---------------------------------------------------------------------------------------------


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "embeddings").select("vec_id", "embedding", "label")


def _asked(s: SparkSession, d: str, every: int = 50) -> DataFrame:
    """The stated query set: every ``every``-th vector."""
    return _vectors(s, d).where(c("vec_id") % every == 0).select(c("vec_id").alias("query_id"), c("embedding").alias("q"), c("label").alias("q_label"))


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
_DENSE = lambda every, k, where="TRUE": f"""dense AS (SELECT * FROM (SELECT q.vec_id AS query_id, q.label AS q_label, e.vec_id, e.label, {_COS} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 9) DESC, e.vec_id) AS rank
  FROM embeddings q JOIN embeddings e ON q.vec_id % {every} = 0 AND e.vec_id <> q.vec_id WHERE {where}) WHERE rank <= {k})"""  # noqa: E731


@query("search_dense_topk", f"WITH {_DENSE(50, 20, _COS + ' >= 0.25')} SELECT query_id, rank::INT AS rank, vec_id, round(score, 3) AS score, 'src' || label AS source FROM dense")
def _(s: SparkSession, d: str) -> DataFrame:
    top = dense_topk(_vectors(s, d), _asked(s, d), 20, threshold=0.25)
    return top.select("query_id", "rank", "vec_id", F.round("score", 3).alias("score"), F.concat(F.lit("src"), c("label").cast("string")).alias("source"))


@query("search_distance_topk", """SELECT query_id, rank::INT AS rank, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM
(SELECT q.vec_id AS query_id, e.vec_id, 1 / (1 + list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id)) WHERE rank <= 10""")
def _(s: SparkSession, d: str) -> DataFrame:
    top = dense_topk(_vectors(s, d), _asked(s, d), 10, closeness)
    return top.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("search_retrieval_stats", f"""WITH {_DENSE(50, 5)}, g AS (SELECT query_id, count(*) AS n, max(score) AS most, min(score) AS least, avg(score) AS mean, string_agg(DISTINCT 'src' || label, ',' ORDER BY 'src' || label) AS sources FROM dense GROUP BY 1)
SELECT query_id, n, round(most, 6) AS most, round(least, 6) AS least, round(mean, 6) AS mean, sources, round(least(0.9, (CASE WHEN most >= 0.7 THEN 0.8 WHEN most >= 0.5 THEN 0.65 WHEN most >= 0.3 THEN 0.5 WHEN most >= 0.2 THEN 0.35 ELSE 0.25 END)::DOUBLE + least(0.1, 0.02 * n)), 6) AS confidence FROM g""")
def _(s: SparkSession, d: str) -> DataFrame:
    g = dense_topk(_vectors(s, d), _asked(s, d), 5).groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("most"), F.min("score").alias("least"), F.avg("score").alias("mean"), F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("src"), c("label").cast("string")))), ",").alias("sources"))
    return g.select("query_id", "n", *[F.round(x, 6).alias(x) for x in ("most", "least", "mean")], "sources", F.round(confidence(c("most"), c("n")), 6).alias("confidence"))


@query("search_evaluate", f"""WITH {_DENSE(50, 10)} SELECT q_label, count(DISTINCT query_id) AS n_queries, round(avg((label = q_label)::INT), 6) AS precision_at_10, round(avg(CASE WHEN label = q_label THEN 1.0 / rank ELSE 0 END), 6) AS mean_reciprocal FROM dense GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    asked = _asked(s, d, 50)
    top = dense_topk(_vectors(s, d), asked, 10)
    hit = (c("label") == c("q_label")).cast("int")
    return top.groupBy("q_label").agg(F.countDistinct("query_id").alias("n_queries"), F.round(F.avg(hit), 6).alias("precision_at_10"), F.round(F.avg(hit / c("rank")), 6).alias("mean_reciprocal"))


def _questions(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "benchmark").select(c("item_id").alias("query_id"), "text")


_BM25 = f"""docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS mean_len FROM docs),
terms AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
post AS (SELECT doc_id, len(ts) AS l, unnest(ts) AS term FROM docs), tf AS (SELECT term, doc_id, count(*) AS tf, any_value(l) AS l FROM post WHERE term IN (SELECT term FROM terms) GROUP BY 1, 2),
w AS (SELECT term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5)) AS idf, mean_len FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), st),
sums AS (SELECT query_id, doc_id, sum(idf * tf * {K1 + 1} / (tf + {K1} * (1 - {B} + {B}::DOUBLE * l / mean_len))) AS score FROM tf JOIN w USING (term) JOIN terms USING (term) GROUP BY 1, 2),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sums) WHERE rank <= 20)"""


@query("search_sparse_bm25", f"WITH {_BM25} SELECT query_id, rank::INT AS rank, doc_id, round(score, 5) AS score FROM sparse")
def _(s: SparkSession, d: str) -> DataFrame:
    return bm25(load(s, d, "documents"), _questions(s, d), 20).select("query_id", "rank", "doc_id", F.round("score", 5).alias("score"))


def _two_lists(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Cosine and distance lists of different lengths stand for two retrievers."""
    a = dense_topk(_vectors(s, d), _asked(s, d), 20)
    b = product_topk(_vectors(s, d).withColumn("bonus", F.pmod(c("vec_id"), F.lit(7)) / 20), _asked(s, d), 12, bonus="bonus", own=True)
    return tuple(x.select("query_id", c("vec_id").alias("item"), "rank", "score") for x in (a, b))


_LISTS = f"""{_DENSE(50, 20)}, b0 AS (SELECT q.vec_id AS query_id, e.vec_id, list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) + (e.vec_id % 7)::DOUBLE / 20 AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id),
lb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM b0) WHERE rank <= 12),
va AS (SELECT query_id, vec_id, 1.0 / ({RRF} + rank) AS rrf, (count(*) OVER q - rank)::DOUBLE AS borda, (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) AS weighted FROM dense WINDOW q AS (PARTITION BY query_id)),
vb AS (SELECT query_id, vec_id, 1.0 / ({RRF} + rank) AS rrf, (count(*) OVER q - rank)::DOUBLE AS borda, (score - min(score) OVER q) / (max(score) OVER q - min(score) OVER q) AS weighted FROM lb WINDOW q AS (PARTITION BY query_id))"""
for _method, _wa, _wb in (("rrf", 1, 1), ("weighted", 0.6, 0.4), ("borda", 1, 1)):

    @query(f"search_fusion_{_method}", f"WITH {_LISTS} SELECT query_id, vec_id AS item, round(coalesce(va.{_method}, 0) * {_wa} + coalesce(vb.{_method}, 0) * {_wb}, 6) AS fused FROM va FULL JOIN vb USING (query_id, vec_id)")
    def _(s: SparkSession, d: str, m: str = _method) -> DataFrame:
        return fuse(*_two_lists(s, d), m).withColumn("fused", F.round("fused", 6))


@query("search_compare_methods", f"""WITH {_LISTS} SELECT query_id, count(*) AS n_union, count(*) FILTER (va.rrf IS NOT NULL AND vb.rrf IS NOT NULL) AS n_both FROM va FULL JOIN vb USING (query_id, vec_id) GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    a, b = _two_lists(s, d)
    both = a.select("query_id", "item", F.lit(1).alias("a")).join(b.select("query_id", "item", F.lit(1).alias("b")), ["query_id", "item"], "full")
    return both.groupBy("query_id").agg(F.count("*").alias("n_union"), F.count_if(c("a").isNotNull() & c("b").isNotNull()).alias("n_both"))


def with_rows(top: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """Each row of ``top``, at most some of a query, with its row of ``corpus``. It is made once; if it is small, the corpus isn't shuffled."""
    found = written(top, "top")
    return corpus.join(if_few(found)(found), key)


def _hits(s: SparkSession, d: str, k: int = 5) -> DataFrame:
    docs = load(s, d, "documents").select("doc_id", F.concat(F.lit("doc_"), c("doc_id").cast("string")).alias("filename"), "text")
    top = bm25(load(s, d, "documents"), _questions(s, d), k)
    return with_rows(top, docs, "doc_id").select("query_id", "rank", "filename", (c("doc_id") % 9).alias("section"), "score", preview(c("text"), 200).alias("content"), "doc_id", "text")


_HITS = f"""{_BM25}, hits AS (SELECT query_id, rank, 'doc_' || doc_id AS filename, doc_id % 9 AS section, score, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS content, text FROM sparse JOIN documents USING (doc_id) WHERE rank <= 5)"""


@query("search_context_and_citations", f"""WITH {_HITS} SELECT query_id, md5(string_agg('--- Document ' || rank || ': ' || filename || ' (Section ' || section || ') ---' || chr(10) || 'Similarity: ' || printf('%.3f', score) || chr(10) || 'Content: ' || content, chr(10) || chr(10) ORDER BY rank)) AS context_md5,
string_agg('- Document ' || rank || ': ' || filename || ' (Page ' || section || ')', chr(10) ORDER BY rank) AS citations FROM hits GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    hits = _hits(s, d)
    return context(hits).select("query_id", F.md5("context").alias("context_md5")).join(citations(hits), "query_id")


@query("search_bulk_answers", f"""WITH {_HITS} SELECT query_id, string_agg('[Score: ' || printf('%.3f', score) || '] ' || content, ' <CHUNK_SPLIT> ' ORDER BY rank) AS context FROM hits GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    part = F.format_string("[Score: %.3f] %s", "score", "content")
    parts = F.array_sort(F.collect_list(F.struct("rank", part.alias("t"))))
    return _hits(s, d).groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), " <CHUNK_SPLIT> ").alias("context"))


@query("search_hit_diagnostics", rf"""WITH {_HITS} SELECT query_id, rank::INT AS rank, length(h.text)::INT AS n_chars, len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(h.text), '[ \t\n\r\x0B\f]+'), lambda w: w <> '')), list_distinct(list_filter(regexp_split_to_array(lower(b.text), '[ \t\n\r\x0B\f]+'), lambda w: w <> ''))))::INT AS overlap,
array_to_string(list_filter(['the', 'nd', 'zz'], lambda t: contains(lower(h.text), t)), ',') AS terms, md5(array_to_string(string_split(h.text, chr(10))[:15], chr(10))) AS first_lines FROM hits h JOIN benchmark b ON item_id = query_id""")
def _(s: SparkSession, d: str) -> DataFrame:
    asked = _questions(s, d).select("query_id", words(F.lower("text")).alias("qw"))
    overlap = F.size(F.array_intersect(words(F.lower("text")), c("qw")))
    return _hits(s, d).join(asked, "query_id").select("query_id", "rank", F.length("text").alias("n_chars"), overlap.alias("overlap"), F.array_join(key_terms(c("text"), ("the", "nd", "zz")), ",").alias("terms"), F.md5(F.array_join(F.slice(F.split("text", "\n"), 1, 15), "\n")).alias("first_lines"))


@query("search_answers")
def _(s: SparkSession, d: str) -> DataFrame:
    """Question to answer: retrieve, build the context, generate by the offline stand-in, with confidence."""
    hits = _hits(s, d)
    stats = hits.groupBy("query_id").agg(F.max("score").alias("most"), F.count("*").alias("n"))
    return context(hits).join(stats, "query_id").select("query_id", answer(c("context"), c("n")).alias("answer"), confidence(c("most") / 100, c("n")).alias("confidence"))


@query("search_embed_texts")
def _(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "benchmark").select("item_id", embed(c("text")).alias("embedding"))


@query("search_source_counts", f"WITH {_DENSE(50, 10)} SELECT 'src' || label AS source, count(*) AS hits, count(DISTINCT query_id) AS queries FROM dense GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return dense_topk(_vectors(s, d), _asked(s, d, 50), 10).groupBy(F.concat(F.lit("src"), c("label").cast("string")).alias("source")).agg(F.count("*").alias("hits"), F.countDistinct("query_id").alias("queries"))
