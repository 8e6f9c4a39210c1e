"""Retrieval that leaves work out: the same rows as by brute force, and how much was read."""

import collections
import math
import random
import re

import numpy as np
import pytest

from docspark.operators import dense, sparse


def brute_bm25(docs, queries, k):
    tokens = [(i, re.findall("[a-z0-9]+", (t or "").lower()), t) for i, t in docs]
    known = [(i, ts) for i, ts, _ in tokens]
    n, mean = len(known), sum(len(ts) for _, ts in known) / max(1, sum(t is not None for _, _, t in tokens))  # null texts have no length
    df = collections.Counter(w for _, ts in known for w in set(ts))
    out = []
    for q, text in queries:
        terms = set(re.findall("[a-z0-9]+", (text or "").lower()))
        scores = []
        for i, ts in known:
            tf = collections.Counter(ts)
            if terms & set(ts):
                score = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(ts) / mean)) for w in terms if w in tf)
                scores.append((-round(score, 9), i, round(score, 7)))
        out += [(q, rank, i, s) for rank, (_, i, s) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def corpus(n, seed, common=0.9):
    """Texts of a word that most have, some frequent ones and many rare ones."""
    rng = random.Random(seed)
    return [(k, " ".join(("all " if rng.random() < common else "") + rng.choice(["red", "blue", "green"] + [f"w{min(rng.randint(0, 400), rng.randint(0, 400))}"] * 3) for _ in range(rng.randint(1, 60)))) for k in range(n)]


@pytest.mark.parametrize("share", [0.0, 0.15, 1.0])
@pytest.mark.parametrize("k", [1, 7, 400])
def test_bm25_is_exact(spark, share, k):
    docs = [*corpus(300, 1), (1000, None), (1001, ""), (1002, "ALL Red"), (1003, "all red"), (1004, "all red")]
    asked = [(1, "all red w3 w17"), (2, "all"), (3, "all blue all red green w0 w1 w2 w3"), (4, "nowhere"), (5, None), (6, "w399 all"), (7, "all red")]
    frames = [spark.createDataFrame(rows, "id bigint, text string") for rows in (docs, asked)]
    found = sparse.bm25_topk(frames[0].withColumnRenamed("id", "doc_id"), frames[1].withColumnRenamed("id", "query_id"), k, share, 8)
    assert sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 7)) for r in found.ranked.collect()) == [pytest.approx(x) for x in brute_bm25(docs, asked, k)]


def test_a_word_of_all_documents_does_not_decide_the_cost(spark):
    docs = spark.createDataFrame(corpus(2000, 2, 1.0), "doc_id bigint, text string")
    asked = spark.createDataFrame([(k, f"all red w{k} w{k + 7}") for k in range(20)], "query_id bigint, text string")
    work = sparse.bm25_topk(docs, asked, 5).work.collect()
    assert len(work) == 20 and all(r["postings"] > 2000 for r in work)
    assert sum(r["summed"] for r in work) < 0.2 * sum(r["postings"] for r in work)


# --- dense -----------------------------------------------------------------------------------------------


def vectors(n, d, clusters, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, clusters), d))
    x = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, d)) if clusters else rng.normal(size=(n, d))
    return [(k, [float(v) for v in row], k % 3) for k, row in enumerate(np.round(x, 3).tolist())]


def brute_topk(rows, asked, k, unit, threshold=None):
    out = []
    for q, a, _ in asked:
        a = np.array(a)
        scored = []
        for i, b, label in rows:
            if i != q:
                b = np.array(b)
                score = a @ b / math.sqrt((a @ a) * (b @ b)) if unit else 1 / (1 + ((a - b) ** 2).sum())
                if threshold is None or score >= threshold:
                    scored.append((-round(score, 9), i, round(score, 7), label))
        out += [(q, rank, i, s, label) for rank, (_, i, s, label) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def plain(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 7), r["label"]) for r in df.collect())


@pytest.mark.parametrize(("clusters", "unit", "k", "threshold"), [(9, True, 5, None), (9, False, 5, None), (0, True, 7, 0.2), (1, False, 300, None), (4, True, 3, 0.999)])
def test_blocks_give_the_exact_best(spark, clusters, unit, k, threshold):
    rows = vectors(260, 6, clusters, 5)
    rows += [(k, rows[1][1], 1) for k in range(300, 330)] + [(7, rows[8][1], 2)]  # ties, a repeated id
    odd = [(900, None, 0), (901, [], 0), (902, [1.0, None] + [0.0] * 4, 0), (903, [float("nan")] * 6, 0), (904, [float("inf")] * 6, 0), (None, [0.0] * 6, 0)]
    corpus = spark.createDataFrame(rows + (odd if unit else odd[:-1]), "vec_id bigint, embedding array<double>, label int")
    asked = [r for r in rows if r[0] % 20 == 0]
    queries = spark.createDataFrame([(i, v) for i, v, _ in asked] + [(901, None), (902, [float("nan")] * 6)], "query_id bigint, q array<double>")
    index = dense.dense_index(corpus, unit, block=16)
    assert plain(dense.block_topk(index, queries, k, threshold)) == brute_topk(rows, asked, k, unit, threshold)
    assert index.blocks.selectExpr("max(size(ids))").first()[0] <= 16 and index.blocks.selectExpr("sum(size(ids))").first()[0] == len(rows)
    assert dense.block_topk(index, queries.limit(0), k).count() == 0


def test_blocks_out_of_reach_are_not_compared(spark):
    """Under a tenth of the pairs where vectors lie in clusters; the blocks are made before the queries are known."""
    rows = vectors(3000, 16, 60, 6)
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    queries = corpus.where("vec_id % 50 = 0").selectExpr("vec_id AS query_id", "embedding AS q")
    for unit in (True, False):
        done, pairs = dense.compared_pairs(dense.dense_index(corpus, unit, block=32), queries, 5)
        assert pairs == 60 * 3000 and 0 < done < pairs // 10


def test_one_vector_a_third_of_all(spark):
    rows = vectors(400, 4, 0, 7) + [(1000 + k, [1.0, 2.0, 3.0, 4.0], 0) for k in range(200)]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    index = dense.dense_index(corpus, block=2)
    assert index.blocks.selectExpr("max(size(ids))").first()[0] <= 2
    asked = rows[:5] + rows[-2:]
    assert plain(dense.block_topk(index, spark.createDataFrame([(i, v) for i, v, _ in asked], "query_id bigint, q array<double>"), 4)) == brute_topk(rows, asked, 4, True)
    empty = dense.dense_index(corpus.limit(0))
    assert dense.block_topk(empty, spark.createDataFrame([(1, [1.0])], "query_id bigint, q array<double>"), 4).count() == 0
