"""Steps that keep their work by row or by task: the same rows as by brute force or by joins, and plans without the old growth."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspark import registry
from docspark.operators import best, content, dictionary, layout, parts, search, similarity, sparse


def test_regions_of_small_pages_as_by_links(spark):
    rng = random.Random(4)
    words = "alpha beta gamma delta pump valve oil x y".split()
    rows = []
    for pos in range(300):
        text = rng.choice([None, "", "ab", "Å B"]) if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 7)))
        x, y = rng.uniform(0, 300), rng.uniform(0, 300)
        box = [None] * 4 if rng.random() < 0.05 else [x, y, x + rng.uniform(-5, 90), y + rng.uniform(0, 90)]
        rows.append((rng.choice([1, 2, None]), rng.randint(0, 9), pos, text, *box))
    docs = spark.createDataFrame(rows, "doc_id int, page int, pos int, text string, x0 double, y0 double, x1 double, y1 double")
    take = lambda df: sorted(((r["doc_id"] or 0), r["pos"]) for r in df.collect())
    mixed = take(layout.first_regions(docs, 10))
    assert take(layout.first_regions(docs)) == mixed == take(layout._first_by_links(docs))
    plan = layout.first_regions(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # a page's few regions meet once, without a row for each run of letters


def test_deduplicate_names_its_texts_once(spark):
    docs = spark.createDataFrame([(["one two three", "four five six", "one two three"],)], "t array<string>")
    kept = docs.select(similarity.deduplicate(F.transform("t", F.upper)).alias("kept"))
    assert kept.first()["kept"] == ["ONE TWO THREE", "FOUR FIVE SIX"]
    assert "transform(pythonUDF" not in kept._jdf.queryExecution().optimizedPlan().toString()  # else the texts are made again for each that stays


def test_scan_gives_what_joins_give(spark):
    rng = random.Random(5)
    docs = [(f"d{k}", " ".join(rng.choice("a b c d e f g h".split()) for _ in range(rng.randint(0, 9)))) for k in range(300)] + [("n", None)]
    docs = spark.createDataFrame(docs, "doc_id string, text string").repartition(5)
    asked = spark.createDataFrame([(1, "a b"), (2, "c d e zz"), (3, ""), (4, None), (5, "h h g")], "query_id int, text string")
    take = lambda df: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in df.collect())
    right = take(sparse.bm25_topk(docs, asked, 7).ranked)
    found = sparse.scan_topk(docs, asked, 7)
    assert take(found) == right and len(right) == 21
    assert sparse.scan_topk(docs, asked, 7, few=2) is None and sparse.scan_topk(docs.union(docs.limit(1)), asked, 7) is None
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # postings stay where the documents are
    assert sparse.scan_topk(docs, asked.where("query_id = 3"), 7).count() == 0


@pytest.mark.parametrize("unit", [False, True])
def test_products_against_brute_force(spark, unit):
    rng = np.random.default_rng(6)
    x = rng.integers(-2, 3, size=(400, 3)).astype(float)
    rows = [(k, v.tolist(), (k % 7) / 20) for k, v in enumerate(x)] + [(900, None, 0.0), (901, [1.0, None, 2.0], 0.0), (902, [1.0, float("nan"), 2.0], 0.0)]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>, bonus double").repartition(4)
    asked = corpus.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    right, ids = [], [k for k in range(400) if not unit or x[k].any()]
    y = x / np.linalg.norm(x, axis=1, keepdims=True).clip(1e-300) if unit else x
    for q in (k for k in ids if k % 10 == 0):
        scores = sorted(((-round(float(y[q] @ y[k] + (k % 7) / 20), 9), k) for k in ids if k != q))[:6]
        right += [(q, r, k, -s) for r, (s, k) in enumerate(scores, 1)]
    for most in (best.BLOCK_BYTES, 100):
        found = best.product_topk(corpus, asked, 6, unit=unit, bonus="bonus", own=True, most=most)
        assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in found.collect()) == [pytest.approx(z) for z in right]
    assert best.product_topk(corpus, asked.limit(0), 6).count() == 0


def test_few_pairs_of_short_words_meet(spark):
    """Words of one length share single letters at most places; what is left without two letters is shared by few."""
    rng = random.Random(7)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(9)) for _ in range(600)})
    frame = spark.createDataFrame([(w, w) for w in words], "token string, word string")
    met = dictionary._met_by_rest(frame, frame, F.lit(2), F.lit(2)).count()
    by_pieces = dictionary._met(dictionary.windows(frame, frame, "greatest(1, m - 2)", "m + 2", "least(n, 3)", "2"), dictionary.pieces(frame, "least(n, 3)")).count()
    assert len(words) <= met < by_pieces / 5


def test_batches_go_in_parts():
    texts, seen = pa.array(["a" * 30, None, "b" * 50, "", "c" * 200, "d"]), []
    made = parts.by_parts(texts, lambda ts, ks: seen.append(len(ts)) or [len(t or "") + k for t, k in zip(ts, ks, strict=True)], pa.int64(), pa.array(range(6)), most=100)
    assert made.to_pylist() == [30, 1, 52, 3, 204, 6] and seen == [4, 1, 1]
    assert parts.by_parts(texts[:0], lambda ts: [], pa.string()).to_pylist() == []


def test_embedding_is_that_of_single_words(spark):
    rows = spark.createDataFrame([("a b a",), ("",), (None,), ("b",)], "t string").select(search.embed(F.col("t")).alias("v")).collect()
    assert rows[1]["v"] is None and rows[2]["v"] is None and sum(x != 0 for x in rows[3]["v"]) == 1
    assert np.isclose(np.linalg.norm(rows[0]["v"]), 1) and max(map(abs, rows[0]["v"])) == pytest.approx(2 / 5**0.5, abs=1e-6)


def test_all_pairs_of_chunks_by_tiles(spark):
    rng = random.Random(8)
    rows = [(d, k, " ".join(rng.choice("a b c d e f".split()) for _ in range(rng.randint(0, 5)))) for d, n in ((1, 7), (2, 1), (3, 20)) for k in range(n)]
    docs = spark.createDataFrame([*rows, (None, 0, "a"), (None, 1, "a")], "document_id int, chunk_index int, chunk_text string")
    right = []
    for d, i, s in rows:
        for e, j, t in rows:
            if d == e and i < j:
                a, b = set(s.split()), set(t.split())
                right.append((d, i, j, round(len(a & b) / len(a | b), 9) if a | b else 1.0))
    for tile in (256, 4):
        assert sorted((r["document_id"], r["i"], r["j"], round(r["similarity"], 9)) for r in similarity.chunk_pairs(docs, tile).collect()) == sorted(right)
    take = lambda df: sorted(tuple(-1 if v is None else round(v, 9) for v in r) for r in df.collect())
    assert take(similarity.pair_statistics(docs, 0.3)) == take(similarity.pair_statistics(docs, 0.3, few=5)) == take(similarity._statistics_by_words(docs, 0.3))
    assert "lambda" not in similarity.pair_statistics(docs, 0.3)._jdf.queryExecution().optimizedPlan().toString()  # no row for each word


def test_columns_of_many_pages_at_once():
    rng = random.Random(9)
    pages = [[float(rng.choice([10, 30, 200, 210, 420, 400]) + rng.randint(0, 3)) for _ in range(rng.randint(0, 9))] for _ in range(400)]
    widths = np.array([rng.choice([300.0, 600.0]) for _ in pages])
    found = content.columns_of_all(pa.array(pages, pa.list_(pa.float64())), widths)
    assert [x.tolist() for x in found] == [content.columns_of(m, w) if m else [] for m, w in zip(pages, widths.tolist(), strict=True)]


def test_merged_lines_are_those_of_sql_for_any_space_and_letter(spark, tmp_path):
    import duckdb

    from docspark import registry

    texts = [" line\nx\nline\nB", "İa\nx\nia\ny\ni̇a", "ΑΣ\nx\nασ\ny\nας", "　b \nx\nb", "\tb\nx\nb", "ßa\nx\nẞa", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    run, sql = registry.load()["layout_merge_native_ocr"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, run(spark, str(tmp_path)).collect())) == sorted(con.execute(sql).fetchall())


@pytest.mark.parametrize("name", ["search_answers", "search_bulk_answers", "search_hit_diagnostics", "search_context_and_citations"])
def test_few_hits_meet_their_texts_without_a_shuffle_of_texts(spark, name):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as of tables beyond it
    try:
        plan = registry.load()[name][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    at = next(k for k, line in enumerate(plan.splitlines()) if "documents.parquet" in line)
    assert any("BroadcastHashJoin" in line for line in plan.splitlines()[:at])
    assert not any("hashpartitioning(doc_id" in line for line in plan.splitlines())


def test_rows_of_hits(spark):
    corpus = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "doc_id int, text string")
    top = spark.createDataFrame([(7, 2), (8, 1), (8, 2), (9, None), (9, 5)], "query_id int, doc_id int")
    assert sorted((r["query_id"], r["text"]) for r in search.with_rows(top, corpus, "doc_id").collect()) == [(7, "b"), (7, "c"), (8, "a"), (8, "b"), (8, "c")]
