"""Rules and boundaries of the operators on literal rows."""

import io
import random
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.functions import scalars
from docspark.operators import catalog, chunking, files, layout, search, similarity, sparse, spelling
from docspark.sources import readers
from docspark.sources.sinks import Collection, write_csv
from docspark.streaming import jobs

c = F.col


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("most", "n", "value"), [(0.70, 1, 0.82), (0.69, 1, 0.67), (0.50, 2, 0.69), (0.30, 3, 0.56), (0.20, 5, 0.45), (0.19, 10, 0.35), (0.95, 5, 0.90), (0.5, 0, 0.10)])
def test_confidence(spark, most, n, value):
    assert one(spark, scalars.confidence(F.lit(most), F.lit(n))) == pytest.approx(value)


@pytest.mark.parametrize(("days", "name"), [(6, "very_recent"), (7, "recent"), (29, "recent"), (30, "moderately_recent"), (89, "moderately_recent"), (90, "within_year"), (364, "within_year"), (365, "within_5_years"), (1824, "within_5_years"), (1825, "older")])
def test_age_bucket(spark, days, name):
    assert one(spark, scalars.age_bucket(F.lit(days))) == name


@pytest.mark.parametrize(("raw", "value"), [("D:20240131235959+02'00'", "2024-01-31 23:59:59"), ("D:202401312359", "2024-01-31 23:59:00"), ("D:2024013123", "2024-01-31 23:00:00"), ("D:20240131", "2024-01-31 00:00:00"), ("20240131", None), ("D:2024", None)])
def test_pdf_date(spark, raw, value):
    assert one(spark, F.date_format(scalars.pdf_date(F.lit(raw)), "yyyy-MM-dd HH:mm:ss")) == value


@pytest.mark.parametrize(("folder", "name", "size", "reason"), [
    ("/d", "a.exe", 9999, "bad_extension"), ("/folder", "a.pdf", 9999, "archive_folder"), ("/d", "test_final.pdf", 1, "important_file"), ("/d", "~x.pdf", 9999, "rejected_pattern"), ("/d", "copy of a.docx", 9999, "rejected_pattern"),
    ("/d", "a.docx", 1023, "too_small"), ("/d", "a.docx", 1024, "suspicious_size"), ("/d", "a.docx", 1025, "passed_all_checks"), ("/d", "a.pdf", 5119, "pdf_too_small"), ("/d", "a.pdf", 5120, "passed_all_checks"), ("/d", "a.pdf", 104857600, "passed_all_checks"), ("/d", "a.pdf", 104857601, "too_large"),
])
def test_file_rules(spark, folder, name, size, reason):
    ext = name.rsplit(".", 1)[1]
    assert one(spark, files.classify(F.lit(folder), F.lit(name), F.lit(ext), F.lit(size))) == reason


def test_similarity_cases(spark):
    a = "Aircraft maintenance requires regular inspection of all components."
    b = "Aircraft maintenance needs regular inspection of all parts."
    head = "Document: file{}.pdf\nPage: {}\n\nAircraft maintenance procedures are critical."
    rows = spark.createDataFrame([(1, a, a), (2, a, b), (3, head.format(1, 1), head.format(2, 2)), (4, a, ""), (5, None, a)], "k int, a string, b string")
    found = {r["k"]: r for r in rows.select("k", similarity.content_similarity(c("a"), c("b"), "jaccard").alias("j"), similarity.content_similarity(c("a"), c("b")).alias("m")).collect()}
    assert found[1]["j"] == found[1]["m"] == 1.0 and found[3]["m"] == 1.0
    assert found[2]["j"] == pytest.approx(0.6) and 0.4 < found[2]["m"] < 1
    assert found[4]["m"] == found[5]["m"] == 0.0
    with pytest.raises(ValueError, match="unknown"):
        similarity.content_similarity(c("a"), c("b"), "other")


@given(st.text("abc ", max_size=24), st.text("abc ", max_size=24))
@settings(max_examples=60, deadline=None)
def test_fuzzy_ratio(a, b):
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    row = [0] * (len(y) + 1)
    for p in x:
        row, old = [0], row
        for k, q in enumerate(y):
            row.append(old[k] + 1 if p == q else max(old[k + 1], row[k]))
    expected = 1.0 if not x and not y else 2 * row[-1] / (len(x) + len(y))
    assert similarity.fuzzy_ratio(a, b) == pytest.approx(expected)


def test_similar_pairs_against_brute_force(spark):
    texts = ["a b c d e", "a b c d f", "x y z", "a b c d e", "e d c b a q", "m n", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    found = {(r["a"], r["b"]) for r in similarity.similar_pairs(rows, 0.5).collect()}
    sets = {k: frozenset(t.split()) for k, t in enumerate(texts) if t and texts.index(t) == k}
    expected = {(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5}
    assert found == expected and expected


def test_chunk_limits(spark):
    text = ". ".join("word " * (k % 60 + 1) for k in range(80))
    chunks = one(spark, chunking.sentence_split(c("t")), t=text)
    assert all(len(x) <= chunking.MOST for x in chunks) and sum(x.count("word") for x in chunks) == text.count("word")
    assert one(spark, chunking.sentence_pack(c("t")), t="") == []
    assert one(spark, chunking.semantic(c("t")), t="a\n\nb\n\n" + "c" * 1999) == ["a\n\nb", "c" * 1999]


def test_recent_lines(spark):
    assert one(spark, scalars.keep_recent_lines(c("t")), t="a\nA \nb\n\n\nc\nd\ne\na") == "a\nb\n\n\nc\nd\ne\na"


def test_block_chunks_stay_on_pages(spark):
    rows = [(1, 1, 0, "TEXT_BLOCK", "x" * 1500), (1, 1, 1, "HEADER", "y" * 600), (1, 1, 2, "DRAWING", "Drawing/Graphic 3"), (1, 2, 3, "TEXT_BLOCK", "z"), (1, 2, 4, "IMAGE", "Image 1"), (1, 2, 5, "TABLE", None)]
    found = chunking.block_chunks(spark.createDataFrame(rows, "doc_id int, page int, pos int, block_type string, text string")).orderBy("page", "page_chunk").collect()
    assert [r["content"] for r in found] == ["x" * 1500, "[Page 1, HEADER] " + "y" * 600, "z"]


@pytest.mark.parametrize("most", [1000, 0])
def test_spelling(spark, most):
    """By a broadcast dictionary and by a joined one; protected words stay, text is normalised, separators are kept."""
    docs = spark.createDataFrame([(1, "Haet and was a-heat, the onre! ster"), (2, "for have ander one ten \uff48eat in-\n spect x\u2014y"), (3, None)], "doc_id int, text string")
    found = {r["doc_id"]: r for r in spelling.correct_contextual(docs, spelling.terminology(spark), most=most).collect()}
    assert found[1]["corrected"] == "HEAT and was a-heat, HEAT Action! reer" and found[1]["n_blocked"] == 2
    assert [(x["original"], x["method"]) for x in found[1]["corrections"]] == [("Haet", "misspelling_correction"), ("the", "misspelling_correction"), ("onre", "misspelling_correction"), ("ster", "dictionary_match")]
    assert found[2]["corrected"] == "for have AND one ten HEAT inspect x-y" and found[2]["n_blocked"] == 4
    assert found[3]["corrected"] == "" and found[3]["total_words"] == 0


#: Protected words with a correction that each never becomes, as the rules are written down in the survey's source.
BARRED = [("one", "TOW"), ("seven", "FIV"), ("the", "AND"), ("with", "BAD"), ("work", "CAN"), ("best", "BIG"), ("could", "WAY"), ("actions", "ACT"), ("using", "USE"), ("need", "MAY"), ("been", "WAS"), ("had", "THE"), ("were", "DID"), ("an", "HAD"), ("way", "PAX"), ("passengers", "WAS")]


def test_every_protection_rule():
    barred = spelling.blocked_pairs()
    assert all(never in barred[word] for word, never in BARRED) and len(barred) == 72
    assert "TOW" not in barred["the"] and "BIG" not in barred["been"] and "house" not in barred


def test_insert_or_get(spark):
    stored = spark.createDataFrame([(1, "x")], "id int, content_hash string")
    new = spark.createDataFrame([(2, "x"), (3, "y"), (4, "y")], "id int, content_hash string")
    found = {r["id"]: (r["kept_id"], r["inserted"]) for r in catalog.insert_or_get(stored, new).collect()}
    assert found == {2: (1, False), 3: (3, True), 4: (3, False)}


def _zip(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name.replace("__", "/"), text)
    return out.getvalue()


def test_readers(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    docx = _zip(**{"word__document.xml": f"<w:document {w}><w:body>{p('One')}{p(' ')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl></w:body></w:document>"})
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
    pptx = _zip(**{"ppt__slides__slide1.xml": f"<p:sld {a}><p:sp><p:txBody><a:p><a:r><a:t>Hi</a:t></a:r></a:p></p:txBody></p:sp></p:sld>"})
    s = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    xlsx = _zip(**{"xl__workbook.xml": f'<workbook {s}><sheets><sheet name="S1"/></sheets></workbook>', "xl__sharedStrings.xml": f"<sst {s}><si><t>q</t></si></sst>", "xl__worksheets__sheet1.xml": f'<worksheet {s}><sheetData><row><c t="s"><v>0</v></c><c><v>7</v></c></row><row/></sheetData></worksheet>'})
    for name, data in (("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx), ("d.txt", "é".encode("latin-1")), ("e.csv", b"h,i\n1,\n"), ("f.bin", b"?"), ("g.docx", b"broken")):
        (tmp_path / name).write_bytes(data)
    rows = readers.list_files(spark, str(tmp_path))
    found = {r["name"]: (r["x"]["text"], r["x"]["error"]) for r in rows.select("name", readers.extract_text(c("name"), c("ext"), c("content")).alias("x")).collect()}
    assert found["a.docx"][0] == "One\n\n=== TABLE 1 ===\na\tb" and found["b.pptx"][0] == "=== POWERPOINT: b.pptx ===\n\n=== SLIDE 1 ===\nHi"
    assert found["c.xlsx"][0] == "=== SHEET: S1 ===\nq\t7" and found["d.txt"][0] == "é" and found["e.csv"][0] == "=== CSV: e.csv ===\nh\ti\n1"
    assert found["f.bin"][0] == "Unsupported file type: .bin" and found["g.docx"][1]


def test_questions(spark, tmp_path):
    (tmp_path / "q.csv").write_text('Question,Other\n"why, then?",1\n ,2\n')
    assert [r["question"] for r in readers.read_questions(spark, str(tmp_path / "q.csv")).collect()] == ["why, then?"]


def test_collection(spark, tmp_path):
    store = Collection(spark, f"file://{tmp_path}/c", "id int, source string")
    assert not store.exists()
    store.create()
    store.upsert(spark.createDataFrame([(1, "a"), (2, "b")], store.schema))
    store.upsert(spark.createDataFrame([(2, "c")], store.schema))
    assert sorted(map(tuple, store.read().collect())) == [(1, "a"), (2, "c")]
    assert store.delete("source = 'a'") == 1 and store.info()["count"] == 1
    store.clear()
    assert store.info()["count"] == 0
    store.drop()
    assert not store.exists()


def test_csv_is_quoted(spark, tmp_path):
    out = write_csv(spark.createDataFrame([("a,b", 1)], "t string, n int").coalesce(1), f"{tmp_path}/q", "hybrid_rrf_processed_")
    assert '"a,b","1"' in "".join(p.read_text() for p in (tmp_path / "hybrid_rrf_processed_q").glob("*.csv")) and out.endswith("hybrid_rrf_processed_q")


def test_stream_embeds_pending(spark, tmp_path):
    rows = spark.createDataFrame([(1, "one two", "s", False), (2, "done", "s", True), (3, "", "s", False)], "id bigint, content string, source string, vectorized boolean")
    rows.write.parquet(f"{tmp_path}/in")
    store = Collection(spark, f"file://{tmp_path}/store")
    store.create()
    source = jobs.stream(spark, f"{tmp_path}/in", "id bigint, content string, source string, vectorized boolean")
    jobs.embed_pending(source, store, f"{tmp_path}/check").awaitTermination(60)
    assert [r["id"] for r in store.read().collect()] == [1]


def test_stream_statistics_match_batch(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int)) ts, if(id % 2 = 0, 'a', 'b') event_type, cast(id as double) value from range(200)")
    rows.write.parquet(f"{tmp_path}/in")
    live = jobs.windowed_statistics(jobs.stream(spark, f"{tmp_path}/in", "ts timestamp, event_type string, value double"))
    q = live.writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(str, spark.table("live").collect())) == sorted(map(str, jobs.windowed_statistics(spark.read.parquet(f"{tmp_path}/in")).collect()))


def test_content_types(spark):
    from docspark.operators import content

    texts = {"| a | b | c |\n1 2 3\n4 5 6": "TABLE", "SECTION ONE": "HEADER", "Chart 1 and figure 2": "CHART", "Plain words here, nothing else in this sentence of ordinary prose that goes on for rather more than one hundred characters.": "PARAGRAPH"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", content.content_type(c("t")).alias("x")).collect()
    assert {r["t"]: r["x"]["type"] for r in rows} == texts


def test_columns_and_merge(spark):
    from docspark.operators import content

    pages = spark.createDataFrame([([100.0, 102.0, 500.0, 498.0],), ([100.0, 110.0],), ([50.0, 300.0, 550.0],), (None,)], "m array<double>")
    assert [r["n"] for r in pages.select(content.count_columns(c("m"), F.lit(600.0)).alias("n")).collect()] == [2, 1, 3, 1]
    assert one(spark, content.merge_page_text(c("a"), c("b")), a="First line\nB", b="first lime\nB\n\nNew one\nFirst line") == "First line\nB\nNew one"
    assert one(spark, content.merge_page_text(c("a"), c("b")), a="", b="x") == "x"


def test_ask_without_hits(spark):
    from docspark.plans import flows

    chunks = spark.createDataFrame([(1, "f", "alpha beta")], "item bigint, filename string, content string").withColumn("vector", flows.embed(c("content")))
    questions = spark.createDataFrame([(1, "beta"), (2, "")], "query_id bigint, text string")
    found = {r["query_id"]: r for r in flows.ask(chunks, questions).collect()}
    assert found[1]["answer"] == "alpha beta" and found[2]["confidence"] == 0.1 and "could not find" in found[2]["answer"]
    with pytest.raises(ValueError, match="unknown method"):
        flows.retrieve(chunks, questions, method="other")


def test_dense_topk_in_tiles_equals_broadcast(spark):
    """Beyond the size that is broadcast, blocks of queries meet parts of the corpus and nothing is lost."""
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=4).tolist(), k % 3) for k in range(300)] + [(7, [1.0, 0.0, 0.0, 0.0], 1), (7, [1.0, 0.0, 0.0, 0.0], 1)]
    corpus = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    asked = corpus.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    take = lambda df: sorted(map(tuple, df.select("query_id", "rank", "vec_id", F.round("score", 9)).collect()))
    whole, tiles = search.dense_topk(corpus, asked, 6), search.dense_topk(corpus, asked, 6, most=0, tile=2)
    assert take(whole) == take(tiles) and len(take(whole)) == 60 * 6
    plan = tiles._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert search.dense_topk(corpus, asked.limit(0), 6, most=-1).count() == 0


def test_bm25_joins_by_shuffle_where_terms_are_many(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"red w{k % 4} blue " * (k % 3 + 1)) for k in range(20)] + [(20, None), (21, "")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "red w1"), (2, "w3 blue"), (3, "zz")], "query_id bigint, text string")
    take = lambda: sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 9)) for r in search.bm25(docs, asked, 5).collect())
    few = take()
    monkeypatch.setattr(sparse, "if_few", lambda rows: lambda df: df)
    assert take() == few and len(few) == 10


def test_questions_reach_the_end_of_long_texts(spark, tmp_path):
    """What follows the first 8,000 characters of a document is found by its vectors."""
    from docspark import registry

    early = "\n\n".join(" ".join(f"early{k}x{n}" for n in range(60)) for k in range(40))
    late = "zebra quagga okapi tapir"
    rows = [(1, f"{early}\n\n" + " ".join([late] * 75), "en", "a", 1), (2, "\n\n".join(" ".join(f"other{k}x{n}" for n in range(60)) for k in range(9)), "de", "b", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, late)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert len(early) > 8000
    for method in ("dense_only", "hybrid_rrf", "hybrid_weighted", "hybrid_borda"):
        (found,) = registry.load()[f"flow_ask_{method}"][0](spark, str(tmp_path)).collect()
        assert found["sources"][0]["filename"] == "a/doc_1.docx" and "zebra" in found["sources"][0]["preview"]


def test_whole_table_similarity(spark, tmp_path):
    """All document pairs at 0.5 and every language's documents against the first of their source, by brute force."""
    from docspark import registry

    rows = [(1, "a b c d", "en", "x"), (2, "a b c e", "de", "x"), (3, "D c b a", "es", "y"), (4, "q r", None, "x"), (5, "a b c d", "fr", "y"), (6, "q r s", "es", "y"), (7, "", "en", "x")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sets = {r[0]: set(r[1].lower().split()) for r in rows}
    jac = lambda a, b: round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) if sets[a] | sets[b] else 0.0
    run = {n: registry.load()[n][0](spark, str(tmp_path)).collect() for n in ("similarity_document_pairs", "similarity_existing_document")}
    first = {k: min(j for j in sets if sets[j] == sets[k]) for k in sets if sets[k]}
    found = {(r["a"], r["b"]): r["similarity"] for r in run["similarity_document_pairs"]}
    assert found == {(a, b): jac(a, b) for a in first for b in first if a < b and jac(a, b) >= 0.5 and first[a] == a and first[b] in (a, b)}
    assert {(r["doc_id"], r["first_id"]) for r in run["similarity_existing_document"]} == {(k, 1 if s == "x" else 3) for k, _, _, s in rows}
    assert {r["doc_id"]: r["similarity"] for r in run["similarity_existing_document"] if r["doc_id"] != 7} == {k: jac(k, 1 if s == "x" else 3) for k, _, _, s in rows if k != 7}


def test_queries_of_every_language(spark, tmp_path):
    """Rows of other or no languages, long tokens and all chunks get results."""
    from docspark import registry

    rows = [(1, "consideration " * 100 + "considerations", "en", "x", 1), (2, "straße " * 100 + "strasse straßen", "de", "x", 1), (3, "uno ing the dos", None, "y", 1), (4, "considerationstraße", "fr", "y", 1), (5, "z" * 1500, "es", "y", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda n: registry.load()[n][0](spark, str(tmp_path)).collect()
    for name, key in (("text_similarity_normalise", "doc_id"), ("text_join_hyphens", "doc_id"), ("ids_all", "id")):
        assert sorted(r[key] for r in run(name)) == [1, 2, 3, 4, 5]
    fuzzy = {r["token"]: (r["word"], r["distance"]) for r in run("spelling_fuzzy")}
    assert fuzzy == {"consideration": ("consideration", 0), "considerations": ("consideration", 1), "straße": ("straße", 0), "straßen": ("straße", 1)}
    assert [tuple(r) for r in run("spelling_split_tokens")] == [("considerationstraße", "consideration", "straße")]
    assert {r["doc_id"]: r["n_corrections"] for r in run("spelling_enhanced")}[1] == 1
    points = {r["id"]: r["payload"] for r in run("catalog_upsert_all_points")}
    assert sorted(points) == [100000, 100001, 200000, 300000, 400000, 500000, 500001]
    assert points[500000] == "z" * 1000 and points[300000] == "new uno ing the dos"


def test_stages_pair_on_open_starts(spark):
    """A completion closes all open starts of its stage; one without a start, or a start without one, shifts no other pair."""
    log = [(1, "a", 1, 1, "succeeded"), (1, "a", 2, 2, "started"), (1, "a", 3, 3, "started"), (1, "a", 4, 4, "failed"), (1, "a", 5, 5, "succeeded"), (1, "a", 6, 6, "started"), (1, "b", 2, 7, "started"), (1, "b", 2, 8, "succeeded"), (2, "a", 9, 9, "started")]
    df = spark.createDataFrame(log, "document_id int, stage string, at int, event_id int, status string")
    found = {r["event_id"]: (r["completed_at"], r["success"]) for r in catalog.pair_stages(df).collect()}
    assert found == {2: (4, False), 3: (4, False), 6: (None, None), 7: (2, True), 9: (None, None)}


SIMILAR = ("Aircraft maintenance requires regular inspection of all components.", "Aircraft maintenance needs regular inspection of all parts.", "The weather is sunny today with clear skies.")


def test_combined_similarity_and_first_of_alike(spark):
    headed = [f"Document: file{k}.pdf\nPage: {k}\n\nAircraft maintenance procedures are critical." for k in (1, 2)]
    rows = [(0, SIMILAR[0], SIMILAR[0], 1.0), (1, SIMILAR[0], SIMILAR[1], 0.7), (2, SIMILAR[0], SIMILAR[2], 0.1), (3, *headed, 0.9), (4, "", "x", 0.0), (5, None, "x", 0.0)]
    df = spark.createDataFrame(rows, "k int, a string, b string, expected double")
    found = df.select("k", "expected", similarity.documents_similar(c("a"), c("b")).alias("x"), similarity.chunks_similar(c("a"), c("b"), 0.1).alias("y")).collect()
    assert all(abs(r["x"]["similarity"] - r["expected"]) <= 0.3 for r in found) and [r["x"]["is_similar"] for r in sorted(found)][:3] == [True, True, False]
    assert all(r["y"]["is_similar"] == (r["x"]["similarity"] >= 0.6) for r in found)
    texts = [*SIMILAR, None, "", SIMILAR[0] + " ", *headed]
    one = spark.createDataFrame([(texts,)], "texts array<string>")
    assert one.select(similarity.deduplicate(c("texts")).alias("x")).first()["x"] == [SIMILAR[0], SIMILAR[2], headed[0]]
    results = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "q int, rank int, content string")
    assert sorted(r["rank"] for r in similarity.filter_alike(results, ["q"], ["rank"]).collect()) == [0, 2, 6]


def test_first_of_alike_against_brute_force(spark):
    rng, stop = random.Random(2), frozenset({"the", "of"})
    groups = [[" ".join(rng.choice(["the", "of", "gear", "wing", "bolt", "nut"]) for _ in range(rng.randint(0, 7))) for _ in range(12)] for _ in range(15)]
    df = spark.createDataFrame(list(enumerate(groups)), "k int, texts array<string>")
    for method, threshold in (("jaccard", 0.6), ("combined", 0.5), ("combined", 0.75), ("cosine", 0.7)):
        used = similarity.METHODS if method == "combined" else (method,)
        value = lambda a, b: 1.0 if a == b else sum(similarity.cosine_ratio(a, b, stop) if m == "cosine" else similarity.RATIOS[m](a, b) for m in used) / len(used)  # noqa: B023, E731
        for row in df.select("k", similarity.first_of_alike(c("texts"), threshold, method, stop=stop).alias("at")).collect():
            kept = []
            for k, t in enumerate(groups[row["k"]]):
                if t and all(value(t, groups[row["k"]][j]) < threshold for j in kept):
                    kept.append(k)
            assert row["at"] == kept


def test_cosine_leaves_out_stop_words_and_rare_terms():
    assert similarity.cosine_ratio("the gear of", "the wing of", frozenset({"the", "of"})) == 0.0 < similarity.cosine_ratio("the gear of", "the wing of")
    many = " ".join(f"w{k}" for k in range(900))
    assert similarity.cosine_ratio(f"gear gear {many}", f"gear gear {many.replace('w', 'v')}", features=1) == pytest.approx(1.0)


def test_layout_scalars(spark):
    df = spark.createDataFrame([(1, 10, 5000, 1, "Figure 3 and CHART  12, charts"), (2, 9, 50, 1, "1) a"), (3, 50, 50, 0, "a) b"), (4, 50, 5001, 9, "x\n - y")], "k int, w int, h int, top int, t string")
    rows = df.select("k", layout.usable_image(c("w"), c("h"), c("top")).alias("ok"), layout.chart_references(c("t")).alias("refs"), layout.list_type(c("t")).alias("kind")).collect()
    assert [r["ok"] for r in rows] == [True, False, False, False] and rows[0]["refs"] == ["Figure", "CHART"]
    assert [r["kind"] for r in rows] == ["unknown", "numbered", "lettered", "bulleted"]
    box = spark.createDataFrame([(100.0, 50.0, 200.0, 100.0)], "x0 double, y0 double, x1 double, y1 double")
    assert tuple(layout.to_points(box, F.lit(600.0), F.lit(800.0), F.lit(1200.0), F.lit(400.0)).first()) == (50.0, 100.0, 100.0, 200.0)


def _pdf(*pages, deflate=True, fonts=""):
    import zlib

    kids, parts = " ".join(f"{10 + 2 * k} 0 R" for k in range(len(pages))), []
    parts.append(f"1 0 obj << /Type /Pages /Kids [{kids}] /Count {len(pages)} >> endobj".encode())
    for k, content in enumerate(pages):
        data = zlib.compress(content) if deflate else content
        parts.append(f"{10 + 2 * k} 0 obj << /Type /Page /Parent 1 0 R /Contents {11 + 2 * k} 0 R /Resources << /Font << {fonts} >> >> >> endobj".encode())
        parts.append(f"{11 + 2 * k} 0 obj << /Length {len(data)} {'/Filter /FlateDecode' if deflate else ''} >> stream\n".encode() + data + b"\nendstream endobj")
    return b"%PDF-1.4\n" + b"\n".join(parts)


@pytest.mark.parametrize("deflate", [True, False])
def test_pdf_text(deflate):
    one_ = rb"BT /F1 12 Tf 72 700 Td (Hello \(big\) w\157rld) Tj 0 -14 Td [(sec) -20 (ond) -500 (line)] TJ T* (third) ' ET"
    mapped = b"5 0 obj << /ToUnicode 6 0 R >> endobj 6 0 obj << >> stream\n1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0004> <0062> endbfrange\nendstream endobj"
    data = _pdf(one_, b"BT ET", b"BT /F2 9 Tf <000100020004> Tj ET", deflate=deflate, fonts="/F2 5 0 R") + mapped
    assert readers.PARSERS["pdf"]("a.pdf", data) == "Hello (big) world\nsecond line\nthird\nAbd"
    for bad in (b"no", b"%PDF-1.4 /Encrypt"):
        with pytest.raises(ValueError, match="PDF"):
            readers.PARSERS["pdf"]("a.pdf", bad)


def test_uploads_without_a_parser_are_left_out(spark, tmp_path):
    from docspark.api import Service

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a'\\b.pdf").write_bytes(_pdf(b"BT (A text of a file that is read) Tj ET"))
    (tmp_path / "in" / "b.doc").write_bytes(b"old")
    service = Service(spark, f"{tmp_path}/store")
    assert [r["filename"] for r in service.upload(str(tmp_path / "in")).collect()] == ["a'\\b.pdf"]
    questions = spark.createDataFrame([("What is in the file there?",)] * 2, "question string")
    assert spark.read.option("header", True).csv(service.bulk_questions(questions, f"{tmp_path}/out")).count() == 2
    assert service.delete("a'\\b.pdf") == {"chunks": 1, "documents": 1}
