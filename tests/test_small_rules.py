"""Rules of the service around the operators: encodings, file states, fixed confidences, lookups, spelling counts."""

import pytest
from pyspark.sql import functions as F

from docspark.api import CONFIDENCE, Service
from docspark.functions import scalars
from docspark.operators import catalog, files, spelling
from docspark.sources import readers

c = F.col


def test_questions_in_latin_1(spark, tmp_path):
    (tmp_path / "q").mkdir()
    (tmp_path / "q/a.csv").write_bytes("Question,Answer\ncafé olé?,x\n  ,y\n".encode("latin-1"))
    (tmp_path / "q/b.csv").write_bytes('QUESTION,other\n"naïve,\nover two lines",1\n'.encode())
    (tmp_path / "none").mkdir()
    assert sorted(r["question"] for r in readers.read_questions(spark, f"{tmp_path}/q").collect()) == ["café olé?", "naïve,\nover two lines"]
    assert [r["question"] for r in readers.read_questions(spark, f"{tmp_path}/q/a.csv").collect()] == ["café olé?"]
    with pytest.raises(ValueError, match="no file"):
        readers.read_questions(spark, f"{tmp_path}/none")


def test_files_that_cannot_be_read(spark):
    listed = spark.createDataFrame([("/d/a.pdf", 9000), ("/d/sub/b.pdf", 9000), ("/d/c.pdf", None)], "path string, size bigint")
    asked = spark.createDataFrame([("/d/a.pdf",), ("/d/sub",), ("/d/c.pdf",), ("/d/none.pdf",), (None,)], "path string")
    found = {r["path"]: r["state"] for r in files.path_states(asked, listed).collect()}
    assert found == {"/d/a.pdf": None, "/d/sub": "not_a_file", "/d/c.pdf": "cannot_read_file", "/d/none.pdf": "file_not_found", None: "file_not_found"}
    rows = files.path_states(asked, listed).where("path is not null").select("path", files.classify(F.lit("/d"), F.lit("x.pdf"), F.lit("pdf"), F.coalesce("size", F.lit(0)), c("state")).alias("reason"))
    assert {r["path"]: r["reason"] for r in rows.collect()} == {"/d/a.pdf": "passed_all_checks", "/d/sub": "not_a_file", "/d/c.pdf": "cannot_read_file", "/d/none.pdf": "file_not_found"}


def test_private_bullets_become_spaces(spark):
    assert spark.range(1).select(scalars.unicode_normalise(F.lit("ab•c—d")).alias("t")).first()["t"] == "a b c-d"


def test_chunks_of_one_vector(spark):
    rows = spark.createDataFrame([(1, 0, "A.pdf", 7), (1, 1, "A.pdf", 8), (2, 0, None, 7)], "document_id int, chunk_index int, filename string, vector_id bigint")
    take = lambda **kinds: [(r["document_id"], r["chunk_index"], r["total_chunks"]) for r in catalog.metadata_filter(rows, **kinds).collect()]
    assert take(vector_id=7) == [(1, 0, 2), (2, 0, 2)] and take(vector_id="7", name_part="a.P") == [(1, 0, 1)] and take(vector_id=9) == [] and len(take()) == 3


def test_answers_without_text_behind_and_spelling_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("Haet the red pump. The blue pump needs water and heat every week.")
    service = Service(spark, f"file://{tmp_path}/store")
    assert not service.spelling_statistics()["success"]
    service.upload(f"file://{tmp_path}/in")
    questions = spark.createDataFrame([(1, "what does the blue pump need"), (2, "zz yy xx ww vv"), (3, "hi")], "query_id bigint, text string")
    found = {r["query_id"]: r["confidence"] for r in service.query(questions, method="sparse_only").collect()}
    assert found[2] == CONFIDENCE["nothing_found"] and found[3] == CONFIDENCE["conversational_fallback"] and found[1] not in CONFIDENCE.values()
    summary = {r["query_id"]: r for r in service.comparison_summary(questions.where("query_id < 3")).collect()}
    assert summary[1]["methods_tested"] == 5 and summary[1]["with_hits"] == 5 and summary[1]["best_method"] == "dense_only" and summary[2]["with_hits"] < 5
    corrected = service.correct_spelling(spelling.terminology(spark), frozenset({"the"})).first()
    assert corrected["corrected"].startswith("HEAT the red pump")
    stats = service.spelling_statistics()["spell_correction_stats"]
    assert stats["documents"] == 1 and stats["total_corrections"] == stats["dictionary_corrections"] == len(corrected["corrections"]) and stats["no_corrections"] == corrected["total_words"] - stats["total_corrections"]
