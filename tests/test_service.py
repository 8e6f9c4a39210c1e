"""The service functions from upload to answers, and the configuration."""

import pytest

from docspark.api import Service
from docspark.session import Config


def test_service(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("The red engine needs oil. " * 3 + "\nThe blue pump needs water every single week.")
    (tmp_path / "in/copy.txt").write_text("The red engine needs oil. " * 3 + "\nThe blue pump needs water every single week.")
    (tmp_path / "in/b.csv").write_text("part,colour\nwing,green\n")
    (tmp_path / "in/c.exe").write_text("no")
    service = Service(spark, f"file://{tmp_path}/store")
    assert service.upload(f"{tmp_path}/in", vectorise=False).count() == 2
    assert service.upload(f"{tmp_path}/in", vectorise=False).count() == 2
    assert service.statistics().first()["total_documents"] == 2 and service.query_statistics().count() == 0
    n = service.unvectorised().count()
    assert n > 0 and service.vectorise_pending() == n and service.unvectorised().count() == 0
    questions = spark.createDataFrame([(1, "what does the blue pump need"), (2, "hi")], "query_id bigint, text string")
    found = {r["query_id"]: r for r in service.query(questions).collect()}
    assert "red engine" in found[1]["answer"] and found[1]["kind"] == "document_search" and found[2]["kind"] == "conversational"
    assert service.compare(questions.where("query_id = 1")).count() >= 1 and service.stored_files().count() == 2
    assert service.chunk_metadata("B.CSV").count() >= 1
    out = service.bulk_questions(questions.withColumnRenamed("text", "question"), f"{tmp_path}/q.csv")
    written = {r["question"]: r for r in spark.read.csv(out, header=True, escape='"', multiLine=True).collect()}
    assert len(written) == 2 and written["hi"]["context"] in (None, "") and written["what does the blue pump need"]["context"].startswith("[Score: ")
    assert all(r["query_time"].endswith("s") and r["retrieval_method"] == "hybrid_rrf" for r in written.values())
    stats = {r["kind"]: r for r in service.query_statistics().collect()}
    assert {k: (r["n"], r["share"]) for k, r in stats.items()} == {"document_search": (1, 0.5), "conversational": (1, 0.5)}
    forced = service.query(questions, weights=(0.1, 0.9), method="hybrid_weighted", force_document_search=True)
    assert [r["kind"] for r in forced.collect()] == ["document_search"] * 2
    judged = service.evaluate(questions.where("query_id = 1")).collect()
    assert len(judged) == 5 and sum(r["best"] for r in judged) == 1 and all(0 < r["agreement"] <= 1 for r in judged)
    assert {x["status"] for x in service.hybrid_health().values()} == {"Available"}
    summary = {r["name"]: r for r in service.upload_summary(f"{tmp_path}/in").collect()}
    assert summary["a.txt"]["success"] and summary["copy.txt"]["success"] and summary["a.txt"]["chunk_count"] > 0
    assert not summary["c.exe"]["success"] and summary["c.exe"]["error"] == "Unsupported file type: .exe"
    assert service.delete("b.csv")["documents"] == 1 and service.list_documents().count() == 1
    with pytest.raises(ValueError, match="between"):
        service.query(questions, 21)
    service.clear()
    assert service.list_documents().count() == 0 and service.health()["documents"]


def test_config():
    assert Config.from_environment({"DOCSPARK_BATCH_SIZE": "7"}).batch_size == 7
    with pytest.raises(ValueError, match="file sizes"):
        Config.from_environment({"DOCSPARK_MIN_FILE_SIZE": "999999999"})
