"""Streams with keyed state: restarts, late completions, what is stored already; jobs that observe themselves."""

import datetime as dt

from pyspark.sql import functions as F

from docspark.api import Service
from docspark.operators import catalog, embedding
from docspark.sources.sinks import Collection
from docspark.streaming import jobs

DOCS = "id bigint, text string"
LOG = "document_id bigint, stage string, at timestamp, event_id bigint, status string"


def run(frame, path, name):
    """All that waits is taken; what comes out is appended to a table."""
    q = frame.writeStream.format("parquet").option("checkpointLocation", f"{path}/check-{name}").option("path", f"{path}/out-{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)


def test_uploads_against_the_stored_set_with_a_restart(spark, tmp_path):
    add = lambda rows: spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stored = spark.createDataFrame([(7, "old"), (5, "old"), (8, "other")], DOCS).select("id", F.sha2("text", 256).alias("content_hash"))
    start = lambda: run(jobs.upload_decisions(jobs.stream(spark, f"{tmp_path}/in", DOCS), stored), tmp_path, "uploads")
    add([(20, "new"), (21, "old"), (22, "new"), (23, None)])
    start()
    add([(30, "new"), (31, "fresh"), (32, "")])
    start()
    found = {r["id"]: (r["kept_id"], r["inserted"]) for r in spark.read.parquet(f"{tmp_path}/out-uploads").collect()}
    assert found == {20: (20, True), 21: (5, False), 22: (20, False), 23: (23, True), 30: (20, False), 31: (31, True), 32: (23, False)}


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_stages_end_late_or_never_with_a_restart(spark, tmp_path):
    rows = [
        [(1, "chunk", at(0), 1, "started"), (1, "embed", at(1), 2, "started"), (2, "chunk", at(2), 3, "started"), (3, "chunk", at(3), 4, "started")],
        [(1, "chunk", at(5), 5, "succeeded"), (2, "chunk", at(4), 6, "started"), (2, "chunk", at(6), 7, "failed"), (9, "clock", at(200), 8, "started")],
        [(1, "embed", at(210), 9, "succeeded"), (9, "clock", at(400), 10, "succeeded"), (9, "clock", at(401), 11, "started"), (9, "clock", at(2000), 12, "started")],
        [(3, "chunk", at(2100), 13, "succeeded"), (9, "clock", at(9000), 14, "succeeded")],
        [(9, "clock", at(20000), 15, "started")],
    ]
    for part in rows:
        spark.createDataFrame(part, LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(jobs.stage_pairs(jobs.stream(spark, f"{tmp_path}/in", LOG), patience=3_600_000, memory=86_400_000), tmp_path, "stages")
    found = {(r["event_id"], r["state"]): (r["started_at"], r["completed_at"], r["success"]) for r in spark.read.parquet(f"{tmp_path}/out-stages").where("stage <> 'clock'").collect()}
    assert found == {
        (1, "completed"): (at(0), at(5), True),
        (3, "completed"): (at(2), at(6), False),
        (6, "completed"): (at(4), at(6), False),
        (2, "stalled"): (at(1), None, None),
        (2, "late"): (at(1), at(210), True),
        (4, "stalled"): (at(3), None, None),  # completed after a day, when it was forgotten
    }
    log = spark.read.parquet(f"{tmp_path}/in").where("stage <> 'clock' and event_id <> 13")
    batch = {r["event_id"]: (r["started_at"], r["completed_at"], r["success"]) for r in catalog.pair_stages(log).collect() if r["completed_at"]}
    assert batch == {k: v for (k, state), v in found.items() if state != "stalled"}


def test_pending_chunks_that_are_stored_are_skipped(spark, tmp_path):
    schema = "id bigint, content string, source string, vectorized boolean"
    store = Collection(spark, f"file://{tmp_path}/store")
    store.create()
    spark.createDataFrame([(1, "one two", "s", False), (2, "", "s", False), (3, "three", "s", True)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    jobs.embed_pending(jobs.stream(spark, f"{tmp_path}/in", schema), store, f"{tmp_path}/check").awaitTermination(120)
    spark.createDataFrame([(1, "changed", "t", False), (4, "four", "s", False), (4, "four", "s", False)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    jobs.embed_pending(jobs.stream(spark, f"{tmp_path}/in", schema), store, f"{tmp_path}/check").awaitTermination(120)
    assert sorted((r["id"], r["source"]) for r in store.read().collect()) == [(1, "s"), (4, "s")]
    assert sorted((r["batch"], r["chunks"], r["failed"]) for r in spark.read.parquet(f"{tmp_path}/check-counts").collect()) == [(0, 2, 1), (1, 1, 0)]


def test_a_job_that_embeds_observes_itself(spark, tmp_path):
    calls = f"{tmp_path}/calls"

    def factory():
        def client(text):
            with open(calls, "a") as out:
                out.write(".")
            if text.startswith("bad"):
                raise ConnectionError
            return [1.0, 2.0]

        return client

    rows = spark.createDataFrame([(1, "a b c"), (2, "bad one"), (3, None), (4, "d")], "id int, content string").repartition(2)
    done, totals = embedding.embedded_once(rows, factory, retries=1, delay=0.0, dimension=3)
    assert {k: totals[k] for k in ("total_embeddings", "total_tokens", "errors", "retries", "odd_dimensions", "avg_tokens", "success_rate")} == {"total_embeddings": 2, "total_tokens": 4, "errors": 1, "retries": 1, "odd_dimensions": 2, "avg_tokens": 2.0, "success_rate": 0.5}
    assert done.where("embedded.vector is not null").count() == 2 and done.count() == 4 and len(open(calls).read()) == 4  # no second pass
    none, totals = embedding.embedded_once(rows.limit(0), factory)
    assert none.count() == 0 and totals["success_rate"] == 0.0 and totals["total_embeddings"] == 0


def test_uploads_observe_what_they_read(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for name, text in (("a.txt", "some text here"), ("b.txt", "   "), ("c.docx", "no zip")):
        (tmp_path / "files" / name).write_text(text)
    service = Service(spark, f"file://{tmp_path}/store")
    assert service.upload(f"file://{tmp_path}/files", vectorise=False).count() == 1
    assert service.observed["upload"] == {"files": 3, "failed": 1, "without_text": 1}
    assert service.vectorise_pending() == 1 and service.observed["vectorise"] == {"chunks": 1, "vectors": 1} and service.vectorise_pending() == 0
