"""Clients, detectors, database and job readers that are plugged in, against plain Python."""

import random
import sqlite3
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docspark.functions import scalars
from docspark.operators import detectors, embedding
from docspark.sources import readers, sinks


def test_call_waits_twice_as_long_each_time():
    waits, left = [], [2]

    def client(text):
        if left[0]:
            left[0] -= 1
            raise OSError("busy")
        return [1.0, 2.0]

    found = embedding.call(client, "a b c", sleep=waits.append)
    assert (found["vector"], found["tokens"], found["retries"], found["error"], waits) == ([1.0, 2.0], 3, 2, None, [1.0, 2.0])
    waits.clear()
    gone = embedding.call(lambda t: [], "a", sleep=waits.append)
    assert gone["vector"] is None and gone["retries"] == 3 and "no embedding" in gone["error"] and waits == [1.0, 2.0, 4.0]


def test_embedding_statistics(spark):
    def factory():
        def client(text):
            if text == "bad":
                raise OSError("no")
            return [float(len(text))] * (3 if text == "odd" else 2)

        return client

    rows = spark.createDataFrame([(1, "two words"), (2, "bad"), (3, None), (4, "  "), (5, "odd")], "id int, t string")
    done = rows.select("id", embedding.embed_by(F.col("t"), factory, delay=0.0).alias("embedded"))
    found = {r["id"]: r["embedded"] for r in done.collect()}
    assert found[1]["vector"] == [9.0, 9.0] and found[2]["error"] == "OSError: no" and found[3] is None and found[4] is None
    s = embedding.embedding_statistics(done, 2).first()
    assert (s["total_embeddings"], s["total_tokens"], s["errors"], s["retries"], s["odd_dimensions"], s["success_rate"], s["avg_tokens"]) == (2, 3, 1, 3, 1, 0.5, 1.5)
    none = embedding.embedding_statistics(done.where("false")).first()
    assert none["total_embeddings"] == 0 and none["success_rate"] == 0 and none["avg_time"] == 0


def test_detectors(spark):
    def fails(name, data):
        raise ImportError("gone")

    def boxes(name, data):
        return [{"page": 2, "kind": "TABLE", "text": "x" * 300, "confidence": 0.7}, {"page": 1, "kind": "TABLE", "text": None}, {"page": 1, "text": "A plain line of text that ends here.", "y0": 0.0, "y1": 9.0}]

    files = spark.createDataFrame([("a", b"one\n\ntwo"), ("b", b""), ("c", None)], "name string, content binary")
    found = detectors.detect(files, {"boxes": boxes, "gone": fails, "second": detectors.first_that_works(fails, detectors.text_blocks), "none": detectors.first_that_works(fails, fails)})
    rows = {(r["name"], r["library"]): r for r in found.collect()}
    assert len(rows) == 12 and rows["a", "gone"]["error"] == rows["a", "none"]["error"] == "ImportError: gone" and not rows["a", "gone"]["success"]
    assert [b["text"] for b in rows["a", "second"]["blocks"]] == ["one", "two"] and rows["c", "second"]["blocks"] == []
    assert all(b["kind"] and b["confidence"] is not None for b in rows["a", "boxes"]["blocks"])
    by = {r["library"]: r for r in detectors.compare_detectors(found).collect()}
    assert (by["boxes"]["n_blocks"], by["boxes"]["with_text"], by["gone"]["successful"], by["gone"]["text_rate"], by["gone"]["kinds"]) == (9, 6, 0, 0.0, [])
    tables = {(r["name"], r["library"]): r for r in detectors.compare_tables(found).collect()}["a", "boxes"]
    assert tables["total_tables"] == 2 and tables["table_pages"] == [1, 2] and tables["table_details"][0]["text_preview"] == "x" * 200 + "..."


def test_loose_dates_as_strptime_reads_them(spark):
    random.seed(5)
    raws = ["D:2024013123", "D:", "", "2024", "D:20240131235960", "D:20230229101010", "D:2024 1 1", "D:00000101010101", "D:202401312359591+02"]
    raws += ["D:" + "".join(random.choice("0123456789"[: random.choice((3, 6, 10))]) for _ in range(random.randint(4, 16))) for _ in range(2000)]
    raws += [f"D:{random.randint(1900, 2100)}{random.randint(1, 12)}{random.randint(1, 31)}{random.randint(0, 23)}{random.randint(0, 59)}{random.randint(0, 59)}" for _ in range(1000)]

    def expected(raw):
        try:
            return datetime.strptime(raw[2:16], "%Y%m%d%H%M%S").isoformat(" ") if raw.startswith("D:") else None
        except ValueError:
            return None

    rows = spark.createDataFrame([(r,) for r in raws] + [(None,)], "raw string")
    found = rows.select("raw", F.date_format(scalars.pdf_date_loose(F.col("raw")), "yyyy-MM-dd HH:mm:ss").alias("at")).collect()
    wrong = [(r["raw"], r["at"], expected(r["raw"])) for r in found if r["raw"] is not None and r["at"] != expected(r["raw"])]
    assert not wrong, wrong[:5]
    assert sum(r["at"] is not None for r in found) > 200


def test_times(spark, tmp_path):
    (tmp_path / "a b.txt").write_text("x")
    at = F.lit("2024-05-06 07:08:09").cast("timestamp")
    rows = spark.createDataFrame([(f"file:{str(tmp_path).replace(' ', '%20')}/a%20b.txt", "12.5"), ("s3a://bucket/x", "x"), (None, None)], "path string, v string")
    found = rows.select(scalars.creation_time(F.col("path"), at).alias("made"), scalars.epoch_or_now(F.col("v"), at).cast("double").alias("v")).collect()
    assert found[0]["made"].year >= 2025 and found[1]["made"] == found[2]["made"] != found[0]["made"]
    assert found[0]["v"] == 12.5 and found[1]["v"] == found[2]["v"] > 1e9


def test_sqlite_and_jdbc_chunks(spark, tmp_path):
    path = f"{tmp_path}/store.db"
    db = sqlite3.connect(path)
    db.execute("CREATE TABLE chunks (chunk_id TEXT, content TEXT, filename TEXT, page_number INTEGER, other BLOB)")
    db.executemany("INSERT INTO chunks VALUES (?, ?, ?, ?, ?)", [(f"c{k}", None if k == 3 else f"text {k}", "f", k, b"") for k in range(100)])
    db.execute("CREATE TABLE unfilled (chunk_id TEXT, content TEXT, filename TEXT)")
    db.commit()
    db.close()
    rows = readers.read_chunks_sqlite(spark, path)
    assert rows.columns == ["chunk_id", "content", "filename", "page_number"] and rows.count() == 100 and rows.rdd.getNumPartitions() > 1
    assert rows.where("chunk_id = 'c3'").first()["content"] is None and rows.agg(F.sum("page_number")).first()[0] == 4950
    assert readers.read_chunks_sqlite(spark, path, limit=7).count() == 7 and readers.read_chunks_sqlite(spark, path, "unfilled").count() == 0
    with pytest.raises(Exception, match="does not exist"):
        readers.read_chunks_sqlite(spark, path, "absent").count()
    url = f"jdbc:derby:{tmp_path}/derby;create=true"
    rows.select(F.col("page_number").alias("chunk_index"), F.col("filename"), F.coalesce("content", F.lit("")).alias("content"), "chunk_id", F.lit(1).alias("z")).write.format("jdbc").options(url=url, dbtable="chunks").save()
    found = readers.read_chunks_jdbc(spark, url, split=("CHUNK_INDEX", 0, 99, 4))
    assert found.columns == ["chunk_id", "content", "filename", "chunk_index"] and found.count() == 100 and found.rdd.getNumPartitions() == 4


def test_ocr_job_and_kept_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert readers.ocr_directory(spark, f"{tmp_path}/in", lambda x: ("", 0), f"{tmp_path}/no").first()["error"] == "No PDF files found"
    for name, data in (("a.pdf", b"abc"), ("b.pdf", b"bad"), ("c.txt", b"zzz")):
        (tmp_path / "in" / name).write_bytes(data)

    def read(data):
        if data == b"bad":
            raise ValueError("broken")
        return data.decode() * 2, 3

    s = readers.ocr_directory(spark, f"{tmp_path}/in", read, f"{tmp_path}/out", {"dpi": "300"}).first()
    assert (s["total_files"], s["successful_files"], s["total_pages_processed"], s["total_characters_extracted"], s["ocr_settings"]) == (2, 1, 3, 6, '{"dpi":"300"}')
    assert [tuple(r) for r in spark.read.json(f"{tmp_path}/out/texts").select("file", "text").collect()] == [("a_ocr_extracted.txt", "abcabc")]
    assert {r["name"]: r["success"] for r in spark.read.json(f"{tmp_path}/out/files").collect()} == {"a.pdf": True, "b.pdf": False}
    kept = spark.createDataFrame([("/x/a.pdf", "passed_all_checks"), ("/x/b.pdf", "too_small"), ("/x/c d.pdf", "important_file")], "path string, reason string")
    sinks.write_kept_files(kept, f"{tmp_path}/kept")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/kept").collect()) == ["/x/a.pdf", "/x/c d.pdf"]


def test_compared_detectors_run_once_a_file(spark):
    calls = spark.sparkContext.accumulator(0)

    def two(name, data):
        calls.add(1)
        if name == "b":
            raise ValueError("bad")
        return [{"kind": "X", "text": " "}, {"text": "| a | b |\n| c | d |", "other": 1}, {"kind": "X"}]

    files = spark.createDataFrame([("a", b"x"), ("b", b"y"), (None, None)], "name string, content binary")
    found = {r["library"]: r for r in detectors.compare_detectors(detectors.detect(files, {"two": two, "empty": lambda *_: []})).collect()}
    assert calls.value == 3
    assert (found["two"]["files"], found["two"]["successful"], found["two"]["n_blocks"], found["two"]["with_text"], found["two"]["kinds"]) == (3, 2, 6, 2, ["TABLE", "X"])
    assert tuple(found["empty"][k] for k in ("files", "successful", "n_blocks", "with_text", "text_rate", "kinds")) == (3, 3, 0, 0, 0.0, [])
