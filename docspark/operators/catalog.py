"""Catalog analytics and writes: statistics, joins, audits, queues, upserts, deletes, stage pairing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.plans.fixtures import CHUNKS_SQL, DOCUMENTS_SQL, chunks, documents, load
from docspark.registry import query

c = F.col


# --- operators -------------------------------------------------------------------------------------------


def catalog_stats(docs: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    """Totals of documents and chunks. Pending is 0 where nothing is vectorised yet, as it always was."""
    per_chunk = chunk_rows.agg(F.count("*").alias("total_chunks"), F.count_if("vectorized").alias("vectorized_chunks"), F.round(F.avg("chunk_size"), 2).alias("avg_chunk_size"))
    both = docs.agg(F.count("*").alias("total_documents")).crossJoin(per_chunk)  # one row each
    return both.withColumn("pending_chunks", F.when(c("vectorized_chunks") > 0, c("total_chunks") - c("vectorized_chunks")).otherwise(F.lit(0)))


def documents_summary(docs: DataFrame, chunk_rows: DataFrame) -> DataFrame:
    counts = chunk_rows.groupBy("document_id").agg(F.count("*").alias("chunk_count"), F.count_if("vectorized").alias("vectorized_chunks"))
    joined = docs.join(counts, docs.id == counts.document_id, "left")
    return joined.select("id", "filename", "file_type", "created_at", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("vectorized_chunks", F.lit(0)).alias("vectorized_chunks"))


def unvectorized_queue(docs: DataFrame, chunk_rows: DataFrame, limit: int) -> DataFrame:
    waiting = chunk_rows.where(~c("vectorized")).select("document_id", "chunk_index", "chunk_text")
    return waiting.join(docs.select(c("id").alias("document_id"), "filename"), "document_id").orderBy("document_id", "chunk_index").limit(limit)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key it doesn't have. Both keep their own columns' order."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*new.columns).unionByName(new)


def insert_or_get(stored: DataFrame, arriving: DataFrame) -> DataFrame:
    """For each arriving document the id under which its content is stored: the first stored one's, or its own."""
    known = stored.groupBy("content_hash").agg(F.min("id").alias("stored_id"))
    first = arriving.groupBy("content_hash").agg(F.min("id").alias("first_id"))
    joined = arriving.join(known, "content_hash", "left").join(first, "content_hash")
    return joined.select("id", F.coalesce("stored_id", "first_id").alias("kept_id"), (c("stored_id").isNull() & (c("first_id") == c("id"))).alias("inserted"))


def delete_documents(docs: DataFrame, chunk_rows: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents and chunks that stay when the documents in ``doomed`` (id) go, chunks with them."""
    return docs.join(doomed, "id", "left_anti"), chunk_rows.join(doomed.withColumnRenamed("id", "document_id"), "document_id", "left_anti")


def pair_stages(log: DataFrame) -> DataFrame:
    """Starts of stages with what completed them. ``log`` has document_id, stage, at, event_id and a status, ``started`` or else.

    A completion closes all open starts of its document and stage, so a start belongs to the first completion after it, whatever
    starts or completions are missing or come twice; a start without one stays open (completed_at and success are null).
    """
    done = c("status") != "started"
    back = Window.partitionBy("document_id", "stage").orderBy(F.desc("at"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    closing = F.last(F.when(done, F.struct("at", "status")), ignorenulls=True).over(back)
    starts = log.withColumn("closing", closing).where(~done)
    return starts.select("document_id", "stage", c("at").alias("started_at"), "event_id", c("closing.at").alias("completed_at"), (c("closing.status") == "succeeded").alias("success"))


def file_rollup(chunk_rows: DataFrame) -> DataFrame:
    size = F.when(F.length("chunk_text") > 0, F.length("chunk_text"))
    return chunk_rows.groupBy("filename").agg(F.count("*").alias("n_chunks"), F.array_join(F.sort_array(F.collect_list("chunk_index")).cast("array<string>"), ",").alias("indices"), F.round(F.avg(size), 4).alias("avg_len"), F.sum(size).alias("sum_len"), F.max("created_at").alias("last_at"))


def duplicate_audit(chunk_rows: DataFrame) -> DataFrame:
    return chunk_rows.agg(F.count("*").alias("total"), F.countDistinct("chunk_text").alias("distinct_texts"), F.countDistinct(F.when(c("vectorized"), c("vector_id"))).alias("distinct_vectors"))


def duplicate_groups(chunk_rows: DataFrame) -> DataFrame:
    return chunk_rows.groupBy(F.md5("chunk_text").alias("text_md5")).agg(F.count("*").alias("n"), F.min("document_id").alias("first_document")).where("n > 1")


def metadata_filter(chunk_rows: DataFrame, name_part: str = "", limit: int = 10, vector_id: int | str | None = None) -> DataFrame:
    """Chunks whose file name holds a text, whatever its case, or those of one vector, with the number of all such chunks."""
    found = chunk_rows.where(F.contains(F.lower(F.coalesce("filename", F.lit("unknown"))), F.lit(name_part.lower())))
    if vector_id is not None:
        found = found.where(c("vector_id").cast("string") == F.lit(str(vector_id)))
    total = found.agg(F.count("*").alias("total_chunks"))
    top = found.orderBy("document_id", "chunk_index").limit(limit).select("document_id", "chunk_index", "filename")
    return top.join(F.broadcast(total))  # a single row


# --- queries ---------------------------------------------------------------------------------------------


@query("catalog_stats", f"""WITH {CHUNKS_SQL}
SELECT *, CASE WHEN vectorized_chunks > 0 THEN total_chunks - vectorized_chunks ELSE 0 END AS pending_chunks FROM
(SELECT (SELECT count(*) FROM cat) AS total_documents, count(*) AS total_chunks, count(*) FILTER (vectorized) AS vectorized_chunks, round(avg(chunk_size), 2) AS avg_chunk_size FROM chunks)""")
def _(s: SparkSession, d: str) -> DataFrame:
    return catalog_stats(documents(s, d), chunks(s, d))


@query("catalog_type_histogram", "SELECT lang AS file_type, count(*) AS n FROM documents GROUP BY lang ORDER BY n DESC, file_type")
def _(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").groupBy(c("lang").alias("file_type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_type")


@query("catalog_documents_summary", f"""WITH {CHUNKS_SQL}
SELECT id, cat.filename, file_type, cat.created_at, count(chunk_index) AS chunk_count, count(*) FILTER (vectorized) AS vectorized_chunks
FROM cat LEFT JOIN chunks ON document_id = id GROUP BY ALL""")
def _(s: SparkSession, d: str) -> DataFrame:
    return documents_summary(documents(s, d), chunks(s, d))


@query("catalog_unvectorized_queue", f"""WITH {CHUNKS_SQL}
SELECT document_id, chunk_index, chunk_text, cat.filename FROM chunks JOIN cat ON id = document_id WHERE NOT vectorized ORDER BY document_id, chunk_index LIMIT 50""")
def _(s: SparkSession, d: str) -> DataFrame:
    return unvectorized_queue(documents(s, d), chunks(s, d), 50)


@query("catalog_duplicate_audit", f"""WITH {CHUNKS_SQL}
SELECT count(*) AS total, count(DISTINCT chunk_text) AS distinct_texts, count(DISTINCT vector_id) FILTER (vectorized) AS distinct_vectors FROM chunks""")
def _(s: SparkSession, d: str) -> DataFrame:
    return duplicate_audit(chunks(s, d))


@query("catalog_duplicate_groups", f"""WITH {CHUNKS_SQL}
SELECT md5(chunk_text) AS text_md5, count(*) AS n, min(document_id) AS first_document FROM chunks GROUP BY 1 HAVING count(*) > 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    return duplicate_groups(chunks(s, d))


@query("catalog_distinct_sample", "SELECT DISTINCT source, lang FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("source", "lang").distinct()


@query("catalog_file_rollup", f"""WITH {CHUNKS_SQL}
SELECT filename, count(*) AS n_chunks, string_agg(chunk_index::VARCHAR, ',' ORDER BY chunk_index) AS indices, round(avg(length(chunk_text)), 4) AS avg_len, sum(length(chunk_text))::BIGINT AS sum_len, max(created_at) AS last_at
FROM chunks GROUP BY filename""")
def _(s: SparkSession, d: str) -> DataFrame:
    return file_rollup(chunks(s, d))


@query("catalog_chunk_size_stats", f"""WITH {CHUNKS_SQL}
SELECT count(*) AS n, round(avg(chunk_size), 4) AS avg_size, min(chunk_size) AS min_size, max(chunk_size) AS max_size FROM chunks""")
def _(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).agg(F.count("*").alias("n"), F.round(F.avg("chunk_size"), 4).alias("avg_size"), F.min("chunk_size").alias("min_size"), F.max("chunk_size").alias("max_size"))


@query("catalog_chunks_by_vector", f"""WITH {CHUNKS_SQL}, v AS (SELECT max(vector_id) AS v FROM chunks), f AS (SELECT * FROM chunks, v WHERE vector_id = v)
SELECT document_id, chunk_index, filename, (SELECT count(*) FROM f) AS total_chunks FROM f ORDER BY 1, 2 LIMIT 10""")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = chunks(s, d)
    return metadata_filter(rows, vector_id=rows.agg(F.max("vector_id")).first()[0])


@query("catalog_metadata_filter", f"""WITH {CHUNKS_SQL}, f AS (SELECT * FROM chunks WHERE contains(lower(filename), 'src1/'))
SELECT document_id, chunk_index, filename, (SELECT count(*) FROM f) AS total_chunks FROM f ORDER BY document_id, chunk_index LIMIT 100""")
def _(s: SparkSession, d: str) -> DataFrame:
    return metadata_filter(chunks(s, d), "SRC1/", 100)


@query("catalog_point_lookup", f"""WITH {DOCUMENTS_SQL}
SELECT id, filename, content_hash FROM cat WHERE filename = 'src7/doc_7.docx' OR content_hash = (SELECT content_hash FROM cat WHERE id = 3)""")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = documents(s, d)
    wanted = F.broadcast(docs.where("id = 3").select(c("content_hash").alias("wanted")))
    found = docs.join(wanted, c("content_hash") == c("wanted"), "left").where((c("filename") == "src7/doc_7.docx") | c("wanted").isNotNull())
    return found.select("id", "filename", "content_hash")


#: Chunks that are vectorised are stored; of all documents the last, shorter chunks arrive again, whole.
_POINTS = f"""WITH {CHUNKS_SQL}, p AS (SELECT document_id * 100000 + chunk_index AS id, chunk_text AS payload, vectorized, chunk_size FROM chunks),
new AS (SELECT id, 'new ' || payload AS payload FROM p WHERE chunk_size < 1000), old AS (SELECT id, payload FROM p WHERE vectorized)
SELECT * FROM new UNION ALL SELECT * FROM old WHERE id NOT IN (SELECT id FROM new)"""
for _name in ("catalog_upsert_points", "catalog_upsert_all_points"):

    @query(_name, _POINTS)
    def _(s: SparkSession, d: str) -> DataFrame:
        rows = chunks(s, d).select("vectorized", "chunk_size", (c("document_id") * 100000 + c("chunk_index")).alias("id"), c("chunk_text").alias("payload"))
        return upsert(rows.where("vectorized").select("id", "payload"), rows.where("chunk_size < 1000").select("id", F.concat(F.lit("new "), "payload").alias("payload")), "id")


@query("catalog_insert_or_get", f"""WITH {DOCUMENTS_SQL}, stored AS (SELECT content_hash, min(id) AS stored_id FROM cat WHERE id % 2 = 0 GROUP BY 1),
arriving AS (SELECT id, content_hash, min(id) OVER (PARTITION BY content_hash) AS first_id FROM cat WHERE id % 2 = 1)
SELECT id, coalesce(stored_id, first_id) AS kept_id, stored_id IS NULL AND first_id = id AS inserted FROM arriving LEFT JOIN stored USING (content_hash)""")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = documents(s, d).select("id", "content_hash")
    return insert_or_get(docs.where("id % 2 = 0"), docs.where("id % 2 = 1"))


@query("catalog_mark_vectorized", f"""WITH {CHUNKS_SQL}
SELECT document_id, chunk_index, vectorized OR document_id % 5 = 0 AS vectorized FROM chunks""")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = chunks(s, d)
    done = rows.where("document_id % 5 = 0").select("document_id", "chunk_index", F.lit(True).alias("done"))
    return rows.join(done, ["document_id", "chunk_index"], "left").select("document_id", "chunk_index", (c("vectorized") | F.coalesce("done", F.lit(False))).alias("vectorized"))


@query("catalog_delete_cascade", f"""WITH {CHUNKS_SQL}
SELECT 'documents' AS kind, count(*) AS left_rows FROM cat WHERE source <> 'src3' UNION ALL
SELECT 'chunks', count(*) FROM chunks JOIN cat ON id = document_id WHERE source <> 'src3'""")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = documents(s, d)
    kept, chunk_rows = delete_documents(docs, chunks(s, d), docs.where("source = 'src3'").select("id"))
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("left_rows"))
    return count(kept, "documents").union(count(chunk_rows, "chunks"))


@query("catalog_retention_delete", f"""WITH {DOCUMENTS_SQL} SELECT id, created_at FROM cat WHERE created_at >= TIMESTAMP '2024-01-31' - INTERVAL 20 DAY""")
def _(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).where("created_at >= timestamp'2024-01-31 00:00:00' - interval 20 days").select("id", "created_at")


@query("catalog_delete_by_source", "SELECT count(*) FILTER (source <> 'src2') AS kept, count(*) FILTER (source = 'src2') AS deleted FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").agg(F.count_if(c("source") != "src2").alias("kept"), F.count_if(c("source") == "src2").alias("deleted"))


@query("catalog_stage_pairs", """WITH l AS (SELECT user_id AS document_id, event_type AS stage, ts AS at, event_id, CASE WHEN event_id % 5 < 3 THEN 'started' WHEN event_id % 7 = 0 THEN 'failed' ELSE 'succeeded' END AS status FROM events)
SELECT a.document_id, a.stage, a.at AS started_at, a.event_id, min(b.at) AS completed_at, arg_min(b.status, (b.at, b.event_id)) = 'succeeded' AS success
FROM l a LEFT JOIN l b ON a.document_id = b.document_id AND a.stage = b.stage AND b.status <> 'started' AND (b.at, b.event_id) > (a.at, a.event_id) WHERE a.status = 'started' GROUP BY ALL""")
def _(s: SparkSession, d: str) -> DataFrame:
    status = F.when(c("event_id") % 5 < 3, "started").when(c("event_id") % 7 == 0, "failed").otherwise("succeeded")
    return pair_stages(load(s, d, "events").select(c("user_id").alias("document_id"), c("event_type").alias("stage"), c("ts").alias("at"), "event_id", status.alias("status")))


@query("catalog_stage_log_join", """SELECT event_type AS stage, lang, count(*) AS n, round(avg(value), 4) AS avg_value FROM events JOIN documents ON doc_id = user_id GROUP BY 1, 2""")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = load(s, d, "documents").select(c("doc_id").alias("user_id"), "lang")
    return load(s, d, "events").join(docs, "user_id").groupBy(c("event_type").alias("stage"), "lang").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value"))


@query("catalog_json_roundtrip", """SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events""")
def _(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("catalog_running_stats", """SELECT event_type, count(*) AS n, round(avg(value), 4) AS avg_value, round(min(value), 4) AS min_value, round(max(value), 4) AS max_value, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM events GROUP BY event_type""")
def _(s: SparkSession, d: str) -> DataFrame:
    by = load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), *[F.round(f("value"), 4).alias(f"{n}_value") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])
    return by.withColumn("pct", F.round(F.lit(100.0) * c("n") / F.sum("n").over(Window.partitionBy()), 4))


@query("catalog_success_rates", """SELECT event_type, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS success_rate, round(avg(CASE WHEN value > 50 THEN value END), 4) AS avg_speed FROM events GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    good = c("value") > 50
    return load(s, d, "events").groupBy("event_type").agg(F.round(F.avg(F.when(good, 1.0).otherwise(0.0)), 6).alias("success_rate"), F.round(F.avg(F.when(good, c("value"))), 4).alias("avg_speed"))


@query("catalog_argmax", """SELECT arg_max(lib, (speed, lib)) AS fastest, arg_max(lib, (chars, lib)) AS most_text FROM
(SELECT source AS lib, avg(n_chars) AS speed, sum(n_chars) AS chars FROM documents GROUP BY 1)""")
def _(s: SparkSession, d: str) -> DataFrame:
    per = load(s, d, "documents").groupBy(c("source").alias("lib")).agg(F.avg("n_chars").alias("speed"), F.sum("n_chars").alias("chars"))
    return per.agg(F.max_by("lib", F.struct("speed", "lib")).alias("fastest"), F.max_by("lib", F.struct("chars", "lib")).alias("most_text"))


@query("catalog_batch_summary", """SELECT count(*) AS total, count(*) FILTER (n_chars > 500) AS successful, count(*) FILTER (n_chars <= 500) AS failed FROM documents""")
def _(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").agg(F.count("*").alias("total"), F.count_if(c("n_chars") > 500).alias("successful"), F.count_if(c("n_chars") <= 500).alias("failed"))


@query("catalog_json_chunk_scan", f"""WITH {CHUNKS_SQL} SELECT md5(chunk_text) AS content_md5, count(*) AS n FROM chunks GROUP BY 1 HAVING count(*) > 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Chunk JSON with the content at one of three places, as stored by different writers."""
    rows = chunks(s, d)
    k = c("document_id") % 3
    text = F.when(k == 0, F.to_json(F.struct(c("chunk_text").alias("content")))).when(k == 1, F.to_json(F.struct(F.struct(c("chunk_text").alias("content")).alias("chunk_info")))).otherwise(F.to_json(F.struct(F.struct(c("chunk_text").alias("content")).alias("metadata"))))
    read = rows.select(F.from_json(text, "content string, chunk_info struct<content:string>, metadata struct<content:string>").alias("j"))
    return read.groupBy(F.md5(F.coalesce("j.content", "j.chunk_info.content", "j.metadata.content")).alias("content_md5")).agg(F.count("*").alias("n")).where("n > 1")
