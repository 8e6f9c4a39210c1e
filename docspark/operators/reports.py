"""Queries over sources and sinks: page markers, decoding, reports, collection writes read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.layout import block_confidence, blocks
from docspark.operators.spelling import correct_contextual, terminology
from docspark.plans.fixtures import load
from docspark.registry import query
from docspark.sources.readers import extract_text, ocr_pages, page_markers
from docspark.sources.sinks import block_report, correction_report

c = F.col


@query("source_decode_text", "SELECT doc_id, md5(text) AS text_md5, 'txt' AS ext FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    """Texts written as UTF-8 or Latin-1 bytes come back the same, where Latin-1 can hold them."""
    latin = (c("doc_id") % 2 == 0) & ~c("text").rlike(r"[^\x00-\xFF]")
    content = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    rows = load(s, d, "documents").select("doc_id", F.lit("a.txt").alias("name"), F.lit("txt").alias("ext"), content.alias("content"))
    return rows.select("doc_id", F.md5(extract_text(c("name"), c("ext"), c("content"))["text"]).alias("text_md5"), "ext")


@query("source_csv_text", "SELECT doc_id, '=== CSV: t.csv ===' || chr(10) || 'lang' || chr(9) || 'source' || chr(9) || 'note' || chr(10) || lang || chr(9) || source AS text FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    content = F.encode(F.concat(F.lit("lang,source,note\n"), c("lang"), F.lit(","), c("source"), F.lit(",\n")), "UTF-8")
    rows = load(s, d, "documents").select("doc_id", content.alias("content"))
    return rows.select("doc_id", extract_text(F.lit("t.csv"), F.lit("csv"), c("content"))["text"].alias("text"))


@query("source_unsupported", "SELECT doc_id, 'Unsupported file type: .' || lang AS text FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "documents").select("doc_id", "lang", F.lit(b"x").alias("content"))
    return rows.select("doc_id", extract_text(F.lit("f"), c("lang"), c("content"))["text"].alias("text"))


@query("source_page_markers", "SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda t, i: CASE WHEN trim(t) <> '' THEN '=== PAGE ' || i || ' ===' || chr(10) || t END), lambda x: x IS NOT NULL), chr(10) || chr(10))) AS marked_md5 FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", F.md5(page_markers(F.split("text", "\n"))).alias("marked_md5"))


@query("source_ocr_pages")
def _(s: SparkSession, d: str) -> DataFrame:
    """Engines tried in turn on the pages; the stand-ins read text bytes, one only those of even length."""
    pages = load(s, d, "documents").select(c("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("k", "line"))
    pages = pages.select("doc", (c("k") + 1).alias("page"), F.encode("line", "UTF-8").alias("image"))
    engines = (lambda x: "" if len(x) % 2 else x.decode(), lambda x: x.decode().upper())
    return ocr_pages(pages, engines)


@query("report_blocks", "SELECT count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) FROM documents)")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = blocks(s, d).withColumn("confidence", block_confidence(c("block_type")))
    return block_report(rows).agg(F.count("text_length").alias("n"))


@query("report_corrections")
def _(s: SparkSession, d: str) -> DataFrame:
    return correction_report(correct_contextual(load(s, d, "documents").select("doc_id", "text"), terminology(s)))


@query("report_sources", "SELECT source, count(*) AS n, sum(length(text))::BIGINT AS total_chars, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids FROM documents GROUP BY source")
def _(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("total_chars"), F.array_join(F.sort_array(F.collect_list("doc_id")).cast("array<string>"), ",").alias("ids"))
