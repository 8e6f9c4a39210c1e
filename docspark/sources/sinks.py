"""Sinks: collections of vectors with upsert and delete, catalogs, text, JSON and CSV reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.operators.catalog import upsert
from docspark.operators.files import is_kept


class Collection:
    """A vector collection in a folder. Each write makes a new version and then moves the pointer to it,
    so readers see the old rows or the new ones, and a failed write leaves nothing behind in view."""

    def __init__(self, spark: SparkSession, path: str, schema: str = "id bigint, vector array<float>, source string, metadata map<string,string>") -> None:
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def _hadoop(self):  # noqa: ANN202
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(self.spark._jsc.hadoopConfiguration()), root

    def _version(self) -> str | None:
        jvm, fs, root = self._hadoop()
        if not fs.exists(root):
            return None
        names = sorted(s.getPath().getName() for s in fs.listStatus(root) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
        return names[-1] if names else None

    def exists(self) -> bool:
        return self._version() is not None

    def create(self) -> None:
        if not self.exists():
            self._write(self.spark.createDataFrame([], self.schema))

    def read(self) -> DataFrame:
        version = self._version()
        if version is None:
            raise ValueError(f"no collection at {self.path}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{version}")

    def _write(self, rows: DataFrame) -> None:
        old = self._version()
        number = int(old.split("-")[0][1:]) + 1 if old else 0
        rows.write.parquet(f"{self.path}/v{number:08d}-{uuid.uuid4().hex[:8]}")

    def upsert(self, rows: DataFrame) -> None:
        self._write(upsert(self.read(), rows, "id"))

    def delete(self, condition: Column | str) -> int:
        """Rows for which the condition holds go; returns how many. Give values as a Column, never spliced into a text."""
        rows, holds = self.read(), F.expr(condition) if isinstance(condition, str) else condition
        gone = rows.where(holds).count()
        self._write(rows.where(~F.coalesce(holds, F.lit(False))))
        return gone

    def clear(self) -> None:
        self._write(self.spark.createDataFrame([], self.schema))

    def drop(self) -> None:
        _, fs, root = self._hadoop()
        fs.delete(root, True)

    def info(self) -> dict:
        return {"name": self.path.rsplit("/", 1)[-1], "count": self.read().count() if self.exists() else 0, "exists": self.exists()}


def write_csv(rows: DataFrame, path: str, prefix: str = "processed_") -> str:
    """All fields quoted, under a folder with the prefix in its name."""
    head, _, name = path.rstrip("/").rpartition("/")
    out = f"{head}/{prefix}{name}"
    rows.write.option("quoteAll", True).option("escape", '"').csv(out, header=True)
    return out


def write_kept_files(classified: DataFrame, path: str) -> None:
    """The paths of the files that the filter keeps (path, reason), one on each line."""
    classified.where(is_kept(F.col("reason"))).select(F.col("path").alias("value")).write.text(path)


def write_chunk_json(rows: DataFrame, path: str) -> None:
    """One JSON object for each vector: chunk_info, metadata, embedding, processing_info."""
    rows.select("vector_id", F.struct("content", "chunk_id", "filename", F.length("content").alias("chunk_size"), "chunk_index").alias("chunk_info"), F.struct(F.col("filename").alias("source")).alias("metadata"), F.struct(F.col("vector"), F.size("vector").alias("dimension"), F.lit("hashed-words").alias("model")).alias("embedding"), F.struct("document_id").alias("processing_info")).write.json(path)


def write_pages(pages: DataFrame, path: str) -> None:
    """Page texts (doc, page, line), a folder for each document."""
    lines = pages.repartition("doc").sortWithinPartitions("doc", "page")
    lines.select("doc", F.concat(F.lit("=== PAGE "), F.col("page").cast("string"), F.lit(" ===\n"), "line").alias("value")).write.partitionBy("doc").text(path)


def block_report(blocks: DataFrame) -> DataFrame:
    """The columns of a block listing: type, confidence and box to two places, length, a preview on one line."""
    two = lambda c: F.format_string("%.2f", F.col(c).cast("double")).alias(c)
    return blocks.select("page", F.col("pos").alias("block_index"), "block_type", two("confidence"), two("x0"), two("y0"), two("x1"), two("y1"), F.length("text").alias("text_length"), F.regexp_replace(F.substring("text", 1, 100), "\n", " ").alias("text_preview"))


def correction_report(corrected: DataFrame) -> DataFrame:
    """A text for each document: its statistics, then a line for each correction."""
    n = F.size("corrections")
    lines = F.transform("corrections", lambda x: F.format_string("%d: %s -> %s (%s)", x["pos"], x["original"], x["corrected"], x["method"]))
    head = F.format_string("words: %d, corrected: %d, rate: %.4f", "total_words", n, F.coalesce(F.try_divide(n, "total_words"), F.lit(0.0)))
    return corrected.select("doc_id", F.concat_ws("\n", head, F.array_join(lines, "\n")).alias("report"))
