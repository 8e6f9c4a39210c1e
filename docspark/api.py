"""The service surface as plain functions over a store: upload, list, delete, vectorise, query, bulk answers, statistics."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from docspark.operators.catalog import catalog_stats, file_rollup, metadata_filter
from docspark.operators.correctors import correct_conservative
from docspark.operators.files import MOST, UPLOADS
from docspark.operators.search import embed
from docspark.operators.sparse import tokenise
from docspark.plans import flows
from docspark.scratch import written
from docspark.sources.readers import PARSERS, extract_text, list_files
from docspark.sources.sinks import Collection, write_csv

c = F.col
METHODS = ("dense_only", "sparse_only", "hybrid_rrf", "hybrid_weighted", "hybrid_borda")
#: How sure an answer is that no found text stands behind. ``failed`` is what a bulk answer gets where there is none.
CONFIDENCE = {"failed": 0.1, "nothing_found": 0.3, "nothing_found_fallback": 0.2, "conversational_fallback": 0.8}
DOCUMENTS = "id bigint, filename string, file_type string, file_size bigint, content_hash string, raw_text string, created_at timestamp"
CHUNKS = "id bigint, document_id bigint, chunk_index int, chunk_id string, content string, filename string, vectorized boolean, vector array<float>, created_at timestamp"


@dataclass
class Service:
    """Documents and chunks as two collections in one folder."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.observed: dict[str, dict] = {}  # counts of the last upload and the last embedding, from the jobs themselves
        self.documents = Collection(self.spark, f"{self.path}/documents", DOCUMENTS)
        self.chunks = Collection(self.spark, f"{self.path}/chunks", CHUNKS)
        self.documents.create()
        self.chunks.create()

    def health(self) -> dict:
        return {"status": "healthy", "documents": self.documents.exists(), "chunks": self.chunks.exists()}

    def upload(self, folder: str, vectorise: bool = True) -> DataFrame:
        """Files of a folder, checked, read, cut into chunks and stored; files stored before are left as they are. Of the formats
        that may be uploaded, those without a parser are left out."""
        readable = [e for e in UPLOADS if e in PARSERS]
        files = list_files(self.spark, folder).where((c("size") > 0) & (c("size") <= MOST) & c("ext").isin(*readable))
        seen = Observation()
        parsed = files.select("name", "ext", "size", "mtime", extract_text(c("name"), c("ext"), c("content")).alias("x"))
        failed = c("x.error").isNotNull()
        parsed = parsed.observe(seen, F.count("*").alias("files"), F.count_if(failed).alias("failed"), F.count_if(~failed & (F.coalesce(F.trim("x.text"), F.lit("")) == "")).alias("without_text"))
        read = written(parsed, "parsed").where("x.error is null and trim(x.text) <> ''")  # parsed once
        self.observed["upload"] = seen.get
        docs = read.select(F.xxhash64("name", "x.text").alias("id"), c("name").alias("filename"), c("ext").alias("file_type"), c("size").alias("file_size"), F.sha2("x.text", 256).alias("content_hash"), c("x.text").alias("raw_text"), c("mtime").alias("created_at"))
        new = docs.join(self.documents.read().select("content_hash"), "content_hash", "left_anti").dropDuplicates(["content_hash"])
        self.documents.upsert(new.select(*[f.name for f in self.documents.read().schema]))
        waiting = self.documents.read().join(self.chunks.read().select(c("document_id").alias("id")).distinct(), "id", "left_anti")
        made = written(flows.ingest(waiting).join(waiting.select("id", "created_at"), "id"), "ingested")
        vector = c("vector") if vectorise else F.lit(None).cast("array<float>")
        self.chunks.upsert(made.select(F.xxhash64("chunk_id").alias("id"), c("id").alias("document_id"), "chunk_index", "chunk_id", "content", "filename", vector.isNotNull().alias("vectorized"), vector.alias("vector"), "created_at"))
        return self.list_documents()

    def unvectorised(self, limit: int = 50) -> DataFrame:
        return self.chunks.read().where(~c("vectorized")).orderBy("document_id", "chunk_index").limit(limit)

    def vectorise_pending(self, limit: int = 50) -> int:
        """Embeds waiting chunks and stores them; how many there were, and how many got a vector, is observed as they are written."""
        seen = Observation()
        done = self.unvectorised(limit).withColumn("vector", embed(c("content"))).withColumn("vectorized", c("vector").isNotNull())
        done = written(done.observe(seen, F.count("*").alias("chunks"), F.count_if("vectorized").alias("vectors")), "vectorised")
        self.observed["vectorise"] = seen.get
        self.chunks.upsert(done)
        return seen.get["chunks"]

    def list_documents(self) -> DataFrame:
        counts = self.chunks.read().groupBy(c("document_id").alias("id")).agg(F.count("*").alias("chunk_count"), F.count_if("vectorized").alias("vectorized_chunks"))
        return self.documents.read().drop("raw_text").join(counts, "id", "left").orderBy(F.desc("created_at"), "filename")

    def stored_files(self) -> DataFrame:
        return file_rollup(self.chunks.read().withColumnRenamed("content", "chunk_text"))

    def chunk_metadata(self, name_part: str = "", limit: int = 10, vector_id: int | str | None = None) -> DataFrame:
        """Chunks by a part of their file name or by the id of their vector."""
        return metadata_filter(self.chunks.read().withColumn("vector_id", c("id")), name_part, max(1, min(100, limit)), vector_id)

    def correct_spelling(self, entries: DataFrame, common: frozenset[str] = frozenset()) -> DataFrame:
        """The stored documents' texts corrected by a terminology, conservatively; the counts are kept for ``spelling_statistics``."""
        seen = Observation()
        texts = self.documents.read().select(c("id").alias("doc_id"), c("raw_text").alias("text"))
        n = F.coalesce(F.size("corrections"), F.lit(0))
        words = F.coalesce("total_words", F.lit(0))
        counted = correct_conservative(texts, entries, common).observe(seen, F.sum(n).alias("total_corrections"), F.sum(words - n).alias("no_corrections"), F.count("*").alias("documents"))
        done = written(counted, "corrected")
        found = {k: v or 0 for k, v in seen.get.items()}
        self.observed["spelling"] = found | {"dictionary_corrections": found["total_corrections"]}
        return done

    def spelling_statistics(self) -> dict:
        """What the last correction came to."""
        if "spelling" not in self.observed:
            return {"success": False, "error": "nothing was corrected yet"}
        return {"success": True, "spell_correction_stats": self.observed["spelling"]}

    def statistics(self) -> DataFrame:
        return catalog_stats(self.documents.read(), self.chunks.read().withColumn("chunk_size", F.length("content")))

    def delete(self, filename: str) -> dict:
        """A document and its chunks; returns how many of each went."""
        named = c("filename") == F.lit(filename)
        return {"chunks": self.chunks.delete(named), "documents": self.documents.delete(named)}

    def clear(self) -> None:
        self.documents.clear()
        self.chunks.clear()

    def query(self, questions: DataFrame, max_chunks: int = 5, method: str = "hybrid_rrf", weights: tuple[float, float] = (0.6, 0.4), force_document_search: bool = False) -> DataFrame:
        """Answers to questions (query_id, text); short texts that need no search get the conversational fallback, unless the
        search is forced. ``weights`` (dense, sparse) are those of hybrid_weighted."""
        if not 1 <= max_chunks <= 20:
            raise ValueError("max_chunks must lie between 1 and 20")
        searched = questions if force_document_search else questions.where(F.size(F.split(F.trim("text"), r"\s+")) > 3)
        sure = F.when(c("sources").isNull(), CONFIDENCE["nothing_found"]).otherwise(c("confidence"))
        found = flows.ask(self._vectors(), searched, max_chunks, method, weights).select("query_id", "answer", sure.alias("confidence"), F.lit("document_search").alias("kind"), "sources")
        if force_document_search:
            return found
        chat = questions.join(searched.select("query_id"), "query_id", "left_anti").select("query_id", F.lit("How can I help you with your documents?").alias("answer"), F.lit(CONFIDENCE["conversational_fallback"]).alias("confidence"), F.lit("conversational").alias("kind"))
        return found.unionByName(chat, allowMissingColumns=True)

    def bulk_questions(self, questions: DataFrame, out: str, method: str = "hybrid_rrf", max_chunks: int = 5, weights: tuple[float, float] = (0.6, 0.4), force_document_search: bool = False) -> str:
        """Answers to a table of questions as a quoted CSV, a row for each row; returns its folder. Equal questions are asked once.
        The time of a question is its share of the batch's. Answers are kept for ``query_statistics``."""
        rows = questions.select(F.xxhash64("question").alias("query_id"), c("question").alias("text"))
        asked = rows.dropDuplicates(["query_id"])
        began = time.perf_counter()
        batch = f"{self.path}/answers/batch={uuid.uuid4().hex}"
        self.query(asked, max_chunks, method, weights, force_document_search).withColumn("method", F.lit(method)).withColumn("at", F.current_timestamp()).write.parquet(batch)
        answers = self.spark.read.parquet(batch)
        each = (time.perf_counter() - began) / max(1, answers.count())
        self.spark.createDataFrame([(each,)], "seconds double").write.parquet(f"{self.path}/times/{batch.rsplit('/', 1)[1]}")
        context = F.array_join(F.transform("sources", lambda x: F.format_string("[Score: %.3f] %s", x["score"], x["preview"])), " <CHUNK_SPLIT> ")
        answer_ = F.coalesce("answer", F.lit("Error: No answer generated"))
        shaped = rows.join(answers, "query_id", "left").select(c("text").alias("question"), answer_.alias("answer"), F.coalesce(context, F.lit("")).alias("context"), F.lit(method).alias("retrieval_method"), F.lit(f"{each:.2f}s").alias("query_time"), F.format_string("%.3f", F.coalesce("confidence", F.lit(CONFIDENCE["failed"]))).alias("confidence_score"))
        return write_csv(shaped, out, f"hybrid_{method.removeprefix('hybrid_')}_processed_")

    def _vectors(self) -> DataFrame:
        return self.chunks.read().where("vectorized").withColumnRenamed("id", "item")

    def query_statistics(self) -> DataFrame:
        """By method and kind of answer over all bulk answers so far: how many, their share, mean confidence and mean time."""
        try:
            kept = self.spark.read.parquet(f"{self.path}/answers")
            times = self.spark.read.parquet(f"{self.path}/times")
        except AnalysisException:  # nothing was asked yet
            return self.spark.createDataFrame([], "method string, kind string, n bigint, share double, confidence double, seconds double")
        by = kept.join(times, "batch").groupBy("method", "kind").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("seconds").alias("seconds"))
        total = by.agg(F.sum("n").alias("total"))  # a single row
        return by.join(F.broadcast(total)).select("method", "kind", "n", (c("n") / c("total")).alias("share"), "confidence", "seconds")

    def hybrid_health(self) -> dict:
        """What the retrievers have to work on: chunks with vectors for the dense one, chunks with words for the sparse one."""
        n = self.chunks.read().agg(F.count_if("vectorized").alias("dense"), F.count_if(F.size(tokenise(c("content"))) > 0).alias("sparse")).first()
        named = {"dense_retriever": n["dense"], "sparse_retriever": n["sparse"], "results_fusion": min(n["dense"], n["sparse"])}
        return {name: {"items": found, "status": "Available" if found else "Not Available"} for name, found in named.items()}

    def upload_summary(self, folder: str) -> DataFrame:
        """For each file of a folder: whether its text is stored, how many chunks it has, and why not."""
        files = list_files(self.spark, folder).select("name", "ext", "size", extract_text(c("name"), c("ext"), c("content")).alias("x"))
        readable = [e for e in UPLOADS if e in PARSERS]
        why = F.when(~c("ext").isin(*readable), F.concat(F.lit("Unsupported file type: ."), c("ext"))).when(c("size") == 0, "empty file").when(c("size") > MOST, "file too large").when(c("x.error").isNotNull(), c("x.error")).when(F.trim("x.text") == "", "no text found")
        stored = self.list_documents().select("content_hash", "chunk_count")
        rows = files.select("name", why.alias("error"), F.sha2("x.text", 256).alias("content_hash")).join(stored, "content_hash", "left")
        done = c("error").isNull() & c("chunk_count").isNotNull()
        return rows.select("name", done.alias("success"), F.when(done, c("chunk_count")).otherwise(0).alias("chunk_count"), F.when(~done, F.coalesce("error", F.lit("not stored"))).alias("error"))

    def compare(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """The best chunks by each method, and of how many methods each is."""
        return self._ranked(questions, k).groupBy("query_id", "item").agg(F.sort_array(F.collect_list("method")).alias("methods"), F.count("*").alias("n_methods"))

    def evaluate(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """For each method: questions with hits, mean number of hits, and agreement, the mean share of all methods that have its
        hits too; ``best`` marks the highest agreement, ties by name. Without judged answers, agreement is what can be measured."""
        found = self._ranked(questions, k)
        votes = found.groupBy("query_id", "item").agg((F.count("*") / len(METHODS)).alias("share"))
        by = found.join(votes, ["query_id", "item"]).groupBy("method").agg(F.countDistinct("query_id").alias("questions"), (F.count("*") / F.countDistinct("query_id")).alias("hits"), F.round(F.avg("share"), 6).alias("agreement"))
        first = F.row_number().over(Window.orderBy(F.desc("agreement"), "method"))  # a row for each method
        return by.withColumn("best", first == 1)

    def comparison_summary(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """For each question how many methods were tried, how many gave hits, and the best: the one whose hits most other methods have too, ties
        by name; null where none has any."""
        found = self._ranked(questions, k)
        votes = found.groupBy("query_id", "item").agg(F.count("*").alias("votes"))
        by = found.join(votes, ["query_id", "item"]).groupBy("query_id", "method").agg(F.avg("votes").alias("agreement"))
        best = by.groupBy("query_id").agg(F.min(F.struct((-c("agreement")).alias("less"), "method")).alias("best"), F.count("*").alias("with_hits"))
        joined = questions.select("query_id").join(best, "query_id", "left")
        return joined.select("query_id", F.lit(len(METHODS)).alias("methods_tested"), F.coalesce("with_hits", F.lit(0)).alias("with_hits"), c("best.method").alias("best_method"))

    def _ranked(self, questions: DataFrame, k: int) -> DataFrame:
        parts = [flows.retrieve(self._vectors(), questions, k, m).select("query_id", "item", F.lit(m).alias("method")) for m in METHODS]
        return reduce(DataFrame.unionByName, parts)
