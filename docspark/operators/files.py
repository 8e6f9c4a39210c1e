"""File classification, exact file deduplication and its statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions.scalars import quick_hash
from docspark.plans.fixtures import load
from docspark.registry import query

c = F.col
#: Fixed rules of the file filter.
ALLOWED = ("pdf", "docx", "xlsx", "pptx")
UPLOADS = (*ALLOWED, "doc", "xls", "txt", "csv")
FOLDERS = "archive|archived|old|backup|temp|tmp|cache|trash|recycle|deleted"
KEEP = "final|signed|executed|board deck|investment memo"
REJECT = r"^~|^\.|^\$|^copy of |superseded|obsolete|^test|^sample|\.tmp$|\.bak$"
LEAST, MOST, LEAST_PDF, SUSPICIOUS = 1024, 100 << 20, 5120, (1024, 2048, 4096, 8192)


def classify(folder: Column, name: Column, ext: Column, size: Column, state: Column | None = None) -> Column:
    """The first rule that holds names the reason; the folder rule searches the whole lower-cased path. ``state`` is what ``path_states`` says
    of a path; where that is not null it is the reason."""
    low, state = F.lower(name), F.lit(None).cast("string") if state is None else state
    return (
        F.when(state.isNotNull(), state).when(~ext.isin(*ALLOWED), "bad_extension").when(F.lower(folder).rlike(FOLDERS), "archive_folder").when(low.rlike(KEEP), "important_file").when(low.rlike(REJECT), "rejected_pattern")
        .when(size < LEAST, "too_small").when(size > MOST, "too_large").when((ext == "pdf") & (size < LEAST_PDF), "pdf_too_small").when(size.isin(*SUSPICIOUS), "suspicious_size").otherwise("passed_all_checks")
    )


def path_states(asked: DataFrame, listed: DataFrame) -> DataFrame:
    """``asked`` (path) with size, and state: ``not_a_file`` for a folder of listed files, ``file_not_found`` for what is not ``listed`` (path, size),
    ``cannot_read_file`` for a file without a size, null for the others."""
    met = asked.join(listed.select("path", "size", F.lit(True).alias("known")), "path", "left").join(_folders(listed).select(c("folder").alias("path"), F.lit(True).alias("is_folder")), "path", "left")
    state = F.when(c("known") & c("size").isNotNull(), F.lit(None).cast("string")).when(c("known"), "cannot_read_file").when(c("is_folder"), "not_a_file").otherwise("file_not_found")
    return met.withColumn("state", state).drop("known", "is_folder")


def _folders(listed: DataFrame) -> DataFrame:
    """All folders above listed files."""
    steps = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(steps) - 1)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    return listed.select(F.explode(above).alias("folder")).distinct()


def is_kept(reason: Column) -> Column:
    return reason.isin("important_file", "passed_all_checks")


def priority(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("executed"), 4).when(low.contains("signed"), 3).when(low.contains("final"), 2).otherwise(1)


def best_versions(files: DataFrame) -> DataFrame:
    """One file for each content. The cheap quick hash prunes: only files that share one get their full hash compared."""
    quick = files.withColumn("quick", quick_hash(c("content")))
    shared = quick.groupBy("quick").agg(F.count("*").alias("n_quick"))
    keyed = quick.join(shared, "quick").withColumn("full_hash", F.when(c("n_quick") > 1, F.md5("content")).otherwise(c("quick"))).drop("content")
    best = keyed.groupBy("full_hash").agg(F.max_by("file_id", F.struct(priority(c("name")), c("mtime"), c("size"), -c("file_id"))).alias("best_id"), F.count("*").alias("copies"))
    return keyed.join(best, "full_hash").select("file_id", "full_hash", "copies", (c("file_id") == c("best_id")).alias("kept"))


def filter_stats(classified: DataFrame) -> DataFrame:
    by = classified.groupBy("reason").agg(F.count("*").alias("n"))
    share = F.round(100.0 * c("n") / F.sum("n").over(Window.partitionBy()), 4)
    return by.select("reason", "n", is_kept(c("reason")).alias("kept"), share.alias("pct"))


#: Name parts that the listing made from the test documents goes through.
_NAMES = ("report", "final report", "signed deal", "executed deal", "copy of plan", "~lock", "superseded plan", "test plan", "memo", "board deck")
_FOLDERS = ("/data/deals", "/data/archive/x", "/data/folder", "/data/q1")
LISTING_SQL = f"""
files AS (SELECT doc_id AS file_id, (['{"','".join(_FOLDERS)}'])[doc_id % 4 + 1] AS folder,
  (['{"','".join(_NAMES)}'])[doc_id % 10 + 1] || ' ' || doc_id || '.' || e AS name, e AS ext, CASE WHEN doc_id % 23 = 0 THEN 4096 WHEN doc_id % 29 = 0 THEN 104857601 ELSE n_chars * 4 END AS size, text, doc_id % 50 AS mtime
  FROM (SELECT *, (['pdf', 'docx', 'xlsx', 'pptx', 'exe'])[doc_id % 5 + 1] AS e FROM documents)),
reasons AS (SELECT file_id, CASE WHEN ext NOT IN ('{"','".join(ALLOWED)}') THEN 'bad_extension' WHEN regexp_matches(lower(folder), '{FOLDERS}') THEN 'archive_folder' WHEN regexp_matches(lower(name), '{KEEP}') THEN 'important_file'
  WHEN regexp_matches(lower(name), '{REJECT}') THEN 'rejected_pattern' WHEN size < {LEAST} THEN 'too_small' WHEN size > {MOST} THEN 'too_large' WHEN ext = 'pdf' AND size < {LEAST_PDF} THEN 'pdf_too_small' WHEN size IN {SUSPICIOUS} THEN 'suspicious_size' ELSE 'passed_all_checks' END AS reason FROM files)"""


def listing(s: SparkSession, d: str) -> DataFrame:
    """A file listing made from the test documents: names, folders and sizes that reach every rule."""
    pick = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (c("doc_id") % k + 1).cast("int"))
    docs = load(s, d, "documents").withColumn("ext", pick((*ALLOWED, "exe"), 5))
    size = F.when(c("doc_id") % 23 == 0, 4096).when(c("doc_id") % 29 == 0, 104857601).otherwise(c("n_chars") * 4)
    return docs.select(c("doc_id").alias("file_id"), pick(_FOLDERS, 4).alias("folder"), F.concat(pick(_NAMES, 10), F.lit(" "), c("doc_id").cast("string"), F.lit("."), c("ext")).alias("name"), "ext", size.alias("size"), c("text").cast("binary").alias("content"), (c("doc_id") % 50).alias("mtime"))


def _classified(s: SparkSession, d: str) -> DataFrame:
    return listing(s, d).select("file_id", classify(c("folder"), c("name"), c("ext"), c("size")).alias("reason"))


@query("files_classify", f"WITH {LISTING_SQL} SELECT file_id, reason FROM reasons")
def _(s: SparkSession, d: str) -> DataFrame:
    return _classified(s, d)


@query("files_filter_stats", f"WITH {LISTING_SQL} SELECT reason, count(*) AS n, reason IN ('important_file', 'passed_all_checks') AS kept, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM reasons GROUP BY reason")
def _(s: SparkSession, d: str) -> DataFrame:
    return filter_stats(_classified(s, d))


_RANKED = "(CASE WHEN contains(lower(name), 'executed') THEN 4 WHEN contains(lower(name), 'signed') THEN 3 WHEN contains(lower(name), 'final') THEN 2 ELSE 1 END)"


@query("files_best_versions", f"""WITH {LISTING_SQL}, h AS (SELECT *, md5(text) AS full_hash FROM files)
SELECT file_id, full_hash, count(*) OVER (PARTITION BY full_hash) AS copies, row_number() OVER (PARTITION BY full_hash ORDER BY {_RANKED} DESC, mtime DESC, size DESC, file_id) = 1 AS kept FROM h""")
def _(s: SparkSession, d: str) -> DataFrame:
    return best_versions(listing(s, d))


@query("files_union_report", f"""WITH {LISTING_SQL}, h AS (SELECT file_id, row_number() OVER (PARTITION BY md5(text) ORDER BY {_RANKED} DESC, mtime DESC, size DESC, file_id) = 1 AS best FROM files JOIN reasons USING (file_id) WHERE reason IN ('important_file', 'passed_all_checks'))
SELECT 'rejected' AS outcome, count(*) AS n FROM reasons WHERE reason NOT IN ('important_file', 'passed_all_checks') UNION ALL SELECT CASE WHEN best THEN 'unique' ELSE 'duplicate' END, count(*) FROM h GROUP BY best""")
def _(s: SparkSession, d: str) -> DataFrame:
    files = listing(s, d).withColumn("reason", classify(c("folder"), c("name"), c("ext"), c("size")))
    judged = best_versions(files.where(is_kept(c("reason")))).select(F.when(c("kept"), "unique").otherwise("duplicate").alias("outcome"))
    rejected = files.where(~is_kept(c("reason"))).select(F.lit("rejected").alias("outcome"))
    return rejected.unionByName(judged).groupBy("outcome").agg(F.count("*").alias("n"))


@query("files_upload_check", f"WITH {LISTING_SQL} SELECT file_id, size > 0 AND size <= {MOST} AND ext IN {UPLOADS} AS valid FROM files")
def _(s: SparkSession, d: str) -> DataFrame:
    return listing(s, d).select("file_id", ((c("size") > 0) & (c("size") <= MOST) & c("ext").isin(*UPLOADS)).alias("valid"))
