"""Scalar functions over text, ids, dates, scores and arrays, as column expressions, and their queries."""

from __future__ import annotations

import os
import re
import unicodedata
from collections import deque
from collections.abc import Callable
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.plans.fixtures import DOCUMENTS_SQL, documents, load
from docspark.registry import query

c = F.col
TEXTS_SQL = "SELECT doc_id, text FROM documents"


# --- text ------------------------------------------------------------------------------------------------


def embed_clean(t: Column, most: int = 8000) -> Column:
    """White space collapsed to single spaces, ends trimmed, cut to ``most`` characters."""
    return F.substring(F.trim(F.regexp_replace(t, r"[ \t\n\r\x0B\f]+", " ")), 1, most)


def _of_lines(t: Column, keep: Callable[[list[str]], list[str]]) -> Column:
    """Texts of those of their lines that ``keep`` gives back."""

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else "\n".join(keep(v.split("\n"))) for v in x.to_pylist()], pa.string())

    return run(t)


def keep_recent_lines(t: Column, window: int = 5) -> Column:
    """Drop a line whose trimmed lower-case form is among the last ``window`` kept lines. Blank lines stay and count.

    The state is those last forms alone, so a text takes time in proportion to its lines.
    """

    def keep(lines: list[str]) -> list[str]:
        kept, last = [], deque(maxlen=window)
        for line in lines:
            form = line.strip(" ").lower()
            if not form or form not in last:
                kept.append(line)
                last.append(form)
        return kept

    return _of_lines(t, keep)


def chunk_clean(t: Column) -> Column:
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"=== PAGE \d+ ===", "\n\n")
    return F.trim(keep_recent_lines(F.regexp_replace(t, r"\n{3,}", "\n\n")))


def similarity_normalise(t: Column) -> Column:
    """Lower case without header lines, white space collapsed, then without extraction marks (which may leave double spaces)."""
    t = F.regexp_replace(F.lower(t), r"document:\s*[^\n]+\n", "")
    t = F.regexp_replace(t, r"page:\s*\d+\n", "")
    t = F.trim(F.regexp_replace(t, r"[ \t\n\r\x0B\f]+", " "))
    for mark in (r"\[pymupdf extracted text\]", r"\[ocr text from \w+\]", r"\[page \d+, \w+\]"):
        t = F.regexp_replace(t, mark, "")
    return t


def extraction_clean(t: Column) -> Column:
    """Spaces collapsed, glued words and numbers parted, lines trimmed, repeated lines (any case) dropped."""
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n\s*\n\s*\n+", "\n\n")
    for a, b in (("[a-z]", "[A-Z]"), ("[a-zA-Z]", "[0-9]"), ("[0-9]", "[a-zA-Z]")):
        t = F.regexp_replace(t, f"({a})({b})", "$1 $2")

    def keep(lines: list[str]) -> list[str]:
        seen: set[str] = set()
        return [x for x in (line.strip(" ") for line in lines) if not x or not ((form := x.lower()) in seen or seen.add(form))]

    return F.trim(_of_lines(t, keep))


def unicode_normalise(t: Column) -> Column:
    """NFKC; dashes become hyphens and bullets spaces. There is no JVM built-in for it."""
    table = {0x2013: "-", 0x2014: "-", 0x2022: " ", 0x25AA: " ", 0x25CF: " ", 0xF0A1: " "}

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        return pa.array([None if v is None else unicodedata.normalize("NFKC", v).translate(table) for v in x.to_pylist()], pa.string())

    return run(t)


def join_hyphens(t: Column, keep_hyphen: bool = False) -> Column:
    return F.regexp_replace(t, r"(\w+)-\s*\n\s*(\w+)", "$1-$2" if keep_hyphen else "$1$2")


def tokens(t: Column) -> Column:
    return F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9][A-Za-z0-9_\-'/]*"), F.lit(0))


def sanitise_filename(t: Column) -> Column:
    return F.regexp_replace(t, r"[^A-Za-z0-9_\-.]", "_")


def preview(t: Column, most: int) -> Column:
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def extension(name: Column) -> Column:
    return F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit("unknown"))


#: Fixed domain terms whose presence is flagged.
KEY_TERMS = ("aircraft", "maintenance", "safety", "inspection", "engine", "flight", "procedure", "system", "component", "regulation")


def key_terms(t: Column, terms: tuple[str, ...] = KEY_TERMS) -> Column:
    low = F.lower(t)
    return F.filter(F.array(*map(F.lit, terms)), lambda x: F.contains(low, x))


def table_text(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda x: F.coalesce(x, F.lit(""))), " | ")


# --- ids -------------------------------------------------------------------------------------------------


def chunk_uuid(name: Column, index: Column, content: Column) -> Column:
    h = F.md5(F.concat_ws("_", name, index, content))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def block_chunk_id(name: Column, index: Column, content: Column) -> Column:
    return F.concat_ws("_", F.substring(F.md5(name), 1, 4), F.format_string("%04d", index), F.substring(F.md5(content), 1, 8))


def vector_id(*parts: Column) -> Column:
    return F.conv(F.substring(F.md5(F.concat_ws("_", *parts)), 1, 8), 16, 10).cast("long")


def quick_hash(content: Column, edge: int = 1 << 20) -> Column:
    """md5 of small contents; of large ones of the first MiB, the size as text and the last MiB."""
    n = F.octet_length(content)
    ends = F.concat(F.substring(content, 1, edge), n.cast("string").cast("binary"), F.substring(content, -edge, edge))
    return F.when(n <= 2 * edge, F.md5(content)).otherwise(F.md5(ends))


# --- dates -----------------------------------------------------------------------------------------------


def pdf_date(raw: Column) -> Column:
    """``D:`` and 14, 12, 10 or 8 digits, the longest that parses; else null."""
    digits = F.substring(raw, 3, 14)
    formats = ((14, "yyyyMMddHHmmss"), (12, "yyyyMMddHHmm"), (10, "yyyyMMddHH"), (8, "yyyyMMdd"))
    tried = [F.when(F.length(digits) >= n, F.try_to_timestamp(F.substring(digits, 1, n), F.lit(f))) for n, f in formats]
    return F.when(F.startswith(raw, F.lit("D:")), F.coalesce(*tried))


#: Fixed fields of the loose date format, in order: the first alternative that fits is taken, and nothing may follow.
LOOSE = r"^(\d{4})(1[0-2]|0[1-9]|[1-9])(3[0-1]|[1-2]\d|0[1-9]|[1-9]| [1-9])(2[0-3]|[0-1]\d|\d)([0-5]\d|\d)(6[0-1]|[0-5]\d|\d)"


def pdf_date_loose(raw: Column) -> Column:
    """``D:`` and up to 14 characters without a check of their number: fields of one digit are taken too, so that a short date may
    be read as another (``D:2024013123`` is 3 January, 01:02:03). Else null."""
    core = F.substring(raw, 3, 14)
    field = [F.regexp_extract(core, LOOSE, k) for k in range(7)]
    whole = F.startswith(raw, F.lit("D:")) & (F.length(core) > 0) & (F.length(field[0]) == F.length(core)) & (field[1] != "0000")
    part = [F.when(whole, F.trim(x)).try_cast("int") for x in field[1:]]
    return F.when(part[5] < 60, F.try_make_timestamp(*part[:5], part[5].cast("decimal(8,6)")))


def epoch_or_now(value: Column, now: Column) -> Column:
    """Seconds since 1970 as a timestamp; what is no number counts as now."""
    return F.coalesce(F.timestamp_seconds(value.try_cast("double")), now)


def creation_time(path: Column, modified: Column) -> Column:
    """When a file was made, as its own file system says: birth time where there is one, else the time of the last status change;
    for files that the worker can't see (remote stores) the time of the last change that the store gives."""

    @F.arrow_udf("double")
    def run(x: pa.Array) -> pa.Array:
        out = []
        for name in x.to_pylist():
            try:
                found = os.stat(unquote(re.sub(r"^file:/+", "/", name or "")))
                out.append(getattr(found, "st_birthtime", None) or found.st_ctime)
            except (OSError, ValueError):
                out.append(None)
        return pa.array(out, pa.float64())

    return F.coalesce(F.timestamp_seconds(run(path)), modified)


def age_days(at: Column, now: Column) -> Column:
    return F.floor((F.unix_timestamp(now) - F.unix_timestamp(at)) / 86400)


def age_bucket(days: Column) -> Column:
    out = F.lit("older")
    for limit, name in ((1825, "within_5_years"), (365, "within_year"), (90, "moderately_recent"), (30, "recent"), (7, "very_recent")):
        out = F.when(days < limit, name).otherwise(out)
    return out


# --- scores ----------------------------------------------------------------------------------------------


def confidence(max_similarity: Column, n: Column) -> Column:
    base = F.lit(0.25)
    for limit, value in ((0.2, 0.35), (0.3, 0.5), (0.5, 0.65), (0.7, 0.8)):
        base = F.when(max_similarity >= limit, value).otherwise(base)
    return F.when(n == 0, 0.1).otherwise(F.least(F.lit(0.9), base + F.least(F.lit(0.1), 0.02 * n)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets: both empty 1, one empty 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def words(t: Column) -> Column:
    """Distinct tokens between white space."""
    return F.array_distinct(F.filter(F.split(t, r"[ \t\n\r\x0B\f]+"), lambda x: x != ""))


# --- queries ---------------------------------------------------------------------------------------------

WS = r"[ \t\n\r\x0B\f]+"


def _texts(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", "text")


@query("text_embed_clean", rf"SELECT doc_id, substr(trim(regexp_replace(text, '{WS}', ' ', 'g')), 1, 8000) AS cleaned FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("doc_id", embed_clean(c("text")).alias("cleaned"))


KEEP_RECENT_SQL = r"""list_reduce(list_prepend([]::VARCHAR[], list_transform(string_split(x, chr(10)), lambda l: [l])), lambda kept, l:
  CASE WHEN lower(trim(l[1])) <> '' AND list_contains(list_transform(kept[greatest(1, len(kept) - 4):], lambda k: lower(trim(k))), lower(trim(l[1]))) THEN kept ELSE list_concat(kept, l) END)"""


@query("text_chunk_clean", rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace('=== PAGE 1 ===' || chr(10) || text || chr(10) || left(text, 200), '[ \t]+', ' ', 'g'), '=== PAGE \d+ ===', chr(10) || chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM documents)
SELECT doc_id, md5(trim(array_to_string({KEEP_RECENT_SQL}, chr(10)))) AS cleaned_md5 FROM t""")
def _(s: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("=== PAGE 1 ===\n"), c("text"), F.lit("\n"), F.substring("text", 1, 200))
    return _texts(s, d).select("doc_id", F.md5(chunk_clean(marked)).alias("cleaned_md5"))


@query("text_similarity_normalise", rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(
  lower('Document: f.pdf' || chr(10) || 'Page: 1' || chr(10) || '[Page 2, OCR] ' || text), 'document:\s*[^\n]+\n', '', 'g'), 'page:\s*\d+\n', '', 'g'), '{WS}', ' ', 'g')), '\[pymupdf extracted text\]', '', 'g'), '\[ocr text from \w+\]', '', 'g'), '\[page \d+, \w+\]', '', 'g')) AS norm_md5 FROM documents""")
def _(s: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("Document: f.pdf\nPage: 1\n[Page 2, OCR] "), c("text"))
    return load(s, d, "documents").select("doc_id", F.md5(similarity_normalise(marked)).alias("norm_md5"))


@query("text_extraction_clean", r"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(text, ' the ', 'The2x'), '[ \t]+', ' ', 'g'), '\n\s*\n\s*\n+', chr(10) || chr(10), 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '([a-zA-Z])([0-9])', '\1 \2', 'g'), '([0-9])([a-zA-Z])', '\1 \2', 'g') AS x FROM documents),
l AS (SELECT doc_id, list_transform(string_split(x, chr(10)), lambda l: trim(l)) AS ls FROM t)
SELECT doc_id, md5(trim(array_to_string(list_reduce(list_prepend([]::VARCHAR[], list_transform(ls, lambda q: [q])), lambda kept, q: CASE WHEN q[1] <> '' AND list_contains(list_transform(kept, lambda k: lower(k)), lower(q[1])) THEN kept ELSE list_concat(kept, q) END), chr(10)))) AS cleaned_md5 FROM l""")
def _(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("doc_id", F.md5(extraction_clean(F.replace(c("text"), F.lit(" the "), F.lit("The2x")))).alias("cleaned_md5"))


@query("text_unicode_normalise", "SELECT doc_id, md5(replace(replace(nfc_normalize(text), chr(8211), '-'), chr(8226), ' ')) AS norm_md5 FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("doc_id", F.md5(unicode_normalise(c("text"))).alias("norm_md5"))


@query("text_join_hyphens", r"""SELECT doc_id, md5(regexp_replace(x, '(\w+)-\s*\n\s*(\w+)', '\1\2', 'g')) AS joined_md5, md5(regexp_replace(x, '(\w+)-\s*\n\s*(\w+)', '\1-\2', 'g')) AS kept_md5
FROM (SELECT doc_id, replace(text, 'ing the', 'ing-' || chr(10) || ' the') AS x FROM documents)""")
def _(s: SparkSession, d: str) -> DataFrame:
    x = load(s, d, "documents").select("doc_id", F.replace("text", F.lit("ing the"), F.lit("ing-\n the")).alias("x"))
    return x.select("doc_id", F.md5(join_hyphens(c("x"))).alias("joined_md5"), F.md5(join_hyphens(c("x"), True)).alias("kept_md5"))


@query("text_tokens", r"""SELECT doc_id, len(ts)::INT AS n_tokens, md5(array_to_string(ts, '|')) AS tokens_md5 FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9_\-''/]*') AS ts FROM documents)""")
def _(s: SparkSession, d: str) -> DataFrame:
    t = _texts(s, d).select("doc_id", tokens(c("text")).alias("ts"))
    return t.select("doc_id", F.size("ts").alias("n_tokens"), F.md5(F.array_join("ts", "|")).alias("tokens_md5"))


@query("text_previews", """SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS p100, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS p500 FROM documents""")
def _(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("doc_id", preview(c("text"), 100).alias("p100"), preview(c("text"), 500).alias("p500"))


@query("text_key_terms", f"""SELECT doc_id, array_to_string(list_filter(['{"','".join(("the", "nd", "heat", "ation", "zz"))}'], lambda t: contains(lower(text), t)), ',') AS terms FROM documents""")
def _(s: SparkSession, d: str) -> DataFrame:
    return _texts(s, d).select("doc_id", F.array_join(key_terms(c("text"), ("the", "nd", "heat", "ation", "zz")), ",").alias("terms"))


@query("text_filename_parts", rf"""WITH {DOCUMENTS_SQL} SELECT id, regexp_replace(filename || ' (copy)', '[^A-Za-z0-9_\-.]', '_', 'g') AS safe, lower(regexp_extract(filename, '([^.]*)$', 1)) AS ext, round(file_size / 1048576.0, 2) AS mib FROM cat""")
def _(s: SparkSession, d: str) -> DataFrame:
    return documents(s, d).select("id", sanitise_filename(F.concat("filename", F.lit(" (copy)"))).alias("safe"), extension(c("filename")).alias("ext"), F.round(c("file_size") / 1048576, 2).alias("mib"))


@query("text_table_row", "SELECT doc_id, source || ' |  | ' || lang AS row_text FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", table_text(F.array("source", F.lit(None).cast("string"), "lang")).alias("row_text"))


@query("text_intent_fallback", rf"SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '{WS}'), lambda x: x <> '')) > 3 AS needs_search FROM conversations WHERE role = 'user'")
def _(s: SparkSession, d: str) -> DataFrame:
    t = load(s, d, "conversations").where("role = 'user'")
    return t.select("conv_id", "turn", (F.size(F.filter(F.split("text", WS), lambda x: x != "")) > 3).alias("needs_search"))


@query("ids_all", rf"""WITH {DOCUMENTS_SQL}, h AS (SELECT *, md5(filename || '_' || 3 || '_' || raw_text) AS h FROM cat)
SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid,
  substr(md5(filename), 1, 4) || '_' || printf('%04d', (id % 20000)::INT) || '_' || substr(md5(raw_text), 1, 8) AS block_id, ('0x' || substr(md5(id || '_2_3'), 1, 8))::BIGINT AS vec,
  content_hash, md5(raw_text) AS full_hash, substr(md5(raw_text), 1, 8) AS original_hash, md5(raw_text) AS quick,
  md5(replace(replace(lower(raw_text), chr(10), ' '), ' ', '')) AS dedup_key FROM h""")
def _(s: SparkSession, d: str) -> DataFrame:
    t = c("raw_text")
    key = F.replace(F.replace(F.lower(t), F.lit("\n"), F.lit(" ")), F.lit(" "), F.lit(""))
    return documents(s, d).select(
        "id", chunk_uuid(c("filename"), F.lit("3"), t).alias("uuid"), block_chunk_id(c("filename"), (c("id") % 20000).cast("int"), t).alias("block_id"), vector_id(c("id").cast("string"), F.lit("2"), F.lit("3")).alias("vec"),
        "content_hash", F.md5(t).alias("full_hash"), F.substring(F.md5(t), 1, 8).alias("original_hash"), quick_hash(t.cast("binary")).alias("quick"), F.md5(key).alias("dedup_key"),
    )


@query("dates_pdf_and_age", """WITH r AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'D:' || strftime(ts, '%Y%m%d%H%M%S') || '+02' WHEN 1 THEN 'D:' || strftime(ts, '%Y%m%d%H%M') WHEN 2 THEN 'D:' || strftime(ts, '%Y%m%d') WHEN 3 THEN strftime(ts, '%Y%m%d') ELSE 'D:2024' END AS raw FROM events),
p AS (SELECT event_id, CASE WHEN raw LIKE 'D:%' THEN coalesce(CASE WHEN length(raw) >= 16 THEN try_strptime(substr(raw, 3, 14), '%Y%m%d%H%M%S') END, CASE WHEN length(raw) >= 14 THEN try_strptime(substr(raw, 3, 12), '%Y%m%d%H%M') END, CASE WHEN length(raw) >= 12 THEN try_strptime(substr(raw, 3, 10), '%Y%m%d%H') END, CASE WHEN length(raw) >= 10 THEN try_strptime(substr(raw, 3, 8), '%Y%m%d') END) END AS created FROM r),
a AS (SELECT *, floor((epoch(TIMESTAMP '2024-02-15 12:00:00') - epoch(created)) / 86400)::BIGINT AS age FROM p)
SELECT event_id, coalesce(strftime(created, '%Y-%m-%d %H:%M:%S'), 'Unknown') AS created, year(created)::INT AS y, month(created)::INT AS m, day(created)::INT AS d, age, age < 30 AS is_recent,
CASE WHEN age < 7 THEN 'very_recent' WHEN age < 30 THEN 'recent' WHEN age < 90 THEN 'moderately_recent' WHEN age < 365 THEN 'within_year' WHEN age < 1825 THEN 'within_5_years' ELSE 'older' END AS bucket FROM a""")
def _(s: SparkSession, d: str) -> DataFrame:
    fmt = lambda p: F.date_format("ts", p)
    k = c("event_id") % 5
    raw = F.when(k == 0, F.concat(F.lit("D:"), fmt("yyyyMMddHHmmss"), F.lit("+02"))).when(k == 1, F.concat(F.lit("D:"), fmt("yyyyMMddHHmm"))).when(k == 2, F.concat(F.lit("D:"), fmt("yyyyMMdd"))).when(k == 3, fmt("yyyyMMdd")).otherwise("D:2024")
    p = load(s, d, "events").select("event_id", pdf_date(raw).alias("at"))
    p = p.withColumn("age", age_days(c("at"), F.lit("2024-02-15 12:00:00").cast("timestamp")))
    return p.select("event_id", F.coalesce(F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.lit("Unknown")).alias("created"), F.year("at").alias("y"), F.month("at").alias("m"), F.dayofmonth("at").alias("d"), "age", (c("age") < 30).alias("is_recent"), age_bucket(c("age")).alias("bucket"))


@query("dates_key_preference", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'created' WHEN 1 THEN 'modified' END AS picked FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    m = F.when(c("doc_id") % 3 == 0, F.create_map(F.lit("ModDate"), F.lit("modified"), F.lit("CreationDate"), F.lit("created"))).when(c("doc_id") % 3 == 1, F.create_map(F.lit("/ModDate"), F.lit("modified"))).otherwise(F.create_map(F.lit("x"), F.lit("y")))
    rows = load(s, d, "documents").select("doc_id", m.alias("m"))
    return rows.select("doc_id", F.coalesce(*[F.try_element_at("m", F.lit(k)) for k in ("/CreationDate", "CreationDate", "/ModDate", "ModDate")]).alias("picked"))


@query("dates_pdf_loose", rf"""WITH r AS (SELECT event_id, substr(strftime(ts, '%Y%m%d%H%M%S'), 1, (7 + event_id % 8)::INT) AS core FROM events), x AS (SELECT *, regexp_extract(core, '{LOOSE}', ['y', 'm', 'd', 'h', 'i', 's']) AS p, regexp_extract(core, '{LOOSE}', 0) AS hit FROM r)
SELECT event_id, CASE WHEN core = hit THEN strftime(try_cast(p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') || ' ' || lpad(p.h, 2, '0') || ':' || lpad(p.i, 2, '0') || ':' || lpad(p.s, 2, '0') AS TIMESTAMP), '%Y-%m-%d %H:%M:%S') END AS at_text FROM x""")
def _(s: SparkSession, d: str) -> DataFrame:
    core = F.date_format("ts", "yyyyMMddHHmmss").substr(F.lit(1), (7 + c("event_id") % 8).cast("int"))
    return load(s, d, "events").select("event_id", F.date_format(pdf_date_loose(F.concat(F.lit("D:"), core)), "yyyy-MM-dd HH:mm:ss").alias("at_text"))


@query("dates_epoch", "SELECT event_id, strftime(make_timestamp((1700000000 + event_id)::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') AS at_text FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").select("event_id", F.date_format(F.timestamp_seconds(c("event_id") + 1700000000), "yyyy-MM-dd HH:mm:ss").alias("at_text"))


@query("scores_confidence", """SELECT vec_id, round(CASE WHEN n = 0 THEN 0.1 ELSE least(0.9, (CASE WHEN m >= 0.7 THEN 0.8 WHEN m >= 0.5 THEN 0.65 WHEN m >= 0.3 THEN 0.5 WHEN m >= 0.2 THEN 0.35 ELSE 0.25 END)::DOUBLE + least(0.1, 0.02 * n)) END, 6) AS confidence
FROM (SELECT vec_id, (vec_id % 100)::DOUBLE / 100 AS m, vec_id % 8 AS n FROM embeddings)""")
def _(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "embeddings").select("vec_id", F.round(confidence((c("vec_id") % 100).cast("double") / 100, c("vec_id") % 8), 6).alias("confidence"))


@query("scores_metadata_merge", "SELECT doc_id, 'b' AS k, lang AS source FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    """Right-biased merge of two metadata maps, with a default for what is missing."""
    rows = load(s, d, "documents").select("doc_id", F.create_map(F.lit("k"), F.lit("a"), F.lit("only"), F.lit("left")).alias("l"), F.create_map(F.lit("k"), F.lit("b"), F.lit("source"), c("lang")).alias("r"))
    merged = F.map_zip_with("l", "r", lambda k, a, b: F.coalesce(b, a))
    return rows.select("doc_id", F.try_element_at(merged, F.lit("k")).alias("k"), F.coalesce(F.try_element_at(merged, F.lit("source")), F.lit("unknown")).alias("source"))
