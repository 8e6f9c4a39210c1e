"""Block detectors as plug-ins: each reads a file's bytes on the executors, their results stand side by side.

A detector is a function (name, bytes) -> list of dicts with any of page, kind, x0, y0, x1, y1, confidence, text. A detector that
fails, or whose library is missing, gives an error row and never ends the job. Blocks without a kind get one by the text rules.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.scalars import preview
from docspark.operators.parts import bounds
from docspark.operators.layout import block_confidence, block_type
from docspark.plans.fixtures import load
from docspark.registry import query
from docspark.sources.pdf import parse_pdf
from docspark.sources.readers import decode

c = F.col
Detector = Callable[[str, bytes], list[dict]]
_FIELDS = [("page", pa.int32()), ("kind", pa.string()), ("x0", pa.float64()), ("y0", pa.float64()), ("x1", pa.float64()), ("y1", pa.float64()), ("confidence", pa.float64()), ("text", pa.string())]
RESULT = "success boolean, error string, seconds double, blocks array<struct<page:int,kind:string,x0:double,y0:double,x1:double,y1:double,confidence:double,text:string>>"
KINDS = "array<struct<kind:string,files:int,successful:int,seconds:double,n_blocks:int,with_text:int>>"


def first_that_works(*strategies: Detector) -> Detector:
    """The result of the first strategy that doesn't fail; the last failure if all do."""

    def detect(name: str, data: bytes) -> list[dict]:
        failed: Exception = ValueError("no strategy")
        for strategy in strategies:
            try:
                return strategy(name, data)
            except Exception as problem:  # noqa: BLE001
                failed = problem
        raise failed

    return detect


def text_blocks(name: str, data: bytes) -> list[dict]:
    """The detector that is built in: paragraphs of a PDF's or a plain text, one page, without boxes."""
    text = parse_pdf(name, data) if data[:5] == b"%PDF-" else decode(data)
    return [{"page": 1, "text": part.strip()} for part in text.split("\n\n") if part.strip()]


def detect(files: DataFrame, detectors: dict[str, Detector]) -> DataFrame:
    """(name, library, success, error, seconds, blocks) of each file (name, content) by each detector."""

    fields = [f for f, _ in _FIELDS]

    def results(detector: Detector, names: list[str], contents: list[bytes | None]) -> list[pa.Array]:
        errors, seconds, ends = [], [], [0]
        rows: list[tuple] = []
        for name, data in zip(names, contents, strict=True):
            began = time.perf_counter()
            try:
                blocks, error = [tuple(map(b.get, fields)) for b in detector(name, data or b"")], None
            except Exception as problem:  # noqa: BLE001
                blocks, error = [], f"{type(problem).__name__}: {problem}"
            rows += blocks
            errors.append(error)
            seconds.append(time.perf_counter() - began)
            ends.append(len(rows))
        columns = list(zip(*rows, strict=True)) or [()] * len(fields)
        found = pa.StructArray.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(columns, _FIELDS, strict=True)], fields)
        return [pa.array([e is None for e in errors]), pa.array(errors, pa.string()), pa.array(seconds, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, contents = batch.columns
            for a, b in bounds(pc.fill_null(pc.binary_length(contents), 0).to_pylist()):
                part = names[a:b], contents[a:b]
                for library, detector in detectors.items():
                    made = results(detector, *(x.to_pylist() for x in part))
                    yield pa.RecordBatch.from_arrays([part[0], pa.array([library] * (b - a), pa.string()), *made], ["name", "library", "success", "error", "seconds", "blocks"])

    # a file's bytes go to the workers once, whatever the number of detectors
    name = files.schema["name"].dataType.simpleString()
    found = files.select("name", "content").mapInArrow(run, f"name {name}, library string, {RESULT}")
    return found.withColumn("blocks", F.transform("blocks", _typed))


def _typed(b):  # noqa: ANN001, ANN202
    kind = F.coalesce(b["kind"], block_type(F.coalesce(b["text"], F.lit("")), F.coalesce(b["y1"] - b["y0"], F.lit(50.0))))
    return b.withField("kind", kind).withField("confidence", F.coalesce(b["confidence"], block_confidence(kind)))


def compare_detectors(found: DataFrame) -> DataFrame:
    """For each library: files, those that succeeded, blocks, blocks with text and their share, kinds."""
    blocks = F.filter("blocks", lambda b: b.isNotNull())
    rows = found.select("library", F.coalesce("success", F.lit(False)).cast("int").alias("successful"), "seconds", blocks.alias("blocks"))
    counts = {"files": F.lit(1), "successful": c("successful"), "seconds": c("seconds"), "n_blocks": F.size("blocks"), "with_text": F.size(F.filter("blocks", lambda b: F.trim(b["text"]) != ""))}
    # the detectors run once: a file's counts and its kinds are rows of one pass
    whole = F.struct(F.lit(None).cast("string").alias("kind"), *[v.alias(k) for k, v in counts.items()])
    kinds = F.transform(F.array_distinct(F.transform("blocks", lambda b: b["kind"])), lambda k: F.struct(k.alias("kind"), F.lit(0).alias("files"), F.lit(0).alias("successful"), F.lit(0.0).alias("seconds"), F.lit(0).alias("n_blocks"), F.lit(0).alias("with_text")))
    sums = lambda: [F.sum(k).alias(k) for k in counts]
    each = rows.select("library", F.inline(F.concat(F.array(whole), F.coalesce(kinds, F.array().cast(KINDS))))).groupBy("library", "kind").agg(*sums())
    found = each.groupBy("library").agg(*sums(), F.sort_array(F.collect_set("kind")).alias("kinds"))
    n = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    return found.select("library", "files", "successful", "seconds", n("n_blocks"), n("with_text"), F.coalesce(F.try_divide("with_text", "n_blocks"), F.lit(0.0)).alias("text_rate"), "kinds")


def compare_tables(found: DataFrame) -> DataFrame:
    """For each file and library only the tables: how many, on which pages, and each one's page, confidence and preview."""
    tables = F.filter("blocks", lambda b: b["kind"] == "TABLE")
    details = F.transform(tables, lambda b: F.struct(b["page"].alias("page"), b["confidence"].alias("confidence"), preview(b["text"], 200).alias("text_preview")))
    return found.select("name", "library", "error", F.size(tables).alias("total_tables"), F.sort_array(F.array_distinct(F.transform(tables, lambda b: b["page"]))).alias("table_pages"), details.alias("table_details"))


# --- queries ---------------------------------------------------------------------------------------------


def _absent(name: str, data: bytes) -> list[dict]:
    raise ImportError("library is not installed")


def _lines(name: str, data: bytes) -> list[dict]:
    return [{"page": k, "kind": "TABLE" if " the " in line else "TEXT_BLOCK", "confidence": 0.5, "text": line} for k, line in enumerate(decode(data).split("\n"), 1) if line]


def _found(s: SparkSession, d: str) -> DataFrame:
    files = load(s, d, "documents").select(F.concat(F.lit("d"), c("doc_id").cast("string")).alias("name"), F.encode("text", "utf-8").alias("content"))
    return detect(files, {"absent": _absent, "lines": _lines, "fallback": first_that_works(_absent, _lines)})


_LINES = "l AS (SELECT 'd' || doc_id AS name, unnest(string_split(text, chr(10))) AS line FROM documents), libs AS (SELECT unnest(['absent', 'lines', 'fallback']) AS library)"


@query("layout_compare_detectors", f"""WITH {_LINES}, n AS (SELECT count(*) FILTER (line <> '') AS n, count(*) FILTER (trim(line) <> '') AS t FROM l)
SELECT library, (SELECT count(*) FROM documents) AS files, CASE WHEN library = 'absent' THEN 0 ELSE (SELECT count(*) FROM documents) END AS successful, CASE WHEN library = 'absent' THEN 0 ELSE n END AS n_blocks, CASE WHEN library = 'absent' THEN 0 ELSE t END AS with_text FROM libs, n""")
def _(s: SparkSession, d: str) -> DataFrame:
    return compare_detectors(_found(s, d)).select("library", "files", "successful", "n_blocks", "with_text")


@query("layout_compare_tables", f"""WITH {_LINES}, n AS (SELECT name, count(*) FILTER (contains(line, ' the ')) AS n FROM l GROUP BY 1)
SELECT 'd' || doc_id AS name, library, CASE WHEN library = 'absent' THEN 'ImportError: library is not installed' END AS error, (CASE WHEN library = 'absent' THEN 0 ELSE coalesce(n, 0) END)::INT AS total_tables
FROM documents CROSS JOIN libs LEFT JOIN n ON n.name = 'd' || doc_id""")
def _(s: SparkSession, d: str) -> DataFrame:
    return compare_tables(_found(s, d)).select("name", "library", "error", "total_tables")
