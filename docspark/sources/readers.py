"""Sources: files of several formats to text, chunk and question readers, with stdlib parsers only.

``binaryFile`` lists and reads the files; each format has a parser that runs in Arrow batches on the
executors. Parsers for formats that need an external engine (scanned images, older formats) are plugged in by name.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator
from contextlib import closing
from functools import reduce
from urllib.parse import quote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from docspark.sources.pdf import parse_pdf

Parser = Callable[[str, bytes], str]
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def decode(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def parse_csv(name: str, data: bytes) -> str:
    rows = list(csv.reader(io.StringIO(decode(data))))
    head = [f"=== CSV: {name} ==="] + (["\t".join(rows[0])] if rows else [])
    return "\n".join(head + ["\t".join(v for v in row if v != "") for row in rows[1:]])


def parse_docx(name: str, data: bytes) -> str:
    """Non-blank paragraphs outside tables, then each table under a numbered heading."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    text = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out = [t for p in body.findall(f"{_W}p") if (t := text(p)).strip()]
    for k, table in enumerate(body.findall(f"{_W}tbl"), 1):
        out.append(f"\n=== TABLE {k} ===")
        out += ["\t".join(text(cell).strip() for cell in row.findall(f"{_W}tc")) for row in table.findall(f"{_W}tr")]
    return "\n".join(out)


def parse_pptx(name: str, data: bytes) -> str:
    box = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in box.namelist() if n.startswith("ppt/slides/slide") and n.endswith(".xml")), key=lambda n: int("".join(filter(str.isdigit, n.rsplit("/", 1)[1]))))
    out = [f"=== POWERPOINT: {name} ==="]
    for k, slide in enumerate(slides, 1):
        out.append(f"\n=== SLIDE {k} ===")
        for shape in ElementTree.fromstring(box.read(slide)).iter():
            if shape.tag.endswith("}txBody"):
                lines = ["".join(t.text or "" for t in p.iter(f"{_A}t")) for p in shape.iter(f"{_A}p")]
                if joined := "\n".join(lines).strip():
                    out.append(joined)
    return "\n".join(out)


def parse_xlsx(name: str, data: bytes) -> str:
    """Each sheet with cells under its heading; empty rows and sheets are left out."""
    box = zipfile.ZipFile(io.BytesIO(data))
    shared = []
    if "xl/sharedStrings.xml" in box.namelist():
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(box.read("xl/sharedStrings.xml")).findall(f"{_S}si")]
    part = {}  # a sheet's file is named by its relationship, whatever its place
    if "xl/_rels/workbook.xml.rels" in box.namelist():
        part = {r.get("Id"): r.get("Target").removeprefix("/xl/") for r in ElementTree.fromstring(box.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for k, found in enumerate(ElementTree.fromstring(box.read("xl/workbook.xml")).iter(f"{_S}sheet"), 1):
        sheet, key = found.get("name"), next((v for a, v in found.attrib.items() if a.endswith("}id")), None)
        rows = []
        for row in ElementTree.fromstring(box.read(f"xl/{part.get(key, f'worksheets/sheet{k}.xml')}")).iter(f"{_S}row"):
            cells = []
            for cell in row.findall(f"{_S}c"):
                value = cell.findtext(f"{_S}v") or "".join(t.text or "" for t in cell.iter(f"{_S}t"))
                cells.append(shared[int(value)] if cell.get("t") == "s" and value else value)
            if any(cells):
                rows.append("\t".join(v for v in cells if v))
        if rows:
            out += [f"=== SHEET: {sheet} ===", *rows]
    return "\n".join(out)


PARSERS: dict[str, Parser] = {"txt": lambda name, data: decode(data), "csv": parse_csv, "docx": parse_docx, "pptx": parse_pptx, "xlsx": parse_xlsx, "pdf": parse_pdf}


def list_files(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """path, name, ext, size, mtime, content of all files of a folder. Columns that aren't used are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(F.instr(name, ".") > 0, F.lower(F.substring_index(name, ".", -1))).otherwise("unknown")
    return files.select("path", name.alias("name"), ext.alias("ext"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def extract_text(name: Column, ext: Column, content: Column, parsers: dict[str, Parser] | None = None) -> Column:
    """A struct (text, error). Other formats give the text ``Unsupported file type: .x``; a parser's error is kept, not raised."""
    known = PARSERS | (parsers or {})

    @F.arrow_udf("text string, error string")
    def run(names: pa.Array, exts: pa.Array, contents: pa.Array) -> pa.Array:
        texts, errors = [], []
        for n, e, x in zip(names.to_pylist(), exts.to_pylist(), contents.to_pylist(), strict=True):
            try:
                texts.append(known[e](n, x or b"") if e in known else f"Unsupported file type: .{e}")
                errors.append(None)
            except Exception as problem:  # noqa: BLE001  one bad file must not end the job
                texts.append("")
                errors.append(f"{type(problem).__name__}: {problem}")
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["text", "error"])

    return run(name, ext, content)


def ocr_pages(pages: DataFrame, engines: tuple[Callable[[bytes], str], ...]) -> DataFrame:
    """Page texts of images (doc, page, image) by the first engine that gives any; marked if none or failed."""

    @F.arrow_udf("string")
    def run(images: pa.Array) -> pa.Array:
        out = []
        for image in images.to_pylist():
            text, failed = "", None
            for engine in engines:
                try:
                    if (text := engine(image) or "").strip():
                        break
                except Exception as problem:  # noqa: BLE001
                    failed = problem
            out.append(text if text.strip() else f"[OCR extraction failed: {failed}]" if failed else "[No text extracted]")
        return pa.array(out, pa.string())

    marked = F.format_string("=== PAGE %d ===\n%s\n", "page", run(F.col("image")))
    return pages.select("doc", F.struct("page", marked.alias("t")).alias("p")).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "\n").alias("text"))


def ocr_directory(spark: SparkSession, folder: str, read: Callable[[bytes], tuple[str, int]], out: str, settings: dict[str, str] | None = None) -> DataFrame:
    """The job over all PDF files of a folder. ``read`` gives a file's text and number of pages. Texts go to ``out``/texts, a row of
    name and text each, results of all files to ``out``/files, and one summary row, which is returned, to ``out``/summary, as JSON."""

    @F.arrow_udf("success boolean, error string, text string, pages int")
    def run(contents: pa.Array) -> pa.Array:
        rows = []
        for data in contents.to_pylist():
            try:
                text, pages = read(data)
                rows.append((True, None, text, pages))
            except Exception as problem:  # noqa: BLE001
                rows.append((False, f"{type(problem).__name__}: {problem}", "", 0))
        kinds = (("success", pa.bool_()), ("error", pa.string()), ("text", pa.string()), ("pages", pa.int32()))
        return pa.StructArray.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * 4, kinds, strict=True)], [n for n, _ in kinds])

    files = list_files(spark, folder, recursive=False, pattern="*.pdf")
    if files.select("name").isEmpty():
        return spark.createDataFrame([(False, "No PDF files found")], "success boolean, error string")
    files.select("name", run("content").alias("x")).select("name", "x.*").write.parquet(f"{out}/read")
    done = spark.read.parquet(f"{out}/read")  # engines are slow: each file is read once
    done.where("success").select(F.concat(F.regexp_replace("name", r"\.[^.]*$", ""), F.lit("_ocr_extracted.txt")).alias("file"), "text").write.json(f"{out}/texts")
    done.select("name", "success", "error", "pages", F.length("text").alias("total_characters")).write.json(f"{out}/files")
    sums = [F.count("*").alias("total_files"), F.count_if("success").alias("successful_files"), F.sum("pages").alias("total_pages_processed"), F.sum(F.length("text")).alias("total_characters_extracted")]
    given = F.to_json(F.create_map(*[F.lit(x) for pair in settings.items() for x in pair])) if settings else F.lit(None).cast("string")
    done.agg(*sums).select(F.lit(folder).alias("input_directory"), F.lit(out).alias("output_directory"), "*", given.alias("ocr_settings")).write.json(f"{out}/summary")
    return spark.read.json(f"{out}/summary")


def page_markers(pages: Column) -> Column:
    """An array of page texts as one text with page markers; blank pages keep their number but are left out."""
    marked = F.transform(pages, lambda t, i: F.when(F.trim(t) != "", F.concat(F.lit("=== PAGE "), (i + 1).cast("string"), F.lit(" ===\n"), t)))
    return F.array_join(F.array_compact(marked), "\n\n")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """A CSV, or a folder of them, with a question column under any case; blank questions are left out. Files that are no UTF-8 are read as
    latin-1."""
    sound = spark.read.format("binaryFile").load(path).select("path", F.expr("is_valid_utf8(cast(content as string))").alias("sound")).collect()  # a row a file
    parts = []
    for encoding, files in (("UTF-8", [r["path"] for r in sound if r["sound"]]), ("ISO-8859-1", [r["path"] for r in sound if not r["sound"]])):
        if files:
            part = spark.read.csv(files, header=True, multiLine=True, escape='"', encoding=encoding)
            parts.append(part.toDF(*[c.lower() for c in part.columns]))
    if not parts:
        raise ValueError("there is no file")
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if "question" not in rows.columns:
        raise ValueError("the file has no question column")
    return rows.where(F.trim("question") != "")


def read_chunks(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Stored chunks with the optional columns that the store has."""
    return _chunk_columns(spark.read.parquet(path), limit)


def read_chunks_jdbc(spark: SparkSession, url: str, table: str = "chunks", limit: int | None = None, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """Chunks of a database, columns as for ``read_chunks``; ``limit`` and columns reach the database. ``split`` (column, lowest,
    highest, number of parts) reads in parallel; without it one task reads all."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if split:
        reader = reader.options(**dict(zip(("partitionColumn", "lowerBound", "upperBound", "numPartitions"), map(str, split), strict=True)))
    return _chunk_columns(reader.load(), limit)


class SqliteSource(DataSource):
    """Format ``docspark_sqlite``: a table of an SQLite file, by ranges of its row ids; options path, table and parts. The file must
    be visible to all workers under one path. Columns that are not TEXT, INTEGER or REAL are read as text."""

    @classmethod
    def name(cls) -> str:
        return "docspark_sqlite"

    def _connect(self):  # noqa: ANN202
        import sqlite3

        path = self.options["path"].removeprefix("file://")
        return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)

    def schema(self) -> str:
        kinds = {"INTEGER": "bigint", "INT": "bigint", "BIGINT": "bigint", "REAL": "double"}
        with closing(self._connect()) as db:
            columns = db.execute("SELECT name, type FROM pragma_table_info(?)", [self.options.get("table", "chunks")]).fetchall()
        if not columns:
            raise ValueError("the table does not exist")
        return ", ".join(f"`{name}` {kinds.get(kind.upper(), 'string')}" for name, kind in columns)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(self, schema)


class SqliteReader(DataSourceReader):
    def __init__(self, source: SqliteSource, schema: StructType) -> None:
        self.source, self.schema, self.table = source, schema, source.options.get("table", "chunks").replace('"', '""')

    def partitions(self) -> list[InputPartition]:
        with closing(self.source._connect()) as db:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        if low is None:
            return [InputPartition((0, -1))]
        step = max(1, -(-(high - low + 1) // int(self.source.options.get("parts", "8"))))
        return [InputPartition((a, min(high, a + step - 1))) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        names = ", ".join('"' + f.name.replace('"', '""') + '"' for f in self.schema)
        text = [f.dataType.simpleString() == "string" for f in self.schema]
        with closing(self.source._connect()) as db:
            for row in db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', partition.value):
                yield tuple(str(v) if t and v is not None else v for v, t in zip(row, text, strict=True))


def read_chunks_sqlite(spark: SparkSession, path: str, table: str = "chunks", limit: int | None = None) -> DataFrame:
    """Chunks of an SQLite file, columns as for ``read_chunks``, without a driver of its own."""
    spark.dataSource.register(SqliteSource)
    return _chunk_columns(spark.read.format("docspark_sqlite").option("table", table).load(path), limit)


def _chunk_columns(rows: DataFrame, limit: int | None) -> DataFrame:
    picked = rows.select(*[c for c in ("chunk_id", "content", "filename", "page_number", "chunk_index") if c in rows.columns])
    return picked.limit(limit) if limit else picked


def read_terminology(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("term string, standard_spelling string, acronym string, expanded string, aliases array<string>, common_misspellings array<string>").json(path, multiLine=True)
