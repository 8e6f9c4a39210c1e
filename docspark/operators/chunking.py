"""Chunkers, as folds over arrays of pieces: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.scalars import chunk_uuid
from docspark.plans.fixtures import DOCUMENTS_SQL, documents
from docspark.registry import query

c = F.col
SIZE, MOST, LEAST = 500, 2000, 100


def _last(x: Column) -> Column:
    return F.element_at(x, -1)


def _front(x: Column) -> Column:
    return F.slice(x, 1, F.size(x) - 1)


def _pieces(t: Column, pattern: str) -> Column:
    return F.filter(F.transform(F.split(t, pattern), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def fold(parts: Column, kind: str, fits, join) -> Column:
    """Neighbouring parts joined while ``fits(current, part)`` holds. The array of what is closed grows once for each that closes,
    so the fold takes time in proportion to the parts and to what they hold."""
    start = F.struct(F.array().cast(f"array<{kind}>").alias("done"), F.lit(None).cast(kind).alias("now"))
    state = lambda done, now: F.struct(done.alias("done"), now.alias("now"))
    closed = lambda acc: F.when(acc["now"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["now"])))
    step = lambda acc, x: F.when(acc["now"].isNotNull() & fits(acc["now"], x), state(acc["done"], join(acc["now"], x))).otherwise(state(closed(acc), x))
    return F.reduce(parts, start, step, closed)


def pack(pieces: Column, fits, joiner: str = " ") -> Column:
    """Join neighbouring pieces while ``fits(text so far, piece)`` holds."""
    return fold(pieces, "string", fits, lambda now, x: F.concat(now, F.lit(joiner), x))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge_short_tail(chunks: Column, joiner: str, least: int = LEAST, most: int = MOST) -> Column:
    """A last chunk under ``least`` characters joins the one before, if both together are not over ``most``."""

    def merged(x: Column) -> Column:
        before = F.try_element_at(x, F.lit(-2))
        short = (F.size(x) > 1) & (F.length(_last(x)) < least) & (F.length(before) + len(joiner) + F.length(_last(x)) <= most)
        return F.when(short, F.concat(F.slice(x, 1, F.greatest(F.lit(0), F.size(x) - 2)), F.array(F.concat(before, F.lit(joiner), _last(x))))).otherwise(x)

    return let(chunks, merged)


def sentence_pack(t: Column, size: int = SIZE) -> Column:
    """Sentences cut at full stops (which are lost), packed; the joining space is not counted."""
    return pack(_pieces(t, r"\."), lambda cur, x: F.length(cur) + F.length(x) <= size)


def sentence_split(t: Column, size: int = SIZE) -> Column:
    """Sentences cut after ``.!?`` and white space, packed up to ``size``; a short tail joins the chunk before."""
    return merge_short_tail(pack(_pieces(t, r"[.!?]+\s+"), lambda cur, x: F.length(cur) + 1 + F.length(x) <= size), " ")


def semantic(t: Column) -> Column:
    """Paragraphs packed up to ``MOST``; an oversized paragraph is cut into sentences, which stay closed."""
    paragraphs = let(_pieces(t, "\n\n"), lambda ps: F.when(F.size(ps) > 0, ps).otherwise(_pieces(t, "\n")))
    part = lambda x, open_: F.struct(x.alias("t"), F.lit(open_).alias("open"))
    parts = F.flatten(F.transform(paragraphs, lambda p: F.when(F.length(p) <= MOST, F.array(part(p, True))).otherwise(F.transform(sentence_split(p), lambda x: part(x, False)))))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    fits = lambda now, x: now["open"] & x["open"] & (F.length(now["t"]) + 2 + F.length(x["t"]) <= MOST)
    packed = fold(parts, "struct<t:string,open:boolean>", fits, lambda now, x: part(F.concat(now["t"], F.lit("\n\n"), x["t"]), True))

    def finished(x: Column) -> Column:
        texts = F.transform(x, lambda y: y["t"])
        return F.when((F.size(x) > 0) & last(x)["open"], merge_short_tail(texts, "\n\n")).otherwise(texts)

    return let(packed, finished)


def fixed(t: Column, name: Column, size: int = 1000) -> Column:
    """Fixed lengths, each under a header with the document's name."""
    n = F.length(t)
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.concat(F.lit("Document: "), name, F.lit("\n\n"), F.substr(t, i * size + 1, F.lit(size))))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def refine_paragraphs(t: Column) -> Column:
    """Paragraphs; those over 500 characters are cut at ``. `` and packed under 300."""
    short = lambda p: pack(F.filter(F.split(p, r"\. "), lambda x: F.trim(x) != ""), lambda cur, x: F.length(cur) + F.length(x) < 300, ". ")
    return F.flatten(F.transform(_pieces(t, "\n\n"), lambda p: F.when(F.length(p) > 500, short(p)).otherwise(F.array(p))))


def block_chunks(blocks: DataFrame, most: int = MOST) -> DataFrame:
    """Chunks of layout blocks (doc_id, page, pos, block_type, text) that never cross a page.

    Blocks other than plain text carry their page and type. A chunk closes before a block whose bare text
    would lift it over ``most``. Placeholders of drawings are left out, those of images too, though they may
    close a chunk.
    """
    raw = F.trim(F.coalesce(c("text"), F.lit("")))
    holder = F.startswith(raw, F.lit("Image ")) | F.startswith(raw, F.lit("Drawing/Graphic "))
    label = F.when(c("block_type") == "TEXT_BLOCK", raw).otherwise(F.concat(F.lit("[Page "), c("page").cast("string"), F.lit(", "), c("block_type"), F.lit("] "), raw))
    rows = blocks.where(~(F.startswith(F.coalesce("text", F.lit("")), F.lit("Drawing/Graphic ")) & (c("block_type") == "DRAWING")))
    rows = rows.select("doc_id", "page", F.struct("pos", F.when(holder | (raw == ""), "").otherwise(label).alias("t"), F.length(raw).alias("bare")).alias("b"))
    pages = rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("b")).alias("bs"))  # a page is bounded
    start = F.array().cast("array<struct<t:string,n:int>>")
    part = lambda t, n: F.struct(t.alias("t"), n.cast("int").alias("n"))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))

    def step(acc: Column, b: Column) -> Column:
        empty = b["t"] == ""
        glue = F.when((last(acc)["t"] == "") | empty, "").otherwise("\n")
        closes = (F.size(acc) == 0) | ((last(acc)["n"] + b["bare"] > most) & (last(acc)["t"] != ""))
        return F.when(closes, F.concat(acc, F.array(part(b["t"], F.length(b["t"]))))).otherwise(F.concat(_front(acc), F.array(part(F.concat(last(acc)["t"], glue, b["t"]), last(acc)["n"] + F.length(b["t"])))))

    folded = pages.select("doc_id", "page", F.posexplode(F.filter(F.reduce("bs", start, step), lambda x: x["t"] != "")).alias("page_chunk", "x"))
    return folded.select("doc_id", "page", "page_chunk", c("x.t").alias("content"))


# --- queries ---------------------------------------------------------------------------------------------

_TRIM = r"trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))"
PACK_SQL = lambda pieces, fits, joiner: f"list_reduce(list_transform({pieces}, lambda x: [x]), lambda acc, p: CASE WHEN {fits} THEN list_concat(acc[:-2], [acc[-1] || {joiner} || p[1]]) ELSE list_concat(acc, p) END)"
PIECES_SQL = lambda t, pattern: f"list_filter(list_transform(regexp_split_to_array({t}, '{pattern}'), lambda x: {_TRIM}), lambda x: x <> '')"
_SAFE = lambda pieces, expr: f"CASE WHEN len({pieces}) = 0 THEN []::VARCHAR[] ELSE {expr} END"
_TAIL = lambda l, j, n: f"CASE WHEN len({l}) > 1 AND length({l}[-1]) < {LEAST} AND length({l}[-2]) + {n} + length({l}[-1]) <= {MOST} THEN list_concat({l}[:-3], [{l}[-2] || {j} || {l}[-1]]) ELSE {l} END"


def _exploded(df: DataFrame, chunks: Column) -> DataFrame:
    x = df.select("id", "filename", F.posexplode(chunks).alias("chunk_index", "content"))
    return x.select("id", "chunk_index", F.length("content").alias("n_chars"), F.md5("content").alias("content_md5"), chunk_uuid(c("filename"), c("chunk_index"), c("content")).alias("uuid"))


def _chunk_sql(prelude: str, lists: str) -> str:
    return f"""WITH {DOCUMENTS_SQL}, {prelude} l AS ({lists}),
e AS (SELECT id, filename, unnest(cs) AS content, unnest(range(0, len(cs)))::INT AS chunk_index FROM l WHERE len(cs) > 0), h AS (SELECT *, md5(filename || '_' || chunk_index || '_' || content) AS h FROM e)
SELECT id, chunk_index, length(content)::INT AS n_chars, md5(content) AS content_md5, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS uuid FROM h"""


@query("chunk_sentence_pack", _chunk_sql(rf"p AS (SELECT id, filename, {PIECES_SQL('raw_text', '[.]')} AS ps FROM cat),", f"SELECT id, filename, {_SAFE('ps', PACK_SQL('ps', f'length(acc[-1]) + length(p[1]) <= {SIZE}', chr(39) + ' ' + chr(39)))} AS cs FROM p"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _exploded(documents(s, d), sentence_pack(c("raw_text")))


@query("chunk_sentence_split", _chunk_sql(rf"p AS (SELECT id, filename, {PIECES_SQL('raw_text', '[.!?]+[ \t\n\r\f\v]+')} AS ps FROM cat), q AS (SELECT id, filename, {_SAFE('ps', PACK_SQL('ps', f'length(acc[-1]) + 1 + length(p[1]) <= {SIZE}', chr(39) + ' ' + chr(39)))} AS xs FROM p),", f"SELECT id, filename, {_TAIL('xs', chr(39) + ' ' + chr(39), 1)} AS cs FROM q"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _exploded(documents(s, d), sentence_split(c("raw_text")))


@query("chunk_semantic", _chunk_sql(rf"""para AS (SELECT id, filename, unnest({PIECES_SQL("replace(raw_text, chr(10), chr(10) || chr(10))", chr(92) + "n" + chr(92) + "n")}) AS p, unnest(range(0, len({PIECES_SQL("replace(raw_text, chr(10), chr(10) || chr(10))", chr(92) + "n" + chr(92) + "n")}))) AS i FROM cat),
s1 AS (SELECT *, CASE WHEN length(p) <= {MOST} THEN [p] ELSE {PIECES_SQL('p', '[.!?]+[ \t\n\r\f\v]+')} END AS ps FROM para),
s2 AS (SELECT *, CASE WHEN length(p) <= {MOST} THEN [p] ELSE {PACK_SQL('ps', f'length(acc[-1]) + 1 + length(p[1]) <= {SIZE}', chr(39) + ' ' + chr(39))} END AS xs FROM s1),
s3 AS (SELECT id, filename, i, length(p) <= {MOST} AS op, CASE WHEN length(p) <= {MOST} THEN xs ELSE {_TAIL('xs', chr(39) + ' ' + chr(39), 1)} END AS ys FROM s2),
s4 AS (SELECT id, filename, flatten(list(list_transform(ys, lambda y: {{'t': y, 'op': op}}) ORDER BY i)) AS zs FROM s3 GROUP BY id, filename),
s5 AS (SELECT id, filename, list_reduce(list_transform(zs, lambda z: [z]), lambda acc, z: CASE WHEN acc[-1].op AND z[1].op AND length(acc[-1].t) + 2 + length(z[1].t) <= {MOST} THEN list_concat(acc[:-2], [{{'t': acc[-1].t || chr(10) || chr(10) || z[1].t, 'op': true}}]) ELSE list_concat(acc, z) END) AS fs FROM s4),
s6 AS (SELECT id, filename, fs[-1].op AS op, list_transform(fs, lambda f: f.t) AS xs FROM s5),""", f"SELECT id, filename, CASE WHEN op THEN {_TAIL('xs', 'chr(10) || chr(10)', 2)} ELSE xs END AS cs FROM s6"))
def _(s: SparkSession, d: str) -> DataFrame:
    """Lines stand for paragraphs, as the test documents have none."""
    return _exploded(documents(s, d), semantic(F.replace(c("raw_text"), F.lit("\n"), F.lit("\n\n"))))


@query("chunk_fixed", _chunk_sql("", "SELECT id, filename, list_transform(range(0, (length(raw_text) - 1) // 1000 + 1), lambda i: 'Document: ' || filename || chr(10) || chr(10) || substr(raw_text, i * 1000 + 1, 1000)) AS cs FROM cat WHERE length(raw_text) > 0"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _exploded(documents(s, d), fixed(c("raw_text"), c("filename")))


@query("chunk_refine_paragraphs", _chunk_sql(rf"""para AS (SELECT id, filename, unnest({PIECES_SQL("replace(raw_text, chr(10), chr(10) || chr(10))", chr(92) + "n" + chr(92) + "n")}) AS p, unnest(range(0, len({PIECES_SQL("replace(raw_text, chr(10), chr(10) || chr(10))", chr(92) + "n" + chr(92) + "n")}))) AS i FROM cat),
s1 AS (SELECT *, list_filter(string_split(p, '. '), lambda x: trim(x) <> '') AS ps FROM para),
s2 AS (SELECT id, filename, i, CASE WHEN length(p) <= 500 THEN [p] ELSE {PACK_SQL('ps', 'length(acc[-1]) + length(p[1]) < 300', chr(39) + '. ' + chr(39))} END AS xs FROM s1),""", "SELECT id, filename, flatten(list(xs ORDER BY i)) AS cs FROM s2 GROUP BY id, filename"))
def _(s: SparkSession, d: str) -> DataFrame:
    return _exploded(documents(s, d), refine_paragraphs(F.replace(c("raw_text"), F.lit("\n"), F.lit("\n\n"))))
