r"""Fill-in-middle transformation over an index of distinct texts.

Texts are keyed by their SHA-256; the texts of a key are gathered as a set, so equality is verified by content (two texts of one key
end the job). The ends of each text's lines, in code points, are computed once and kept as an Elias-Fano list: low bits packed, high
bits in unary, about two bits and log2 of the mean line length for each line. The list is joined back to the documents' ids, and each
seeded cut is two selections from it. Only ids and digests of documents meet the index: a text is shuffled once, without its copies.

A text with more than ``PART`` documents (1/65,536 of all, if that is more) is indexed once for each so many of them, so none of its
documents meet in one task; at most 65,536 digests of such texts are broadcast.

Form and cut: four numbers are read from a hash of seed and id; prefix and middle end after the smaller and the larger of two of them
modulo the number of lines plus one, the third and fourth decide between plain, ``spm`` and ``psm`` by percentages.

Defined results: a null text counts as empty; an empty text and one that holds a control string stay plain; a null id counts as the
empty text in the hash; rows alike in id and text give rows alike; other columns are not read; an empty table gives an empty table. A
text's length is bounded by a row's size only.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import materialise, table

SEED, RATE, SPM = 7, 100, 50
#: Control strings of prefix, suffix and middle.
CONTROL = ("<P>", "<S>", "<M>")
#: Documents that one entry of the index serves.
PART = 256


def elias_fano(values: np.ndarray) -> bytes:
    """A list of numbers that don't fall: count, low width, low bits, then a one for each number after as many zeros as its high part grows."""
    n, top = len(values), int(values[-1]) if len(values) else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    low = values[:, None] >> np.arange(width) & 1
    high = np.zeros((top >> width) + n, dtype=np.uint8)
    high[(values >> width) + np.arange(n)] = 1
    return struct.pack("<IB", n, width) + np.packbits(low.astype(np.uint8), bitorder="little").tobytes() + np.packbits(high, bitorder="little").tobytes()


def select(packed: bytes, index: int) -> int:
    """The number at a place of an Elias-Fano list."""
    n, width = struct.unpack_from("<IB", packed)
    if not 0 <= index < n:
        raise IndexError(index)
    start = 5 + (n * width + 7) // 8
    ones = np.cumsum(np.bitwise_count(np.frombuffer(packed, dtype=np.uint8, offset=start)), dtype=np.int64)
    byte = int(np.searchsorted(ones, index + 1))
    before = int(ones[byte - 1]) if byte else 0
    bit = np.flatnonzero(np.unpackbits(np.frombuffer(packed, dtype=np.uint8, count=1, offset=start + byte), bitorder="little"))[index - before]
    first = index * width
    low = int.from_bytes(packed[5 + first // 8 : 5 + (first + width + 7) // 8], "little") >> first % 8 & (1 << width) - 1
    return (byte * 8 + int(bit) - index) << width | low


def line_ends(text: str) -> np.ndarray:
    """0 and the end of each line of a text, in code points. A line ends after its line feed."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    ends = np.flatnonzero(points == 10) + 1
    return np.r_[0, ends, [len(points)] * bool(len(points) and points[-1] != 10)].astype(np.int64)


def boundaries(text: Column) -> Column:
    """A struct (n lines, ends) of a column of texts: the number of lines and the Elias-Fano list of their n + 1 boundaries."""

    @F.arrow_udf("n bigint, ends binary")
    def run(x: pa.Array) -> pa.Array:
        n, packed = [], []
        for value in x:
            ends = line_ends(value.as_py() or "")
            n.append(len(ends) - 1)
            packed.append(elias_fano(ends))
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(packed, pa.binary())], ["n", "ends"])

    return run(text)


def selected(ends: Column, low: Column, high: Column) -> Column:
    """A struct (low, high) of the boundaries at two places of a list."""

    @F.arrow_udf("low bigint, high bigint")
    def run(ends: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        found = [(select(e.as_py(), i), select(e.as_py(), j)) for e, i, j in zip(ends, low.to_pylist(), high.to_pylist(), strict=True)]
        return pa.StructArray.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["low", "high"])

    return run(ends, low, high)


def _digest(text: Column) -> Column:
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))  # never null, which spares a filter that would compute it again


def _dealt(docs: DataFrame, key: str, text: str, digest, size: int) -> DataFrame:
    """(id, text, digest, part) of all rows; documents of a frequent text are dealt to parts."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size, hashed = max(size, docs.count() >> 16), F.xxhash64("text")
    counts = rows.groupBy(hashed.alias("hash")).agg(F.count("*").alias("n"))
    frequent = materialise(counts.where(F.col("n") > size).select("hash", F.ceil(F.col("n") / size).alias("parts")), "frequent")
    met = rows.join(F.broadcast(frequent), hashed == frequent["hash"], "left")
    return met.select("id", "text", digest(F.col("text")).alias("digest"), F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).alias("part"))


def text_index(dealt: DataFrame) -> DataFrame:
    """(digest, part, text) of distinct texts, each of which is its digest's only one."""
    texts = dealt.groupBy("digest", "part").agg(F.collect_set("text").alias("texts"))
    one = F.when(F.size("texts") == 1, F.element_at("texts", 1)).otherwise(F.raise_error(F.lit("two texts share a digest")))
    return texts.select("digest", "part", one.alias("text"))


def seeded(key: Column, seed: int, k: int) -> Column:
    """The k-th number, from 0, of a document: eight hexadecimal digits of a hash."""
    said = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(said, 8 * k + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM, digest=_digest, part: int = PART) -> DataFrame:
    """(the id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``; ``rate`` percent are cut, ``spm`` percent of them suffix first."""
    dealt = _dealt(docs, key, text, digest, part)
    index = text_index(dealt)
    ids = dealt.groupBy("digest", "part", "id").agg(F.count("*").alias("rows"))
    # lists are a relation of their own: the texts then stay where they were gathered, and cuts come to them
    listed = ids.join(index.select("digest", "part", boundaries(F.col("text")).alias("lines")), ["digest", "part"])
    h1, h2, h3, h4 = (seeded(F.col("id"), seed, k) for k in range(4))
    n = F.col("lines.n")
    places = [f(F.pmod(h1, n + 1), F.pmod(h2, n + 1)) for f in (F.least, F.greatest)]
    cuts = listed.select("digest", "part", "id", "rows", n.alias("n"), selected(F.col("lines.ends"), *places).alias("cut"))
    plain = (F.col("n") == 0) | F.col("text").rlike("|".join(CONTROL)) | (F.pmod(h3, F.lit(100)) >= rate)
    form = F.when(plain, "plain").when(F.pmod(h4, F.lit(100)) < spm, "spm").otherwise("psm")
    cut = cuts.join(index, ["digest", "part"]).withColumn("form", form)
    low, high = F.col("cut.low"), F.col("cut.high")
    parts = [F.substring("text", F.lit(1), low.cast("int")), F.substring("text", high.cast("int") + 1, F.length("text")), F.substring("text", low.cast("int") + 1, (high - low).cast("int"))]
    prefix, suffix, middle = (F.concat(F.lit(c), p) for c, p in zip(CONTROL, parts, strict=True))
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(prefix, suffix, middle)).otherwise(F.concat(suffix, prefix, middle))
    chars = [F.when(F.col("form") != "plain", x) for x in (low, high - low)]
    done = cut.select("id", "rows", "n", "form", chars[0].alias("prefix_chars"), chars[1].alias("middle_chars"), output.alias("output"))
    again = F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))
    return done.select("*", again.alias("row")).select(F.col("id").alias(key), "n", "form", "prefix_chars", "middle_chars", "output")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, from output and form alone."""
    parts = F.split(output, "|".join(CONTROL), 4)
    at = lambda k: F.element_at(parts, k)
    return F.when(form == "plain", output).when(form == "psm", F.concat(at(2), at(4), at(3))).otherwise(F.concat(at(3), at(4), at(2)))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form, cut and digests of every document."""
    found = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digests = [F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


#: Cuts lists of lines; the restored text is that of the table.
OP11_SQL = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
cut AS (
  SELECT *, len(ls) AS n, [('0x' || substr(h, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS hs
  FROM (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS ls FROM docs)),
placed AS (SELECT *, least(hs[1] % (n + 1), hs[2] % (n + 1)) AS i, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) AS j FROM cut),
parts AS (
  SELECT doc_id, n, text, array_to_string(ls[1:i], '') AS p, array_to_string(ls[i + 1:j], '') AS m, array_to_string(ls[j + 1:], '') AS s,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= {RATE} THEN 'plain'
      WHEN hs[4] % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM placed)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
