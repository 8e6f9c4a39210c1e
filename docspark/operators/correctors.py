"""Spelling correctors with fuzzy terms and a word list: the enhanced one, the command line's, the latest script's.

Every different token is judged once, by joins with the terminology and the word list (see ``dictionary``), both of any size. What is
altered goes back to the texts: by broadcast if that is little, else each document gets those of its tokens that are. Unaltered tokens
are not shuffled back, but for some that a sieve of bits lets through.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from docspark.functions.scalars import join_hyphens, unicode_normalise
from docspark.operators.dictionary import fuzzy_terms, halves, suggestions
from docspark.operators.parts import by_parts
from docspark.operators.phrases import protected
from docspark.operators.spelling import _LOOKUP, lookups, terminology
from docspark.plans.fixtures import load
from docspark.registry import query
from docspark.scratch import written

c = F.col
#: Altered tokens that are broadcast, and their bytes, at most.
MOST, MOST_BYTES = 1_000_000, 64 << 20
#: Bytes that the offsets, flags and the key of an altered token take.
ROW_BYTES = 29
#: The most bits of a sieve that keeps unaltered tokens from being shuffled.
SIEVE_BITS = 1 << 28
#: The least ratios, in percent, of a fuzzy term, and the labels of what is done.
CUTOFF = {"enhanced": 92, "command_line": 95, "latest": 90}
LABELS = {
    "enhanced": ("too_short", "compound_term", "numeric", "protected_term", "exact_match", "levenshtein_skip", "common_word_protected", "fuzzy_match", "spellcheck_levenshtein_skip", "conservative_spellcheck", "no_correction"),
    "command_line": ("too_short", "compound_term", "protected_term", "exact_match", "fuzzy_match", "conservative_spellcheck", "no_correction"),
    "latest": ("phrase", "compound_term", "exact_match", "fuzzy_match", "spellcheck"),
}
TOKEN = {"enhanced": re.compile(r"\b\w+\b|\W+"), "command_line": re.compile(r"[A-Za-z0-9][A-Za-z0-9_\-'/]*"), "latest": re.compile(r"[A-Za-z0-9][A-Za-z0-9_\-'/]*")}
RESULT = "text string, total_words int, corrections array<struct<position:int,original:string,corrected:string,method:string>>"
ALTERED = "array<struct<token:string,new:string,changed:boolean,method:string,parts:array<string>>>"


def _upper(x: Column) -> Column:
    return (F.upper(x) == x) & (F.lower(x) != x)


def _guarded(token: Column, protected_words: tuple[str, ...]) -> Column:
    """Protected words, codes of a letter and digits, words in capitals and capitalised ones."""
    rest = F.substring(token, F.lit(2), F.length(token))
    capitalised = _upper(F.substring(token, 1, 1)) & (F.lower(rest) == rest) & (F.upper(rest) != rest)
    return F.lower(token).isin(*protected_words, "") | F.lower(token).rlike(r"^[a-z]\d+[a-z]?$") | _upper(token) | capitalised


def judge(tokens: DataFrame, entries: DataFrame, known: DataFrame, variant: str = "enhanced", protected_words: tuple[str, ...] = (), common: frozenset[str] = frozenset()) -> DataFrame:
    """(token, new, changed, method, parts) of each different token; ``parts`` is what a text gets for it.

    ``entries`` as for ``lookups``; ``known`` has word and, for ties, count; ``common`` are words that no term replaces.
    """
    if variant not in CUTOFF:
        raise ValueError(f"unknown corrector {variant}")
    terms = written(lookups(entries).select("word", c("correction").alias("right")), "terms")
    count = c("count") if "count" in known.columns else F.lit(1).alias("count")
    words = written(known.select(F.lower("word").alias("word"), count).groupBy("word").agg(F.max("count").alias("count")), "words")
    rows = tokens.where("token <> ''").select("token").distinct()
    t, low, n, apart = c("token"), c("low"), F.length("token"), c("token").rlike("[-/_]")
    whole, lookup = variant == "enhanced", variant == "latest"
    if whole:
        first = F.when(n < 2, "too_short").when(apart, "compound_term").when(t.rlike(r"^[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}-\x{2079}\x{2080}-\x{2089}]+$"), "numeric").when(_guarded(t, protected_words), "protected_term")
    elif lookup:
        first = F.when(t.contains("_"), "phrase").when(t.rlike("[-/]"), "compound_term")
    else:
        first = F.when(n <= 2, "too_short").when(apart, "compound_term").when(_guarded(t, protected_words), "protected_term")
    key = F.when(t.contains("_"), F.lower(F.replace(t, F.lit("_"), F.lit(" ")))).otherwise(F.lower(t)) if lookup else F.lower(t)
    rows = rows.select("token", key.alias("low"), first.alias("method")).join(terms.select(c("word").alias("low"), c("right").alias("exact")), "low", "left")
    rows = written(rows, "tokens")
    open_ = rows.where(c("method").isNull() & c("exact").isNull()).select(low.alias("token")).distinct()
    fuzzy = written(fuzzy_terms(open_, terms, CUTOFF[variant]).join(terms, "word").select(c("token").alias("low"), c("word").alias("form"), c("right").alias("alike")), "fuzzy")
    rest = open_.join(fuzzy.select(c("low").alias("token")), "token", "left_anti")
    guess = suggestions(rest, words).select(c("token").alias("low"), c("word").alias("guess"))
    guess = guess.join(terms.select(c("word").alias("guess"), c("right").alias("term")), "guess", "left").select("low", "guess", F.coalesce("term", "guess").alias("guessed"))
    rows = rows.join(fuzzy, "low", "left").join(written(guess, "guesses"), "low", "left")

    is_exact, is_alike, has_guess = c("exact").isNotNull(), c("alike").isNotNull(), c("guess").isNotNull()
    kept = lambda label: F.struct(t.alias("new"), F.lit(False).alias("changed"), F.lit(label).alias("method"))
    made = lambda new, label, changed=F.lit(True): F.struct(new.alias("new"), changed.alias("changed"), F.lit(label).alias("method"))
    differs = lambda x: F.coalesce(x != t, F.lit(False))
    stays = F.when(c("method").isNotNull(), F.struct(t.alias("new"), F.lit(False).alias("changed"), c("method").alias("method")))
    exact = made(c("exact"), "exact_match", differs(c("exact")))
    if whole:
        in_common = (lambda x: x.isin(*common)) if common else (lambda _: F.lit(False))
        near = F.levenshtein("low", "guess")
        found = stays.when(is_exact, exact)
        found = found.when(is_alike & (F.levenshtein("low", "form") <= 1), kept("levenshtein_skip"))
        found = found.when(is_alike & in_common(low) & ~in_common(F.lower("alike")), kept("common_word_protected")).when(is_alike, made(c("alike"), "fuzzy_match"))
        tried = has_guess & (~_upper(F.substring(t, 1, 1)) | (n <= 4))
        found = found.when(tried & (near <= 1) & ~((n > 6) & (near == 1)), kept("spellcheck_levenshtein_skip")).when(tried, made(c("guessed"), "conservative_spellcheck")).otherwise(kept("no_correction"))
    elif lookup:
        phrase = F.replace(t, F.lit("_"), F.lit(" "))
        found = F.when(c("method") == "phrase", made(F.coalesce("exact", phrase), "phrase")).when(c("method").isNotNull(), kept("compound_term")).when(is_exact, exact)
        found = found.when(is_alike, made(c("alike"), "fuzzy_match", differs(c("alike"))))
        spelt = F.coalesce("guessed", "low")  # the speller knows lower case alone
        found = found.otherwise(made(spelt, "spellcheck", differs(spelt)))
    else:
        found = stays.when(is_exact, exact).when(is_alike, made(c("alike"), "fuzzy_match"))
        found = found.when(has_guess & (F.length("guess") >= F.length("low") - 1), made(c("guessed"), "conservative_spellcheck")).otherwise(kept("no_correction"))
    judged = rows.select("token", found.alias("x")).select("token", "x.*")
    if whole:
        return judged.withColumn("parts", F.array("new"))
    judged = written(judged, "judged")
    asked = judged if lookup else judged.where("changed")
    split = halves(asked.select(c("new").alias("token")), terms.select("word").union(words.select("word")), 4)
    judged = judged.join(split.select(c("token").alias("new"), "left", "right"), "new", "left").join(terms.select(c("word").alias("short")), (F.length("new") <= 2) & (F.lower("new") == c("short")), "left")
    cut = c("left").isNotNull() if lookup else c("left").isNotNull() & c("changed")
    good = ~c("new").rlike(r"(?U)^[\W_]+$") & ((F.length("new") > 2) | c("short").isNotNull())
    parts = F.when(cut, F.array("left", "right")).when(good, F.array("new")).otherwise(F.array().cast("array<string>"))
    return judged.select("token", "new", "changed", "method", parts.alias("parts"))


def _tokens(text: Column, variant: str, sieve: Broadcast | None = None) -> Column:
    """The different tokens of a text; of a ``sieve``, see ``sieved``, those that it lets through."""
    find = TOKEN[variant].findall

    def kept(tokens: set[str]) -> set[str]:
        if sieve is None:
            return tokens
        bits = sieve.value
        last = 8 * len(bits) - 1
        return {t for t in tokens if bits[(at := zlib.crc32(t.encode()) & last) >> 3] >> (at & 7) & 1}

    @F.arrow_udf("array<string>")
    def run(x: pa.Array) -> pa.Array:
        return by_parts(x, lambda ts: [sorted(kept(set(find(v or "")))) for v in ts], pa.list_(pa.string()))

    return run(text)


def sieved(tokens: DataFrame, count: int, most: int = SIEVE_BITS) -> Broadcast:
    """Bits, some 32 for each of ``count`` tokens but ``most`` at most, of which those at the tokens' CRC-32 are set."""
    bits = min(most, max(1 << 10, 1 << (32 * count).bit_length()))
    at = F.crc32("token").bitwiseAND(F.lit(bits - 1))
    words = tokens.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at & 63)))").alias("bits")).toArrow()
    held = np.zeros(bits >> 6, "<i8")
    held[words["word"].to_numpy()] = words["bits"].to_numpy()
    return tokens.sparkSession.sparkContext.broadcast(held.tobytes())


def put_together(text: str, variant: str, known: dict) -> dict:
    """A text with its altered tokens replaced, and what was done. The enhanced corrector keeps what is between words, the others join
    tokens by spaces."""
    whole, out, done, total = variant == "enhanced", [], [], 0
    for k, token in enumerate(TOKEN[variant].findall(text)):
        if whole and not re.match(r"\w", token):
            out.append(token)
            continue
        total += 1
        found = known.get(token)
        if found is None:
            out.append(token)
            continue
        if found["changed"]:
            done.append({"position": k, "original": token, "corrected": found["new"], "method": found["method"]})
        out += found["parts"]
    return {"text": ("" if whole else " ").join(out), "total_words": total, "corrections": done}


def shared(altered: DataFrame) -> Broadcast:
    """Altered tokens as the bytes of one Arrow table, in order of the tokens' CRC-32: nothing holds an object for each."""
    table = altered.select(F.crc32("token").alias("code"), "token", "new", "changed", "method", "parts").toArrow()
    table = table.take(np.argsort(table["code"].to_numpy()))
    table = table.set_column(4, "method", table["method"].dictionary_encode()).combine_chunks()  # a worker looks up in one piece
    size = pa.MockOutputStream()  # bytes are allocated once, as a buffer that grows would take some three times as many
    with pa.ipc.new_stream(size, table.schema) as out:
        out.write_table(table)
    buffer = pa.allocate_buffer(size.size())
    with pa.ipc.new_stream(pa.FixedSizeBufferWriter(buffer), table.schema) as out:
        out.write_table(table)
    del table
    return altered.sparkSession.sparkContext.broadcast(buffer.to_pybytes())


def found_in(table: pa.Table, tokens: set[str]) -> dict[str, dict]:
    """The rows of ``tokens`` in a table that ``shared`` has made, and others of their codes."""
    codes, asked = table["code"].to_numpy(), np.array([zlib.crc32(t.encode()) for t in tokens], np.int64)
    low, high = np.searchsorted(codes, asked), np.searchsorted(codes, asked, "right")
    n = high - low
    rows = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return {r["token"]: r for r in table.take(rows).to_pylist()}


def replaced(texts: DataFrame, judged: DataFrame, variant: str, most: int = MOST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``texts`` (doc_id, text) with what ``judge`` says of their tokens put in: doc_id, corrected, total_words, corrections."""
    altered = written(judged.where(c("changed") | (F.size("parts") != 1) | (c("parts")[0] != c("token"))), "altered")
    kind = pa.struct(list(to_arrow_schema(DataType.fromDDL(RESULT))))
    count, size = altered.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("token") + F.octet_length("new") + F.octet_length(F.array_join("parts", "    ")) + ROW_BYTES), F.lit(0))).first()
    if count <= most and size <= most_bytes:
        held, find = shared(altered), TOKEN[variant].findall

        @F.arrow_udf(RESULT)
        def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = pa.ipc.open_stream(held.value).read_all()

            def fixed(ts: list[str | None]) -> list[dict | None]:
                known = found_in(table, {token for t in ts if t for token in find(t)})
                return [None if t is None else put_together(t, variant, known) for t in ts]

            for batch in batches:
                yield by_parts(batch, fixed, kind)

        return texts.select("doc_id", run(c("text")).alias("x")).select("doc_id", c("x.text").alias("corrected"), "x.total_words", "x.corrections")

    @F.arrow_udf(RESULT)
    def run_own(texts: pa.Array, own: pa.Array) -> pa.Array:
        return by_parts(texts, lambda ts, found: [None if t is None else put_together(t, variant, {r["token"]: r for r in rows or ()}) for t, rows in zip(ts, found, strict=True)], kind, own)

    # each different text by its hash; a text gets those of its tokens that are altered
    hashed = texts.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    met = hashed.select("hash", F.explode(_tokens(c("text"), variant, sieved(altered, count))).alias("token")).distinct().join(altered, "token")
    own = met.groupBy("hash").agg(F.collect_list(F.struct("token", "new", "changed", "method", "parts")).cast(ALTERED).alias("own"))
    return hashed.join(own, "hash", "left").select("doc_id", run_own("text", "own").alias("x")).select("doc_id", c("x.text").alias("corrected"), "x.total_words", "x.corrections")


def correct(docs: DataFrame, entries: DataFrame, known: DataFrame, variant: str = "enhanced", protected_words: tuple[str, ...] = (), common: frozenset[str] = frozenset(), most: int = MOST) -> DataFrame:
    """``docs`` (doc_id, text) with corrected text, the number of words and the corrections. Null texts stay null."""
    if variant not in CUTOFF:
        raise ValueError(f"unknown corrector {variant}")
    text = c("text")
    if variant != "enhanced":
        text = protected(join_hyphens(unicode_normalise(text)), lookups(entries).select(c("word").alias("phrase")))
    texts = docs.select("doc_id", text.alias("text"))
    texts = texts if variant == "enhanced" else written(texts, "texts")
    tokens = texts.select(F.explode(_tokens(c("text"), variant)).alias("token"))
    return replaced(texts, judge(tokens, entries, known, variant, protected_words, common), variant, most)


def conservative_lookups(entries: DataFrame, common: frozenset[str] = frozenset()) -> DataFrame:
    """(word, right, kind): misspellings (kind 0) before terms, aliases and expanded forms (kind 1), one row a word. Misspellings that are
    ``common`` words, the term or its standard spelling are none; entries with a value "NaN" are left out."""
    nan = [F.coalesce(c(x) == "NaN", F.lit(False)) for x in ("term", "standard_spelling", "acronym", "expanded")]
    term, right = F.trim(F.coalesce("term", F.lit(""))), F.trim(F.coalesce("standard_spelling", "term", F.lit("")))
    rows = entries.where(~(nan[0] | nan[1] | nan[2] | nan[3])).withColumn("term", term).withColumn("right", right).where("term <> '' and right <> ''")
    listed = lambda x: F.coalesce(x, F.array().cast("array<string>"))
    lists = ((0, listed(c("common_misspellings"))), (1, F.concat(F.array("term", "expanded"), listed(c("aliases")))))
    parts = [rows.select("term", "right", F.lit(k).alias("kind"), F.explode(x).alias("word")).withColumn("word", F.trim(F.lower("word"))) for k, x in lists]
    wrong = parts[0].where((c("word") != F.lower("term")) & (c("word") != F.lower("right")))
    found = (wrong.where(~c("word").isin(*common)) if common else wrong).union(parts[1]).where("word <> ''")
    return found.groupBy("word").agg(F.min(F.struct("kind", "right")).alias("m")).select("word", "m.right", "m.kind")


def correct_conservative(docs: DataFrame, entries: DataFrame, common: frozenset[str] = frozenset(), most: int = MOST) -> DataFrame:
    """As ``correct``, by known misspellings and the standard case of known terms alone; nothing fuzzy, no word of one character."""
    texts = docs.select("doc_id", "text")
    tokens = texts.select(F.explode(_tokens(c("text"), "enhanced")).alias("token")).where(F.length("token") >= 2).distinct()
    met = tokens.withColumn("word", F.lower("token")).join(conservative_lookups(entries, common), "word").where((c("kind") == 0) | (c("right") != c("token")))
    method = F.when(c("kind") == 0, "exact_misspelling_correction").otherwise("case_standardization")
    return replaced(texts, met.select("token", c("right").alias("new"), F.lit(True).alias("changed"), method.alias("method"), F.array("right").alias("parts")), "enhanced", most)


# --- queries ---------------------------------------------------------------------------------------------


def frequent_words(s: SparkSession, d: str, least: int = 100) -> DataFrame:
    tokens = load(s, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    return tokens.groupBy("word").count().where(c("count") >= least)


for _variant in CUTOFF:

    @query(f"spelling_{_variant}")
    def _(s: SparkSession, d: str, variant: str = _variant) -> DataFrame:
        x = correct(load(s, d, "documents").select("doc_id", "text"), terminology(s), frequent_words(s, d), variant)
        return x.select("doc_id", F.md5("corrected").alias("corrected_md5"), "total_words", F.size("corrections").alias("n_corrections"))


#: Words that are no misspellings, whatever the terminology says.
COMMON = ("the", "one", "and")


@query("spelling_conservative", rf"""WITH {_LOOKUP.split('rt AS')[0]}
st AS (SELECT trim(coalesce(term, '')) AS term, trim(coalesce(standard, term, '')) AS "right", aliases, wrong FROM en WHERE coalesce(trim(term), '') <> '' AND trim(coalesce(standard, term)) <> ''),
fm AS (SELECT trim(lower(w)) AS word, "right", 0 AS kind FROM (SELECT unnest(wrong) AS w, term, "right" FROM st) WHERE trim(lower(w)) NOT IN {COMMON} AND trim(lower(w)) NOT IN (lower(term), lower("right"))
  UNION ALL SELECT trim(lower(w)), "right", 1 FROM (SELECT unnest(list_concat([term], aliases)) AS w, "right" FROM st)),
lk AS (SELECT word, arg_min("right", (kind, "right")) AS "right", min(kind) AS kind FROM fm WHERE word <> '' GROUP BY 1),
tk AS (SELECT doc_id, unnest(ts) AS tok, unnest(range(0, len(ts))) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[\pL\pN_]+|[^\pL\pN_]+') AS ts FROM documents)),
nw AS (SELECT doc_id, pos, tok, kind IS NOT NULL AND (kind = 0 OR "right" <> tok) AS changed, "right" FROM tk LEFT JOIN lk ON word = lower(tok) AND length(tok) >= 2)
SELECT d.doc_id, md5(any_value(CASE WHEN d.text = '' THEN '' END)) AS empty_md5, md5(string_agg(CASE WHEN changed THEN "right" ELSE tok END, '' ORDER BY pos)) AS corrected_md5, count(*) FILTER (changed) AS n_corrections
FROM documents d LEFT JOIN nw USING (doc_id) GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = load(s, d, "documents").select("doc_id", "text")
    x = correct_conservative(docs, terminology(s), frozenset(COMMON))
    size = F.coalesce(F.size("corrections"), F.lit(0)).cast("long")
    return x.select("doc_id", F.md5(F.when(c("corrected") == "", "")).alias("empty_md5"), F.md5(F.when(c("corrected") != "", c("corrected"))).alias("corrected_md5"), size.alias("n_corrections"))
