r"""Phrase collocation mining by suffix automata of shards.

A shard is a task's run of about ``SHARD`` words. Its generalised suffix automaton, cut at depth ``DEPTH``, has a state for each set of
end positions that phrases of at most so many words share. States and links are got by sorting: suffix links are the suffix tree of the
reversed sequences, so the words that end at each position, last word first, are sorted, and a node of that tree whose only child ends
as often as itself is one state with it. A state gives its phrases (the last words of its longest one) and their count of end positions.
Symbols are pairs of language and word, so that one automaton serves all languages and its phrases never mix them.

Counts are summed over shards in three passes over the texts, each of which leaves out what can't be part of a phrase that occurs
``LEAST`` times: words that are rarer, then pairs of neighbours that are rarer, then all phrases are counted. Words are counted exactly;
pairs by 64-bit hashes, which can only make a pair look more frequent. What is frequent reaches the tasks as a filter of 16 bits a key, of at
most ``FILTER_BITS`` bits (32 MB) however large the corpus: beyond some 10^8 keys it lets more rare phrases pass and the shuffle grows, while
the counts stay exact.

Subsumption goes along the suffix links: a phrase's longer ones are reached from it word by word, on the left by the link and on the right
by the prefix. A longer phrase is never more frequent than those between, so the neighbours by one word decide. All lookups of a phrase's parts
are joins; parts that more than 1/256 of all rows ask for are broadcast (fewer than 256 of them), so none meets in one task. The ranks
of a language are taken among the first ``TOP`` of each of ``DEAL`` deals.

Products are decimals of 38 digits: exact for counts up to 10^18.

Defined results: null texts count as empty, a null language as ``und``; repeated rows count again; ids are not read and may be null; other
columns are not read; an empty table gives an empty table. Texts of any length are read in slices of ``SLICE`` bytes that end between words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import join_counted, materialise, table

DEPTH, LEAST, COVER, TOP, DEAL = 4, 30, 80, 2000, 64
SHARD, SLICE = 1 << 20, 2 << 20
FILTER_BITS = 1 << 28
#: Of a byte: its lower case, and 1 for what separates words, 2 for what separates pieces.
LOWER = np.frombuffer(bytes(range(256)).lower(), dtype=np.uint8)
KIND = np.zeros(256, dtype=np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Shard:
    """Words in order: symbols from 1 (``names`` and ``langs`` have them from 0), and whether one begins a piece.

    The first ``known`` words were in the shard before: they stand in front of others, but no phrase that ends there counts again.
    """

    symbols: np.ndarray
    begins: np.ndarray
    langs: pa.Array
    names: pa.Array
    known: int = 0

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the symbols, from 0."""
        langs = self.langs.dictionary_encode()
        return _mixed(_mixed(_bytes_hash(langs.dictionary))[langs.indices.to_numpy()] + _bytes_hash(self.names))

    def without(self, kept: np.ndarray) -> Shard:
        """The words of symbols that are kept. What stood on both sides of another one is no neighbour."""
        held = kept[self.symbols - 1]
        cut = self.begins | ~np.r_[True, held[:-1]]
        return Shard(self.symbols[held], cut[held], self.langs, self.names, int(held[: self.known].sum()))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ values >> np.uint64(32)) * MIX
    return values ^ values >> np.uint64(29)


def _bytes_hash(values: pa.BinaryArray) -> np.ndarray:
    """Of each value the sum of its bytes times powers of an odd number, by place."""
    ends = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    if not len(values) or ends[0] == ends[-1]:
        return np.zeros(len(values), dtype=np.uint64)
    data = np.frombuffer(values.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    sizes = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], sizes)
    powers = np.cumprod(np.full(int(sizes.max()), MIX, dtype=np.uint64))
    out, held = np.zeros(len(values), dtype=np.uint64), np.flatnonzero(sizes)
    out[held] = np.add.reduceat(data * powers[place], ends[held] - ends[0])
    return out


def pair_hashes(hashes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of symbols (from 1)."""
    return _mixed(hashes[left - 1] * MIX + hashes[right - 1])


def _words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of bytes: where words start, how many pieces have ended before each and before the end, and the words. At ``starts`` new texts begin."""
    data = LOWER[data]
    kind = KIND[data]
    text, inside = np.zeros(len(data), dtype=bool), kind == 0
    text[starts] = True
    first = np.flatnonzero(inside & (text | np.r_[True, ~inside[:-1]]))
    kept = np.cumsum(inside, dtype=np.int32)
    cuts = np.cumsum(text | (kind == 2), dtype=np.int32)
    offsets = np.r_[kept[first] - 1, kept[-1:]].astype(np.int32)
    values = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
    return first, np.r_[cuts[first], cuts[-1:]], values


def _slices(batch: pa.RecordBatch, size: int) -> Iterator[tuple]:
    """(languages of the words, begins, words) of slices of about ``size`` bytes of a batch (lang, text)."""
    langs = pc.fill_null(batch.column(0), "und").cast(pa.binary()).dictionary_encode()
    texts = pc.fill_null(batch.column(1), "").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    at, ended = int(ends[0]), 0
    while at < ends[-1]:
        to = min(at + size, int(ends[-1]))
        while to < ends[-1] and KIND[data[to]] == 0 and ends[np.searchsorted(ends, to)] != to:
            near = data[to : to + 65_536]
            stops = [int(x[0]) for x in (np.flatnonzero(KIND[near]), ends[np.searchsorted(ends, to) :] - to) if len(x)]
            to = min(to + len(near), to + min(stops))
        inner = ends[(ends >= at) & (ends < to)]
        first, cuts, words = _words(data[at:to], inner - at)
        rows = np.searchsorted(ends, first + at, side="right") - 1
        yield langs.take(pa.array(rows)), np.diff(cuts[:-1] + ended, prepend=0) > 0, words.dictionary_encode()
        at, ended = to, int(cuts[-1] - cuts[-2] if len(first) else ended + cuts[-1])


def _joined(parts: list[pa.DictionaryArray]) -> pa.DictionaryArray:
    return pa.chunked_array(parts).unify_dictionaries().combine_chunks()


def shards(batches: Iterator[pa.RecordBatch], most: int = SHARD, size: int = SLICE, carried: int = DEPTH - 1) -> Iterator[Shard]:
    """Batches of (lang, text) as shards of about ``most`` words, each led by the last ``carried`` words of the one before."""
    held: list[tuple] = []
    count = known = 0

    def one() -> Shard:
        langs, names = (_joined([h[k] for h in held]) for k in (0, 2))
        code = langs.indices.to_numpy().astype(np.int64) * len(names.dictionary) + names.indices.to_numpy()
        coded = pa.array(code).dictionary_encode()
        lang, name = np.divmod(coded.dictionary.to_numpy(), max(1, len(names.dictionary)))
        return Shard(coded.indices.to_numpy().astype(np.int64) + 1, np.concatenate([h[1] for h in held]), langs.dictionary.take(pa.array(lang)), names.dictionary.take(pa.array(name)), known)

    def tail() -> list[tuple]:
        last, lacking = [], carried
        for langs, begins, names in reversed(held):
            n = min(lacking, len(begins))
            if n:
                last.insert(0, (langs[-n:].dictionary_decode().dictionary_encode(), begins[-n:], names[-n:].dictionary_decode().dictionary_encode()))
                lacking -= n
        return last

    for batch in batches:
        for part in _slices(batch, size):
            held.append(part)
            count += len(part[1])
            if count >= most:
                yield one()
                held, count = tail(), 0
                known = sum(len(x[1]) for x in held)
    if count:
        yield one()


@dataclass
class Automaton:
    """States of a suffix automaton cut at a depth. ``longest`` holds a state's longest phrase, last word first, zeros behind; its phrases have
    ``shortest`` to ``length`` words, and its suffix link leads to the state of its last ``shortest`` - 1 words."""

    longest: np.ndarray
    length: np.ndarray
    shortest: np.ndarray
    ends: np.ndarray

    def phrases(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols in order, a row a phrase of so many words, and their counts."""
        held = (self.shortest <= words) & (words <= self.length)
        return self.longest[held, :words][:, ::-1], self.ends[held]


def _contexts(symbols: np.ndarray, back: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each position the rank, from 1, of its last ``depth`` words read backwards, and the words of each rank. Pieces end a context: ``back``
    has how many words of the piece stand before each one."""
    if depth == 1:
        return symbols, np.arange(int(symbols.max(initial=0)) + 1)[:, None]
    key, rows = _pairs(symbols, back, depth)
    met, rank = np.unique(key, return_inverse=True)
    return rank + 1, np.r_[np.zeros((1, depth), dtype=np.int64), rows(met)]


def _pairs(symbols: np.ndarray, back: np.ndarray, depth: int) -> tuple:
    """Keys that sort as the last ``depth`` words of each position, put together of the ranks of two halves, and what reads words from keys."""
    near = (depth + 1) // 2
    rank, rows = _contexts(symbols, back, near)
    other, farther = (rank, rows) if depth == 2 * near else _contexts(symbols, back, depth - near)
    before = np.zeros(len(symbols), dtype=np.int64)
    before[near:] = np.where(back[near:] >= near, other[:-near], 0)
    return rank << 32 | before, lambda keys: np.hstack([rows[keys >> 32], farther[keys & 0xFFFFFFFF]])


def automaton(symbols: np.ndarray, begins: np.ndarray, depth: int = DEPTH, known: int = 0) -> Automaton:
    """The states of all pieces of a sequence (symbols from 1), sorted by their longest phrases, read backwards. The first ``known`` symbols
    are no end positions."""
    places = np.arange(len(symbols))
    back = places - np.maximum.accumulate(np.where(begins, places, 0)) if len(symbols) else places
    keys, words = _pairs(symbols.astype(np.int64), back, depth)
    keys = np.sort(keys[known:])
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
    count, rows = np.diff(np.r_[starts, len(keys)]), words(keys[starts])
    ends = np.zeros((len(rows), depth + 2), dtype=np.int64)  # of the node of each depth that starts at a row
    change = np.zeros(len(rows), dtype=bool)
    for d in range(1, depth + 1):
        change |= np.r_[True, rows[1:, d - 1] != rows[:-1, d - 1]][: len(rows)]
        starts = np.flatnonzero(change)
        if len(starts):
            ends[starts, d] = np.where(rows[starts, d - 1] > 0, np.add.reduceat(count, starts), 0)
    longest = (ends[:, 1:-1] > 0) & (ends[:, 1:-1] != ends[:, 2:])
    at, deep = np.nonzero(longest)
    length = deep + 1
    same = (ends[at, 1:-1] == ends[at, length][:, None]) & (np.arange(1, depth + 1) <= length[:, None])
    shortest = length - same.sum(axis=1) + 1  # nodes of one count and one first row follow each other
    held = np.where(np.arange(depth) < length[:, None], rows[at], 0)
    return Automaton(held, length, shortest, ends[at, length])


def _over(docs: DataFrame, work: Callable[[Shard], Iterator[pa.RecordBatch]], schema: str, depth: int = DEPTH) -> DataFrame:
    most, size = SHARD, SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in shards(batches, most, size, depth - 1):
            yield from work(shard)

    return docs.mapInArrow(run, schema)


def _text(values: pa.Array) -> pa.Array:
    return values.cast(pa.string())


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, hash, f) of all words of ``docs`` (lang, text); a null word has the language's sum."""

    def work(shard: Shard) -> Iterator[pa.RecordBatch]:
        f = np.bincount(shard.symbols[shard.known :], minlength=len(shard.names) + 1)[1:]
        codes = shard.langs.dictionary_encode()
        sums = np.bincount(codes.indices.to_numpy(), weights=f).astype(np.int64)
        hashes = pa.array(shard.hashes().view(np.int64))
        for langs, words, keys, n in ((shard.langs, shard.names, hashes, f), (codes.dictionary, pa.nulls(len(sums), pa.binary()), pa.nulls(len(sums), pa.int64()), sums)):
            yield pa.RecordBatch.from_arrays([_text(langs), _text(words), keys, pa.array(n)], ["lang", "word", "hash", "f"])

    return _over(docs, work, "lang string, word string, hash long, f long").groupBy("lang", "word", "hash").agg(F.sum("f").alias("f"))


def key_filter(keys: DataFrame, most: int = FILTER_BITS) -> Broadcast:
    """A filter of two bits for each 64-bit hash of ``keys`` (column hash), broadcast. It has at most ``most`` bits."""
    bits = min(most, max(1 << 16, 1 << (16 * keys.count()).bit_length()))
    chunk = 1 << 16
    spots = F.explode(F.array(*[x.bitwiseAND(F.lit(bits - 1)) for x in (F.col("hash"), F.shiftright("hash", 32))]))
    placed = keys.select(spots.alias("spot")).select(F.shiftright("spot", 16).alias("chunk"), F.col("spot").bitwiseAND(F.lit(chunk - 1)).alias("bit"))
    words = placed.groupBy("chunk", F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 63))")).alias("value"))
    held = np.zeros(bits // 64, dtype=np.int64)
    found = words.toArrow()  # no more rows than the filter has words
    held[(found["chunk"].to_numpy() << 10) + found["word"].to_numpy()] = found["value"].to_numpy()
    return keys.sparkSession.sparkContext.broadcast(held.view(np.uint8))


def passes(held: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each of some hashes."""
    out = np.ones(len(hashes), dtype=bool)
    for spots in (hashes & np.uint64(8 * len(held) - 1), hashes >> np.uint64(32) & np.uint64(8 * len(held) - 1)):
        out &= held[spots >> np.uint64(3)] >> (spots & np.uint64(7)).astype(np.uint8) & 1 > 0
    return out


def pair_counts(docs: DataFrame, words: Broadcast) -> DataFrame:
    """(hash, f) of neighbouring words that both pass a filter."""

    def work(shard: Shard) -> Iterator[pa.RecordBatch]:
        hashes = shard.hashes()
        kept = shard.without(passes(words.value, hashes))
        pairs, f = automaton(kept.symbols, kept.begins, 2, kept.known).phrases(2)
        yield pa.RecordBatch.from_arrays([pa.array(pair_hashes(hashes, pairs[:, 0], pairs[:, 1]).view(np.int64)), pa.array(f)], ["hash", "f"])

    return _over(docs, work, "hash long, f long").groupBy("hash").agg(F.sum("f").alias("f"))


def phrase_counts(docs: DataFrame, words: Broadcast, pairs: Broadcast, depth: int = DEPTH) -> DataFrame:
    """(lang, phrase, words, f) of phrases of two to ``depth`` words, of neighbours that all pass the filters."""

    def work(shard: Shard) -> Iterator[pa.RecordBatch]:
        hashes = shard.hashes()
        kept = shard.without(passes(words.value, hashes))
        if not len(kept.symbols):
            return
        joined = np.r_[False, passes(pairs.value, pair_hashes(hashes, kept.symbols[:-1], kept.symbols[1:]))] & ~kept.begins
        used = joined | np.r_[joined[1:], False]
        found = automaton(kept.symbols[used], ~joined[used], depth, int(used[: kept.known].sum()))
        for n in range(2, depth + 1):
            symbols, f = found.phrases(n)
            for start in range(0, len(f), 65_536):
                part = symbols[start : start + 65_536] - 1
                texts = pc.binary_join_element_wise(*[shard.names.take(pa.array(part[:, k])) for k in range(n)], pa.scalar(b" ", pa.binary()))
                langs = shard.langs.take(pa.array(part[:, 0]))
                yield pa.RecordBatch.from_arrays([_text(langs), _text(texts), pa.array(np.full(len(part), n, dtype=np.int32)), pa.array(f[start : start + 65_536])], ["lang", "phrase", "words", "f"])

    counted = _over(docs, work, "lang string, phrase string, words int, f long", depth)
    return counted.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def _words_of(phrase: str, count: Column) -> Column:
    """So many words of a phrase from its start; from its end where the count is negative."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), count)


def unsubsumed(phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """``phrases`` without those that a longer one by a word, on either side, covers in at least ``cover`` percent of their occurrences."""
    shorter = F.array(_words_of("phrase", 1 - F.col("words")), _words_of("phrase", F.col("words") - 1))
    longer = phrases.where("words > 2").select("lang", F.explode(shorter).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    met = phrases.join(longer, ["lang", "phrase"], "left")
    return met.where(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("f").cast("decimal(20,0)") * cover)).drop("longer")


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): the lowest-scoring cut of each phrase; ``counts`` (lang, phrase, f) has all parts."""
    at = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    sides = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), _words_of("phrase", n).alias("part")) for side, n in ((0, F.col("k")), (1, F.col("k") - F.col("words")))]))
    asked = at.select("lang", "phrase", F.col("f").alias("a"), "k", sides.alias("x"))
    asked = materialise(asked.select("lang", "phrase", "a", "k", "x.side", "x.part"), "parts")
    held = counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("of_part"))
    sized = materialise(asked.groupBy("lang", "part").agg(F.count("*").alias("n")).join(held, ["lang", "part"]), "sized")
    met = join_counted(asked, sized, ["lang", "part"], asked.count())
    cuts = met.groupBy("lang", "phrase", "a", "k").agg(*[F.max(F.when(F.col("side") == k, F.col("of_part"))).alias(x) for k, x in ((0, "l"), (1, "r"))])
    big = lambda x: F.col(x).cast("decimal(19,0)")
    cuts = cuts.select("lang", "phrase", "a", F.struct(_quotient(big("a") * F.lit(2_000_000).cast("decimal(7,0)"), big("l") + big("r")).alias("score"), "k", "l", "r").alias("cut"))
    return cuts.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _quotient(over: Column, under: Column) -> Column:
    """Whole part of a quotient of positive decimals, exact."""
    return ((over - over % under) / under).cast("long")


def first_of_language(rows: DataFrame, top: int = TOP, deal: int = DEAL) -> DataFrame:
    """``rows`` (lang, phrase, a, score and others) with ``rank``, the first ``top`` of each language."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    dealt = rows.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(deal)))
    near = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("rank") <= top)
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("deal")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", depth: int = DEPTH, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to ``depth`` words that occur ``least`` times."""
    if depth < 2:
        raise ValueError("depth must be two words at least")
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    words = materialise(word_counts(rows).where(F.col("word").isNull() | (F.col("f") >= least)), "words")
    frequent = words.where("word is not null")
    known = key_filter(frequent.select("hash"))
    pairs = materialise(pair_counts(rows, known).where(F.col("f") >= least).select("hash"), "pairs")
    phrases = materialise(phrase_counts(rows, known, key_filter(pairs), depth).where(F.col("f") >= least), "phrases")
    counts = frequent.select("lang", F.col("word").alias("phrase"), "f").unionByName(phrases.where(F.col("words") < depth).select("lang", "phrase", "f"))
    ranked = first_of_language(scored(unsubsumed(phrases, cover), counts), top)
    sums = words.where("word is null").select("lang", F.col("f").alias("n"))
    return ranked.join(sums, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first phrases of each language of the documents."""
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


#: All phrases of up to ``DEPTH`` words are made and counted.
OP12_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
  FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS ws FROM pieces),
spots AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM lists),
grams AS (SELECT lang, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR k IN range(1, {DEPTH + 1}) IF i + k - 1 <= len(ws)]) AS phrase FROM spots),
f AS (SELECT lang, phrase, string_split(phrase, ' ') AS ws, count(*)::HUGEINT AS f FROM grams GROUP BY 1, 2),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(ws) = 1 GROUP BY 1),
candidates AS (SELECT * FROM f WHERE len(ws) > 1 AND f >= {LEAST}),
inner_ AS (
  SELECT lang, unnest(flatten([[array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)] FOR k IN range(2, len(ws))])) AS phrase, f
  FROM candidates WHERE len(ws) > 2),
longer AS (SELECT lang, phrase, max(f) AS longer FROM inner_ GROUP BY 1, 2),
kept AS (SELECT c.* FROM candidates c LEFT JOIN longer USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < {COVER} * f),
cuts AS (SELECT lang, phrase, ws, f AS a, unnest(range(1, len(ws))) AS k FROM kept),
scores AS (
  SELECT c.lang, c.phrase, c.a, k, x.f AS l, y.f AS r, 2000000 * c.a // (x.f + y.f) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:k], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[k + 1:], ' ')),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""
