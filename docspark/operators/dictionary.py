"""Similarity joins of tokens with a dictionary, both as tables of any size; nothing is held by the driver or a worker.

Candidates meet in equi-joins that lose none. A word that few edits make of another has, cut in one piece more than the edits can touch, a
piece that stands in the other unbroken and at most that many places away: so pieces of words are joined with the places of tokens where
they may stand, by the word's length, the piece's number and its hash. Only the pairs that meet are compared exactly.

Suggestions need one word of a token alone, so pairs are not made: patterns of all that two edits make of a word are a table with the
first word of each pattern, and a token looks up its own. Rows are in proportion to tokens and words, however many are near each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.scratch import written

c = F.col
#: Words up to this length meet by what is left of them without some characters, longer ones by pieces.
SHORT = 12
#: Words up to this length are suggested by patterns; what stands for any character in a pattern (a word that has it goes by pieces).
LONGEST, ANY = 24, "\uffff"


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, by bits of one long integer."""
    at: dict[str, int] = {}
    for k, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & at.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def swap_distance(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, replacements and swaps of neighbours that make b of a; ``most`` + 1 stands for any more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1  # only a band of places that few edits can bring together is looked at
    before: dict[int, int] = {}
    last = {j: j for j in range(min(len(b), most) + 1)}
    for i, x in enumerate(a, 1):
        row: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            best = min(last.get(j, far) + 1, row.get(j - 1, far) + 1)
            if j:
                y = b[j - 1]
                best = min(best, last.get(j - 1, far) + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    best = min(best, before.get(j - 2, far) + 1)
            row[j] = min(best, far)
        if min(row.values()) > most:
            return far
        before, last = last, row
    return last.get(len(b), far)


def _of_pairs(a: Column, b: Column, value) -> Column:
    @F.arrow_udf("int")
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([value(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.int32())

    return run(a, b)


def _cut(rows: DataFrame, parts: str) -> DataFrame:
    """``rows`` with n in ``parts`` pieces each: k, where it starts, its size."""
    cut = rows.withColumn("parts", F.expr(parts)).withColumn("k", F.explode(F.sequence(F.lit(0), c("parts") - 1)))
    return cut.withColumn("start", F.expr("int(n * k div parts)")).withColumn("size", F.expr("int(n * (k + 1) div parts) - start")).drop("parts")


def pieces(words: DataFrame, parts: str) -> DataFrame:
    """(word, n, k, piece) of words, cut in ``parts`` (of its length n) pieces."""
    return _cut(words.select("word", F.length("word").alias("n")), parts).select("word", "n", "k", F.xxhash64(F.expr("substring(word, start + 1, size)")).alias("piece"))


def windows(tokens: DataFrame, words: DataFrame, shortest: str, longest: str, parts: str, shift: str) -> DataFrame:
    """(token, n, k, piece) of tokens (of length m), for each length n between two bounds that a word has, wherever its k-th piece may stand.

    Only lengths that words have are looked at, so a token far longer than all words has no rows, however long it is.
    """
    known = sorted(r["n"] for r in words.select(F.length("word").alias("n")).distinct().collect() if r["n"])  # a number for each length
    lengths = tokens.select("token", F.length("token").alias("m")).withColumn("low", F.expr(shortest)).withColumn("high", F.expr(longest))
    n = F.explode(F.filter(F.array(*map(F.lit, known)).cast("array<int>"), lambda x: x.between(c("low"), c("high"))))
    cut = _cut(lengths.withColumn("n", n), parts).withColumn("shift", F.expr(shift))
    placed = cut.withColumn("from", F.greatest(F.lit(0), c("start") - c("shift"))).withColumn("to", F.least(c("m") - c("size"), c("start") + c("shift"))).where("from <= to")
    at = placed.withColumn("at", F.explode(F.sequence("from", "to")))
    return at.select("token", "n", "k", F.xxhash64(F.expr("substring(token, at + 1, size)")).alias("piece")).distinct()


def _met(tokens: DataFrame, words: DataFrame) -> DataFrame:
    return tokens.join(words, ["n", "k", "piece"]).select("token", "word").distinct()


def fuzzy_terms(tokens: DataFrame, terms: DataFrame, cutoff: int) -> DataFrame:
    """(token, word, ratio): for each different token the term with the highest ratio 2 LCS / (m + n), if that is ``cutoff`` percent; ties
    to the first in order. Null and empty ones take no part. ``cutoff`` must be over 66: below, a term need share no two neighbours."""
    if not 66 < cutoff <= 100:
        raise ValueError("a cutoff must lie over 66 and up to 100")
    lost = 100 - cutoff
    parts = f"int(200 * n * {lost} div {100 * cutoff}) + 1"
    terms = written(terms.where("word <> ''").select("word").distinct(), "terms")
    tokens = written(tokens.where("token <> ''").select("token").distinct(), "tokens")  # made once, however often they are joined
    short, most = lost_characters(cutoff)
    lost_by = F.create_map(*[F.lit(x) for kv in most.items() for x in kv]) if most else None
    longer = terms.where(F.length("word") > short)
    own = windows(tokens, longer, f"int(ceil({cutoff} * m / {200 - cutoff}))", f"int(m * {200 - cutoff} div {cutoff})", parts, f"int((m + n) * {lost} div 100)")
    pairs = _met(own, pieces(longer, parts))
    if most:
        near = tokens.where(F.length("token") <= max(most))
        of = lambda x: F.coalesce(F.try_element_at(lost_by, F.length(x)), F.lit(0))
        pairs = pairs.unionByName(_met_by_rest(near, terms.where(F.length("word") <= short), of("token"), of("word")))
    total = F.length("token") + F.length("word")
    scored = pairs.withColumn("common", _of_pairs(c("token"), c("word"), common_length)).where(200 * c("common") >= cutoff * total)
    best = scored.groupBy("token").agg(F.min(F.struct((-2.0 * c("common") / total).alias("ratio"), c("word"))).alias("best"))
    return best.select("token", "best.word", (-c("best.ratio")).alias("ratio"))


def _left(word: str, most: Column) -> Column:
    """Hashes of a word and of what is left of it without one, or up to two, of its characters; ``most`` is 0, 1 or 2."""
    n = F.length(word)
    cut = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n))
    places = F.sequence(F.lit(1), n)
    none = F.array().cast("array<string>")
    cut_two = lambda i, j: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, j - i - 1), F.substring(word, j + 1, n))
    pairs = F.flatten(F.transform(F.filter(places, lambda i: i < n), lambda i: F.transform(F.sequence(i + 1, n), lambda j: cut_two(i, j))))
    rest = F.concat(F.array(c(word)), F.when(most >= 1, F.transform(places, cut)).otherwise(none), F.when(most >= 2, pairs).otherwise(none))
    return F.array_distinct(F.transform(rest, lambda x: F.xxhash64(x)))


def _met_by_rest(tokens: DataFrame, words: DataFrame, of_token: Column, of_word: Column) -> DataFrame:
    """(token, word) that are alike without some of their characters, so many of each."""
    spread = tokens.repartition(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes of tokens give many rows
    left = spread.select("token", F.explode(_left("token", of_token)).alias("rest"))
    return left.join(words.select("word", F.explode(_left("word", of_word)).alias("rest")), "rest").select("token", "word").distinct()


def lost_characters(cutoff: int, longest: int = 24) -> tuple[int, dict[int, int]]:
    """(length, {length: characters}): words up to that length have a ratio of ``cutoff`` percent only with tokens that are the same once at
    most two characters of either are gone; and how many that are at most, by the length of the word or token."""
    most: dict[int, int] = {}
    for n in range(1, longest + 1):
        own: dict[int, int] = {}
        for m in range(1, 3 * n + 3):
            apart = (m + n) * (100 - cutoff) // 100
            if abs(m - n) <= apart:
                own[m] = max(own.get(m, 0), (apart + m - n) // 2)
                own[n] = max(own.get(n, 0), (apart + n - m) // 2)
        if max(own.values()) > 2:
            return n - 1, most
        most |= {k: max(v, most.get(k, 0)) for k, v in own.items()}
    return longest, most


def nearest_words(tokens: DataFrame, known: DataFrame, most: int = 1) -> DataFrame:
    """(token, word, distance): for each different token of three characters or more the closest word within ``most`` (1 or 2) edits, ties
    to the first in order."""
    if most not in (1, 2):
        raise ValueError("most must be 1 or 2, as a token of three characters then shares one with each word so near")
    parts = f"least(n, {most + 1})"
    known = written(known.where("word <> ''").select("word").distinct(), "words")
    tokens = written(tokens.where(F.length("token") >= 3).select("token").distinct(), "tokens")
    long = known.where(F.length("word") > SHORT)
    own = windows(tokens, long, f"greatest(1, m - {most})", f"m + {most}", parts, f"{most}")
    short = _met_by_rest(tokens.where(F.length("token") <= SHORT + most), known.where(F.length("word") <= SHORT), F.lit(most), F.lit(most))
    pairs = _met(own, pieces(long, parts)).unionByName(short).withColumn("distance", F.levenshtein("token", "word", most))
    best = pairs.where(c("distance") >= 0).groupBy("token").agg(F.min(F.struct("distance", "word")).alias("best"))
    return best.select("token", "best.word", "best.distance")


def around(word: str, edits: int) -> set[str]:
    """Patterns (``ANY`` is any character) of just what up to ``edits`` edits, swaps of neighbours among them, make of a word."""
    found = {word}
    if edits:
        tails = [around(word[k:], edits - 1) for k in range(len(word) + 1)]  # the first edit is at k, the others follow it
        for k, tail in enumerate(tails):
            head = word[:k]
            found.update([head + ANY + x for x in tail])
            if k < len(word):
                found.update([head + x for x in tails[k + 1]], [head + ANY + x for x in tails[k + 1]])
            if k + 1 < len(word):
                found.update([head + word[k + 1] + word[k] + x for x in tails[k + 2]])
    return found


def holes(token: str, edits: int) -> set[str]:
    """A token, and it with up to ``edits`` of its characters replaced by ``ANY``: what ``around`` may have made of a word."""
    found = {token}
    for _ in range(edits):
        found |= {x[:k] + ANY + x[k + 1 :] for x in found for k in range(len(x))}
    return found


def _patterns(rows: DataFrame, make: Callable[[str, int], set[str]], edits: int) -> DataFrame:
    """(id, pattern) of ``rows`` (id, text): a row for each pattern of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                made = [make(x, edits) for x in part.column(1).to_pylist()]
                ids = np.repeat(part.column(0).to_numpy(), [len(x) for x in made])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([y for x in made for y in x], pa.string())], ["id", "pattern"])

    spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # few bytes of words give many rows
    return spread.mapInArrow(run, "id long, pattern string")


def _first_near(tokens: DataFrame, words: DataFrame, edits: int) -> DataFrame:
    """(id, rank): for each token (id, token) the least rank of a word (rank, word) within ``edits`` edits, by patterns that both have.

    Only the first word of a pattern goes on, so a token has at most as many rows as it has patterns, however many words are near it.
    """
    first = _patterns(words.select("rank", "word"), around, edits).groupBy("pattern").agg(F.min("id").alias("rank"))
    return _patterns(tokens.select("id", "token"), holes, edits).join(first, "pattern").groupBy("id").agg(F.min("rank").alias("rank"))


def suggestions(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """(token, word) of different tokens that are no known word: the most frequent known word (word, count) at distance one, else at two,
    where neighbours may change places; ties to the first in order.

    Words up to ``LONGEST`` characters are found by patterns, first at distance one, then for the other tokens at two; longer ones, of
    which a table of words has few, by pieces.
    """
    rows = known.where("word <> ''").groupBy("word").agg(F.max("count").alias("count")).orderBy(F.desc("count"), "word")
    rows = written(rows.select("word", F.monotonically_increasing_id().alias("rank")), "ranks")
    unknown = tokens.where("token <> ''").select("token").distinct().join(rows.select(c("word").alias("token")), "token", "left_anti")
    unknown = written(unknown.withColumn("id", F.monotonically_increasing_id()), "unknown")
    by_patterns = (F.length("word") <= LONGEST) & ~c("word").contains(ANY)
    short, long = rows.where(by_patterns), rows.where(~by_patterns)
    rest = unknown.where(F.length("token") <= LONGEST + 2)
    one = written(_first_near(rest, short, 1), "one")
    two = _first_near(rest.join(one.select("id"), "id", "left_anti"), short, 2)
    # two edits touch four pieces at most: a swap may lie on the border of two
    own = windows(unknown, long, "greatest(1, m - 2)", "m + 2", "5", "2")
    pairs = _met(own, pieces(long, "5")).where(F.levenshtein("token", "word", 4) >= 0)
    pairs = pairs.withColumn("distance", _of_pairs(c("token"), c("word"), swap_distance)).where("distance between 1 and 2")
    apart = pairs.join(unknown, "token").join(long, "word").select("id", "distance", "rank")
    near = one.select("id", F.lit(1).alias("distance"), "rank").unionByName(two.select("id", F.lit(2).alias("distance"), "rank")).unionByName(apart)
    best = near.groupBy("id").agg(F.min(F.struct("distance", "rank"))["rank"].alias("rank"))
    return best.join(unknown, "id").join(rows, "rank").select("token", "word")


def halves(tokens: DataFrame, known: DataFrame, right: int = 3) -> DataFrame:
    """(token, left, right): a different, unknown token of eight or more characters whose halves, of at least three and ``right``
    characters, are both known (column word), whatever their case; the first cut wins."""
    words = known.select(c("word").alias("low")).distinct()
    longest = words.agg(F.max(F.length("low"))).first()[0] or 0  # a longer half is no word
    long = tokens.select("token").distinct().where(F.length("token").between(8, 2 * longest)).withColumn("low", F.lower("token"))
    cuts = long.join(words, "low", "left_anti").select("token", "low", F.explode(F.sequence(F.lit(3), F.length("token") - right)).alias("i"))
    both = cuts.select("token", "i", F.expr("substring(low, 1, i)").alias("a"), F.expr("substring(low, i + 1)").alias("b"))
    for side in ("a", "b"):
        both = both.join(words.select(c("low").alias(side)), side, "left_semi")
    first = both.groupBy("token").agg(F.min("i").alias("i"))
    return first.select("token", F.expr("substring(token, 1, i)").alias("left"), F.expr("substring(token, i + 1)").alias("right"))
