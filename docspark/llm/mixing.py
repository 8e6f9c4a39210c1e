"""Mixing sources to target weights: repetition rates by source, whole copies and one seeded coin a document. Built-in functions only.

Sizes are summed by source once. Sources, sorted by code point with null last, take the weights in turn and share the size of all
documents; a target stops at ``most`` times its source's size and the excess is shared anew by weight. Only two sums a round come to
the driver, however many sources there are; a round ends when no further target stops, and each round lifts the level of the rest.
A document is emitted floor(rate) times and once more with the rate's fraction as probability. Its coin is a hash of seed, id and
text, so that reruns and retried tasks agree and copies under other ids have coins of their own.

Up to ``BROADCAST`` sources (counted first) go to the documents by broadcast and nothing else is shuffled; of more, those with over
1/256 of all rows do, and the others are joined by a shuffle. Documents are read twice.

Defined results: a null text has size zero and is kept as it is; a null source is a source; a source without words has target zero
and no copies; rows alike in id and text share their coin; null ids count as empty in it; the columns ``size``, ``source_size``,
``target`` and ``copies`` replace input columns of those names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.llm.common import join_counted, materialise, table

WEIGHTS, MOST, SEED, BROADCAST = (1, 2, 3), 3, 13, 1 << 16
RESULTS = ("size", "source_size", "target", "copies")
BIG = "decimal(38,0)"


def word_count(text: Column) -> Column:
    """Runs of other characters than the six of ASCII white space; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(rows: DataFrame, order: Column) -> DataFrame:
    """``rows`` with ``at``, the place of each in the whole order, from 0: places inside ranges, and the rows of the ranges before."""
    dealt = materialise(rows.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    before = F.sum("count").over(Window.orderBy("part")) - F.col("count")  # one row a range
    starts = dealt.groupBy("part").count().select("part", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("inside", inside).join(starts, "part").withColumn("at", F.col("before") + F.col("inside")).drop("part", "inside", "before")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (source, source_size, any others; a row a source) with ``target``."""
    at = F.pmod("at", F.lit(len(weights))).cast("int")
    cap = F.col("source_size").cast(BIG) * F.lit(most)
    rows = numbered(sizes, F.col("source").asc_nulls_last()).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), at + 1)).drop("at")
    rows = materialise(rows.withColumn("cap", cap.cast(BIG)), "sources")
    total, rest_weight = (int(x or 0) for x in rows.agg(F.sum(F.col("source_size").cast(BIG)), F.sum("weight")).first())
    rest, stopped = total, 0
    while True:
        above = F.col("cap") * F.lit(rest_weight).cast("decimal(19,0)") <= F.col("weight").cast("decimal(10,0)") * F.lit(rest).cast("decimal(27,0)")
        n, caps, weight = rows.agg(F.count_if(above), F.sum(F.when(above, F.col("cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        if n == stopped or not weight:  # without a weight all have stopped
            break
        stopped, rest, rest_weight = n, total - int(caps), int(weight)
    level = F.lit(0.0)
    for w in sorted(set(weights)):
        level = F.when(F.col("weight") == w, F.lit(w * rest / rest_weight if rest_weight else 0.0)).otherwise(level)
    return rows.withColumn("target", F.when(above, F.col("cap").cast("double")).otherwise(level)).drop("weight", "cap")


def coin(key: Column, text: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) of 52 bits of a hash."""
    said = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.sha2(said, 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def mixture(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, key: str = "doc_id", text: str = "text", source: str = "source", broadcast: int = BROADCAST) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` (its source's) and ``copies``."""
    named = docs.select(F.struct("*").alias("row"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.col(key).alias("key"), F.col(text).alias("text"))
    sizes = materialise(named.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sizes")
    found = materialise(source_targets(sizes, weights, most).select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name"), "source_size", "target", "n"), "targets")
    keyed, keys = named.select("*", F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("name")), ["no_source", "name"]
    count, total = found.agg(F.count("*"), F.sum("n")).first()
    met = keyed.join(F.broadcast(found), keys) if count <= broadcast else join_counted(keyed, found, keys, total)
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    copies = F.floor(rate) + (coin(F.col("key"), F.col("text"), seed) < rate - F.floor(rate)).cast("long")
    return met.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in RESULTS], "size", "source_size", "target", copies.alias("copies"))


def emitted(mixed: DataFrame) -> DataFrame:
    """What ``mixture`` gives, each document as often as its copies say, with ``copy`` from 1; documents without copies are left out."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, source and words taken of every document."""
    mixed = mixture(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


#: The level is found by a recursion over rounds.
OP13_SQL = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0)::BIGINT AS size FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY 1),
ranked AS (
  SELECT source, source_size, {MOST}::HUGEINT * source_size AS cap,
    {list(WEIGHTS)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::HUGEINT AS weight FROM sizes),
rounds AS (
  SELECT 0 AS round, sum(source_size)::HUGEINT AS rest, sum(weight)::HUGEINT AS weights, 0::BIGINT AS stopped, 1::BIGINT AS new FROM ranked
  UNION ALL
  SELECT round + 1, total - caps, heavy, n, n - stopped FROM (
    SELECT o.round, o.stopped, sum(source_size)::HUGEINT AS total, coalesce(sum(cap) FILTER (cap * weights <= weight * rest), 0)::HUGEINT AS caps,
      sum(weight) FILTER (cap * weights > weight * rest)::HUGEINT AS heavy, count(*) FILTER (cap * weights <= weight * rest) AS n
    FROM rounds o, ranked WHERE o.new > 0 GROUP BY o.round, o.stopped) WHERE heavy > 0),
last AS (SELECT rest, weights FROM rounds ORDER BY round DESC LIMIT 1),
targets AS (
  SELECT source, source_size, CASE WHEN cap * weights <= weight * rest THEN cap::DOUBLE ELSE (weight * rest)::DOUBLE / weights::DOUBLE END AS target
  FROM ranked, last),
rates AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE target / source_size::DOUBLE END AS rate,
    ('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT / {1 << 52}::DOUBLE AS coin
  FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source),
counted AS (SELECT *, floor(rate)::BIGINT + (coin < rate - floor(rate))::BIGINT AS copies FROM rates)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM counted
"""
