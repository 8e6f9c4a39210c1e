"""Consistent sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own (an offset and a skip from a hash
of its name). Shards take turns, each claiming the first slot of its order that is still free, until the
table is full; so all get the same number of slots, give or take one, and few keys move when a shard is
added or lost. A key's slot is its hash modulo the prime; the table is broadcast (its size is the prime, a
parameter, whatever the data), so a placement takes constant time and no shuffle.

Defined results: null keys count as the empty text and are all placed on one shard; repeated keys go to the
same shard; the two result columns replace input columns of those names; an empty table stays empty.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import table

SHARDS, SLOTS = 16, 2053


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """For each slot the position of its shard in ``names``."""
    if slots < 3 or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be a prime")
    if not 0 < len(names) <= slots or len(set(names)) < len(names):
        raise ValueError("one to as many shards as slots, with different names")
    offset = [_number(f"{n}|offset") % slots for n in names]
    skip = [_number(f"{n}|skip") % (slots - 1) + 1 for n in names]
    owner, upto, taken = [-1] * slots, [0] * len(names), 0
    while True:
        for s in range(len(names)):
            while owner[slot := (offset[s] + upto[s] * skip[s]) % slots] >= 0:
                upto[s] += 1
            owner[slot] = s
            upto[s] += 1
            taken += 1
            if taken == slots:
                return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def slot_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """The lookup table as (slot, shard) rows, folded to a literal by the optimiser."""
    listed = F.split(F.lit(",".join(map(str, lookup_table(names, slots)))), ",")
    return spark.range(1).select(F.posexplode(listed).alias("slot", "at")).select("slot", F.col("at").cast("int").alias("shard"))


def assign_shards(df: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """``df`` with the columns slot and shard."""
    placed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return placed.join(F.broadcast(slot_table(df.sparkSession, names, slots)), "slot")


def write_shards(df: DataFrame, key: str, names: list[str], path: str, slots: int = SLOTS, files: int = 8) -> None:
    """One folder for each shard. A shard's rows are written by ``files`` tasks, so that none grows with it alone."""
    placed = assign_shards(df, key, names, slots)
    placed.repartition(len(names) * files, "shard", F.pmod(F.xxhash64(key, *[c for c in df.columns if c != key][:1]), F.lit(files))).write.partitionBy("shard").parquet(path)


def shard_names(shards: int = SHARDS) -> list[str]:
    return [f"shard-{k:04d}" for k in range(shards)]


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot and shard of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return assign_shards(docs, "doc_id", shard_names()).select("doc_id", "slot", "shard")


#: The table is filled by a recursion of its own, turn by turn.
OP6_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i::INT AS shard,
    ('0x' || substr(md5(printf('shard-%04d', i) || '|offset'), 1, 15))::BIGINT % {SLOTS} AS first_slot,
    ('0x' || substr(md5(printf('shard-%04d', i) || '|skip'), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS skip
  FROM range({SHARDS}) t(i)),
orders AS (
  SELECT list(list_transform(range({SLOTS}), lambda j: (first_slot + j * skip) % {SLOTS}) ORDER BY shard) AS preferred FROM shards),
turns AS (
  SELECT 0 AS turn, list_transform(range({SLOTS}), lambda j: -1) AS owner, 0::BIGINT AS claimed
  UNION ALL
  SELECT turn + 1, list_concat(owner[1:slot], [turn % {SHARDS}], owner[slot + 2:]), slot
  FROM (SELECT turn, owner, list_filter(preferred[turn % {SHARDS} + 1], lambda s: owner[s + 1] = -1)[1] AS slot
        FROM turns, orders WHERE turn < {SLOTS})),
slots AS (SELECT claimed AS slot, ((turn - 1) % {SHARDS})::INT AS shard FROM turns WHERE turn > 0)
SELECT d.doc_id, d.slot::INT AS slot, s.shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents) d
JOIN slots s ON d.slot = s.slot
"""
