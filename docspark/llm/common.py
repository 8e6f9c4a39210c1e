"""Shared helpers of the llm operators: scratch tables in the shared folder, deterministic splits."""

from __future__ import annotations

import uuid

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A sieve has from the first to the second of these numbers of rows of eight words, 2^28 bits at most.
SIEVE_ROWS = (1 << 13, 1 << 19)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which every executor must see. Where it is unset there is none: set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found


def materialise(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    The files survive a lost executor, so no stage before this point is ever run again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docspark-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def crc_bucket(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def bounded_fraction(bound: int, available: int) -> float:
    """The share of rows that a sample of about ``bound`` out of ``available`` rows takes."""
    return 1.0 if available <= bound else bound / available


def hash_unit(key: Column) -> Column:
    """A deterministic pseudo-random number in [0, 1) for a key."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 30)).cast("double") / F.lit(float(1 << 30))


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], total: int, share: int = 256) -> DataFrame:
    """Inner join on keys that are unique in ``right``, where ``n`` counts the rows that ``left`` (``total`` rows) has of each.

    Keys with more than 1 / ``share`` of all rows, of which there are fewer than ``share``, are broadcast, so that no task
    gets their rows; the others are joined by a shuffle.
    """
    hot = F.broadcast(right.where(F.col("n") * share > total))
    cold = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(right.where(F.col("n") * share <= total), keys)
    return left.join(hot, keys).unionByName(cold)


def _spot(key: Column, rows: int) -> tuple[Column, Column, Column]:
    """Row, word and bit of a hash in a sieve."""
    return key.bitwiseAND(F.lit(rows - 1)), F.shiftright(key, 40).bitwiseAND(F.lit(7)).cast("int"), F.shiftright(key, 48).bitwiseAND(F.lit(63)).cast("int")


class Sieve:
    """A bit for each value of a column of long hashes, in a table of about 32 bits a value that is broadcast: 32 MB at most, however many
    they are. At most one other hash in 32 passes up to 8 million values, one in four up to 75 million; beyond, more and more do."""

    def __init__(self, keys: DataFrame, key: str) -> None:
        least, most = SIEVE_ROWS
        self.rows = min(most, max(least, 1 << (keys.count() >> 4).bit_length()))
        at, word, bit = _spot(F.col(key), self.rows)
        bits = keys.select(at.alias("at"), word.alias("word"), bit.alias("bit"))
        words = [F.coalesce(F.bit_or(F.expr(f"IF(word = {k}, shiftleft(1L, bit), 0L)")), F.lit(0).cast("long")) for k in range(8)]
        self.table = materialise(bits.groupBy("at").agg(F.array(*words).alias("words")), "sieve")


def sieve(keys: DataFrame, key: str) -> Sieve:
    return Sieve(keys, key)


def sift(rows: DataFrame, key: str, held: Sieve, how: str = "left_semi") -> DataFrame:
    """The rows whose hash is in the sieve ``held``, and a few others that share its bit; by "left_anti" all the rest.

    A hash that was put in always passes, so a join that follows gives what it gives without the sieve, but of fewer rows.
    """
    at, word, bit = _spot(rows[key], held.rows)
    known = held.table
    return rows.join(F.broadcast(known), (at == known["at"]) & (F.getbit(F.element_at(known["words"], word + 1), bit) == 1), how)


def pieces_of(batch: pa.Array, most: int = 4 << 20) -> Iterator[pa.Array]:
    """A batch of texts in parts of about ``most`` bytes, a text at least, so that what is made of it is bounded as well."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch), 0).to_pylist()
    start = held = 0
    for k, n in enumerate(sizes):
        if k > start and held + n > most:
            yield batch[start:k]
            start, held = k, 0
        held += n
    if start < len(batch):
        yield batch[start:]


def hand_back() -> None:
    """Give a worker's free memory back to the system, as it is kept for the next task."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)
