"""Exact dense top-k over blocks of the corpus, with bounds that leave whole blocks uncompared.

Vectors lie in cells around pivots (a sample of bounded size) and, by their distance to it, in blocks of about ``BLOCK``, which keep the least
and the largest of these distances. By the triangle inequality a block has nothing nearer to a query than the gap between that range and
the query's own distance to the pivot. Cosines are distances of unit vectors. A query first meets the blocks of its own cell; the k-th best
score there is a floor, and of all other blocks only those whose bound reaches it are compared, in one matrix product each for all queries
that need them. Each task keeps the k best of a query, so few rows are shuffled. Blocks do not depend on the queries; the index is a table.

On vectors without clusters bounds leave out nothing (distances in many dimensions are all alike) and the cost is the products'. Vectors
that are null, of length zero (for cosines) or hold null or non-finite components take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.scratch import written

c = F.col
BLOCK, PIVOTS = 512, 1024
#: How far rounded bounds may be off.
SLACK = 1e-9
FOUND = "query_id long, vec_id long, label int, score double"


class Index(NamedTuple):
    """``blocks`` (cell, low, high, ids, labels, vectors) around ``pivots``; ``unit`` where vectors are compared by their directions."""

    blocks: DataFrame
    pivots: np.ndarray
    unit: bool


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of all rows of x to all rows of y."""
    squares = (x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1)[None] - 2 * x @ y.T
    return np.sqrt(np.maximum(squares, 0))


def usable(rows: DataFrame, vector: str, unit: bool) -> DataFrame:
    """Rows with a vector that can be compared, as doubles."""
    sound = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector) > 0), F.lit(False))
    return rows.where(sound & (F.exists(vector, lambda x: x != 0) if unit else F.lit(True))).withColumn(vector, c(vector).cast("array<double>"))


def dense_index(corpus: DataFrame, unit: bool = True, block: int = BLOCK, pivots: int = PIVOTS) -> Index:
    """The blocks of ``corpus`` (vec_id, embedding, perhaps label)."""
    label = c("label").cast("int") if "label" in corpus.columns else F.lit(None).cast("int")
    rows = usable(corpus.select("vec_id", label.alias("label"), "embedding"), "embedding", unit)
    n = rows.count()
    wanted = min(pivots, max(1, math.isqrt(n)))
    drawn = rows.orderBy(F.xxhash64("vec_id", "embedding")).limit(wanted).select("embedding").toArrow()["embedding"].combine_chunks()
    centres = _unit(_matrix(drawn)) if unit and len(drawn) else _matrix(drawn)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("embedding"))
            if not len(x):
                continue
            away = distances(_unit(x) if unit else x, centres)
            cell = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away[np.arange(len(x)), cell])], [*batch.schema.names, "cell", "away"])

    placed = written(rows.mapInArrow(place, "vec_id long, label int, embedding array<double>, cell int, away double"), "placed")
    parts = placed.groupBy("cell").agg(F.ceil(F.count("*") / (64 * block)).alias("parts"))  # a row a pivot
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "embedding"), c("parts"))).drop("parts")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cell", "low", "high", "ids", "labels", "vectors"]
        held: list[pa.RecordBatch] = []

        def one(rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            column = lambda k: rows[k].combine_chunks() if isinstance(rows[k], pa.ChunkedArray) else rows[k]
            away, whole = rows["away"].to_numpy(), [0, rows.num_rows]
            lists = [pa.ListArray.from_arrays(pa.array(whole, pa.int32()), column(k)) for k in ("vec_id", "label")]
            matrix = _matrix(column("embedding")).tobytes()
            return pa.RecordBatch.from_arrays([rows["cell"].combine_chunks()[:1], pa.array([away.min()]), pa.array([away.max()]), *lists, pa.array([matrix], pa.binary())], names)

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            key = np.column_stack([table["cell"].to_numpy(), table["part"].to_numpy()])
            starts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1]
            ends = np.r_[starts[1:], len(key)]
            for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
                full = start
                while end - full >= block or (end < len(key) and full < end):
                    yield one(table.slice(full, min(block, end - full)))
                    full = min(full + block, end)
                if end == len(key):
                    held = table.slice(full).combine_chunks().to_batches() if full < end else []
        if held:
            yield one(pa.Table.from_batches(held))

    sorted_ = dealt.select("cell", "part", "away", "vec_id", "label", "embedding").repartition("cell", "part").sortWithinPartitions("cell", "part", "away")
    packed = sorted_.mapInArrow(pack, "cell int, low double, high double, ids array<long>, labels array<int>, vectors binary")
    return Index(written(packed, "blocks"), centres, unit)


class Asked(NamedTuple):
    """Queries as the tasks see them: ids, vectors, their distances to the pivots, and the scores that a vector must reach."""

    ids: np.ndarray
    vectors: np.ndarray
    away: np.ndarray
    floor: np.ndarray


def _score(away: np.ndarray, unit: bool) -> np.ndarray:
    return 1 - away**2 / 2 if unit else 1 / (1 + away**2)


def _needed(asked: Asked, cell: int, low: float, high: float, unit: bool, own: bool | None) -> np.ndarray:
    """The queries that have to meet a block: those of its cell, all others that its bound allows, or (None) both."""
    away = asked.away[:, cell]
    mine = asked.away.argmin(axis=1) == cell
    best = _score(np.maximum(np.maximum(away - high, low - away), 0), unit)
    return np.flatnonzero(mine if own else (best >= asked.floor - SLACK) & (~mine if own is False else True))


def _compared(index: Index, shared: Broadcast, k: int, own: bool) -> DataFrame:
    """(query_id, vec_id, label, score): of each query the best k of a task's blocks, of its own cell or of all others."""
    unit = index.unit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        n = len(asked.ids)
        best = [(np.zeros(0), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=object)) for _ in range(n)]
        for batch in batches:
            for row in range(batch.num_rows):
                cell, low, high = (batch.column(x)[row].as_py() for x in range(3))
                chosen = _needed(asked, cell, low, high, unit, own)
                if not len(chosen):
                    continue
                ids = batch.column(3)[row].values.to_numpy()
                labels = np.array(batch.column(4)[row].as_py(), dtype=object)
                x = np.frombuffer(batch.column(5)[row].as_buffer(), dtype=np.float64).reshape(len(ids), -1)
                q = asked.vectors[chosen]
                scores = q @ _unit(x).T if unit else 1 / (1 + ((q[:, None] - x[None]) ** 2).sum(axis=2) if len(q) * x.size < 1 << 22 else 1 + distances(q, x) ** 2)
                for at, query in enumerate(chosen.tolist()):
                    good = np.flatnonzero((scores[at] >= asked.floor[query] - SLACK) & (ids != asked.ids[query]))
                    if len(good) > k:  # all that may be among the best, ties included
                        good = good[scores[at, good] >= np.partition(scores[at, good], -k)[-k] - 2e-9]
                    if len(good):
                        s, i, t = (np.concatenate(p) for p in zip(best[query], (scores[at, good], ids[good], labels[good]), strict=True))
                        order = np.lexsort((i, -np.round(s, 9)))[:k]
                        best[query] = s[order], i[order], t[order]
        for start in range(0, n, 4096):
            part = best[start : start + 4096]
            sizes = [len(p[0]) for p in part]
            if sum(sizes):
                s, i, t = (np.concatenate(p) for p in zip(*part, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked.ids[start : start + 4096], sizes)), pa.array(i), pa.array(t.tolist(), pa.int32()), pa.array(s)], ["query_id", "vec_id", "label", "score"])

    return index.blocks.mapInArrow(run, FOUND)


def _asked(index: Index, queries: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = usable(queries.select(c("query_id").cast("long").alias("query_id"), "q"), "q", index.unit).toArrow()
    x = _matrix(rows["q"].combine_chunks()) if rows.num_rows else np.zeros((0, index.pivots.shape[1]))
    return rows["query_id"].to_numpy(), _unit(x) if index.unit and len(x) else x


def block_topk(index: Index, queries: DataFrame, k: int, threshold: float | None = None) -> DataFrame:
    """(query_id, vec_id, label, score, rank): the best ``k`` of each query (query_id, q), a set of bounded size, none of them the query's own id."""
    spark = queries.sparkSession
    ids, vectors = _asked(index, queries)
    if not len(ids) or not len(index.pivots):
        return spark.createDataFrame([], f"{FOUND}, rank int")
    least = -math.inf if threshold is None else threshold
    asked = Asked(ids, vectors, distances(vectors, index.pivots), np.full(len(ids), least))
    near = written(_compared(index, spark.sparkContext.broadcast(asked), k, True), "near")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "vec_id")
    floors = near.withColumn("rank", F.row_number().over(order)).where(c("rank") == k).select("query_id", "score").toArrow()
    at = dict(zip(floors["query_id"].to_pylist(), floors["score"].to_pylist(), strict=True))
    shared = spark.sparkContext.broadcast(asked._replace(floor=np.array([max(least, at.get(i, least)) for i in ids.tolist()])))
    both = near.unionByName(_compared(index, shared, k, False))
    return both.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k)


def compared_pairs(index: Index, queries: DataFrame, k: int, threshold: float | None = None) -> tuple[int, int]:
    """How many pairs of a query and a vector ``block_topk`` compares, and how many there are."""
    ids, vectors = _asked(index, queries)
    ranked = block_topk(index, queries, k, threshold).where(c("rank") == k).select("query_id", "score").collect()
    at, least = {r["query_id"]: r["score"] for r in ranked}, -math.inf if threshold is None else threshold
    asked = Asked(ids, vectors, distances(vectors, index.pivots), np.array([max(least, at.get(i, least)) for i in ids.tolist()]))
    unit, meta = index.unit, index.blocks.select("cell", "low", "high", F.size("ids").alias("n"))

    @F.arrow_udf("long")
    def needed(cell: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        found = zip(*(x.to_pylist() for x in (cell, low, high)), strict=True)
        return pa.array([len(set(_needed(asked, *b, unit, True)) | set(_needed(asked, *b, unit, False))) for b in found], pa.int64())

    row = meta.select(c("n"), needed("cell", "low", "high").alias("q")).agg(F.sum(c("n") * c("q")), F.sum("n")).first()
    return int(row[0] or 0), int(row[1] or 0) * len(ids)
