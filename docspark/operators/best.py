"""The best rows of each query of a set, without shuffling the corpus: each task keeps the ``k`` best of its rows, and only those are ranked.

Query sets are stated ones. They reach the tasks in blocks of bounded size, one pass over the corpus for each; scores of a batch of rows
with all queries of a block are one array of numpy, of bounded size as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docspark.operators.dense import _matrix, _unit, usable

c = F.col
#: Scores that are looked at together, bytes of query vectors in a block, and how far rounding may move a score.
CELLS, BLOCK_BYTES, SLACK = 1 << 21, 64 << 20, 1e-9


class Best:
    """Of each query the ``k`` best rows so far, by score to nine places, ties to the smaller key."""

    def __init__(self, queries: int, k: int, least: float = -np.inf) -> None:
        self.k, self.floor, self.held, self.n = k, np.full(queries, least), [], 0
        self.room = 65_536 + 4 * k * queries

    def add(self, keys: pa.Array, scores: np.ndarray, allowed: np.ndarray | None = None) -> None:
        """``scores`` has a row for each key and a column for each query."""
        good = scores >= self.floor - SLACK
        if allowed is not None:
            good &= allowed
        if len(keys) > 4 * self.k and np.count_nonzero(good) > self.room:  # at first there is no floor: the k-th best of these is one
            shown = np.where(good, scores, -np.inf)
            good &= scores >= np.partition(shown, -self.k, axis=0)[-self.k] - 2 * SLACK
        at, query = np.nonzero(good)
        if len(at):
            value = scores[at, query]
            self.held.append(pa.table({"query": pa.array(query.astype(np.int32)), "score": pa.array(value), "order": pa.array(np.round(value, 9)), "key": keys.take(pa.array(at))}))
            self.n += len(at)
            if self.n > self.room:
                self.cut()

    def cut(self) -> None:
        rows = pa.concat_tables(self.held).combine_chunks()
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("query", "ascending"), ("order", "descending"), ("key", "ascending")]))
        query = rows["query"].to_numpy()
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        last = place == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], rows["order"].to_numpy()[last])
        rows = rows.filter(pa.array(place < self.k))
        self.held, self.n = [rows], rows.num_rows

    def rows(self, ids: pa.Array, names: list[str]) -> Iterator[pa.RecordBatch]:
        if self.held:
            self.cut()
            found = self.held[0].combine_chunks()
            columns = [pa.chunked_array([ids.take(found["query"].combine_chunks())]), found["key"], found["score"]]
            yield from pa.table(columns, names=names).to_batches(max_chunksize=8192)


def ranked(found: DataFrame, k: int, key: str) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    return found.withColumn("rank", F.row_number().over(order)).where(c("rank") <= k)


def product_topk(corpus: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", unit: bool = False, bonus: str | None = None, own: bool = False, most: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, ``key``, score, rank): of each query (query_id, q) the ``k`` rows of ``corpus`` with the largest inner product, of unit
    vectors if ``unit``, with the row's column ``bonus`` added if there is one. If ``own``, a row is not found for the query of its own id.

    The query set is held by the driver and sent to the tasks in blocks of ``most`` bytes; the corpus is read once for each.
    """
    spark, names = corpus.sparkSession, ["query_id", key, "score"]
    asked = usable(queries.select("query_id", "q"), "q", unit)
    kinds = {x: df.schema[x].dataType.simpleString() for x, df in (("query_id", queries), (key, corpus))}
    schema = f"query_id {kinds['query_id']}, {key} {kinds[key]}, score double"
    rows = usable(corpus.select(key, vector, *([bonus] if bonus else [])), vector, unit)
    held = asked.toArrow()
    ids, x = held["query_id"].combine_chunks(), _matrix(held["q"].combine_chunks()) if held.num_rows else np.zeros((0, 1))
    x = _unit(x) if unit and len(x) else x
    found = None
    step = max(1, most // (8 * x.shape[1]))
    for start in range(0, len(x), step):
        shared = spark.sparkContext.broadcast((ids[start : start + step], x[start : start + step]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            mine, q = shared.value
            best, size = Best(len(q), k), max(1, CELLS // len(q))
            same = mine.to_numpy(zero_copy_only=False) if own else None
            for batch in batches:
                for low in range(0, batch.num_rows, size):
                    part = batch.slice(low, size)
                    y = _matrix(part.column(1))
                    scores = (_unit(y) if unit else y) @ q.T
                    if bonus:
                        scores += part.column(2).to_numpy(zero_copy_only=False)[:, None]
                    best.add(part.column(0), scores, part.column(0).to_numpy(zero_copy_only=False)[:, None] != same[None] if own else None)
            yield from best.rows(mine, names)

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return ranked(spark.createDataFrame([], schema) if found is None else found, k, key)
