"""Embeddings by a client of a remote model: retries with growing waits, null on failure, statistics.

A client is made by a factory on each worker (connections are not sent around) and takes one cleaned text. What a call took and
how it ended is kept beside its vector, so statistics are a plain aggregate, whichever worker did the work. ``embedded_once`` writes
the result to a table and observes its totals as it does; used twice without a table, the model is called twice.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from docspark.functions.scalars import WS, embed_clean
from docspark.plans.fixtures import load
from docspark.registry import query
from docspark.scratch import written

c = F.col
Client = Callable[[str], list[float]]
RESULT = "struct<vector:array<float>,tokens:bigint,seconds:double,retries:int,error:string>"
_ARROW = pa.struct([("vector", pa.list_(pa.float32())), ("tokens", pa.int64()), ("seconds", pa.float64()), ("retries", pa.int32()), ("error", pa.string())])


def call(client: Client, text: str, retries: int = 3, delay: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> dict:
    """One vector. A failed call, or one without a vector, is tried again after ``delay`` seconds, twice as long each time."""
    for attempt in range(retries + 1):
        began = time.perf_counter()
        try:
            vector = client(text)
            if not vector:
                raise ValueError("the model gave no embedding")
            return {"vector": vector, "tokens": len(text.split()), "seconds": time.perf_counter() - began, "retries": attempt, "error": None}
        except Exception as problem:  # noqa: BLE001  a text that fails must not end the job
            failed = f"{type(problem).__name__}: {problem}"
        if attempt < retries:
            sleep(delay * 2**attempt)
    return {"vector": None, "tokens": 0, "seconds": 0.0, "retries": retries, "error": failed}


def embed_by(text: Column, factory: Callable[[], Client], retries: int = 3, delay: float = 1.0) -> Column:
    """The struct of ``call`` for each text, cleaned first; null for texts that are null or blank, which no call is made for."""

    @F.arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        client = factory()
        for batch in batches:
            yield pa.array([call(client, t, retries, delay) if t else None for t in batch.to_pylist()], _ARROW)

    return run(embed_clean(text))


def embedding_metrics(dimension: int | None = None, column: str = "embedded") -> list[Column]:
    """Totals over the results of ``embed_by``, as aggregates or to be observed while a job writes them."""
    x = lambda name: c(f"{column}.{name}")
    made = x("vector").isNotNull()
    odd = F.count_if(made & (F.size(x("vector")) != dimension)) if dimension else F.lit(0).cast("long")
    zero = lambda value: F.coalesce(value, F.lit(0))
    return [
        F.count_if(made).alias("total_embeddings"), zero(F.sum(x("tokens"))).alias("total_tokens"), zero(F.sum(x("seconds"))).cast("double").alias("total_time"),
        F.count_if(x("error").isNotNull()).alias("errors"), zero(F.sum(x("retries"))).alias("retries"), odd.alias("odd_dimensions"),
    ]


def embedding_statistics(embedded: DataFrame, dimension: int | None = None, column: str = "embedded") -> DataFrame:
    """One row over the results of ``embed_by``. The success rate counts errors against the vectors made, as the totals do; with
    no vector all rates are 0."""
    each = lambda value: F.coalesce(F.try_divide(value, c("total_embeddings")), F.lit(0)).cast("double")
    totals = embedded.agg(*embedding_metrics(dimension, column))
    return totals.select("*", each(c("total_time")).alias("avg_time"), each(c("total_tokens")).alias("avg_tokens"), each(c("total_embeddings") - c("errors")).alias("success_rate"))


def embedded_once(rows: DataFrame, factory: Callable[[], Client], text: str = "content", retries: int = 3, delay: float = 1.0, dimension: int | None = None) -> tuple[DataFrame, dict]:
    """``rows`` with ``embedded``, as a table that the model was called for once, and the job's own totals with rates, observed as it wrote."""
    seen = Observation()
    done = written(rows.withColumn("embedded", embed_by(c(text), factory, retries, delay)).observe(seen, *embedding_metrics(dimension)), "embedded")
    totals = {k: v or 0 for k, v in seen.get.items()}
    n = totals.get("total_embeddings", 0)
    rate = lambda value: value / n if n else 0.0
    return done, totals | {"avg_time": rate(totals["total_time"]), "avg_tokens": rate(totals["total_tokens"]), "success_rate": rate(n - totals["errors"])}


# --- queries ---------------------------------------------------------------------------------------------


def _unsteady() -> Client:
    """A stand-in for a remote model: some texts always fail, others at the first call."""
    seen: set[str] = set()

    def client(text: str) -> list[float]:
        if len(text) % 11 == 0 or (len(text) % 5 == 0 and text not in seen):
            seen.add(text)
            raise ConnectionError("busy")
        seen.discard(text)
        return [float(len(text)), 1.0]

    return client


@query("embedding_client_statistics", rf"""WITH t AS (SELECT substr(trim(regexp_replace(text, '{WS}', ' ', 'g')), 1, 8000) AS t FROM documents), k AS (SELECT *, length(t) % 11 = 0 AS bad, length(t) % 5 = 0 AS slow FROM t WHERE t <> '')
SELECT count(*) FILTER (NOT bad) AS total_embeddings, coalesce(sum(len(list_filter(regexp_split_to_array(t, '{WS}'), lambda w: w <> ''))) FILTER (NOT bad), 0)::BIGINT AS total_tokens,
count(*) FILTER (bad) AS errors, coalesce(sum(CASE WHEN bad THEN 3 WHEN slow THEN 1 ELSE 0 END), 0)::BIGINT AS retries,
round(coalesce((count(*) FILTER (NOT bad) - count(*) FILTER (bad)) / nullif(count(*) FILTER (NOT bad), 0), 0), 6)::DOUBLE AS success_rate FROM k""")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "documents").select(embed_by(c("text"), _unsteady, delay=0.0).alias("embedded"))
    return embedding_statistics(rows).select("total_embeddings", "total_tokens", "errors", "retries", F.round("success_rate", 6).alias("success_rate"))
