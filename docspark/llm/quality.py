"""Quality classifier: a byte-level convolutional network in numpy.

Filters of six bytes are learned as one table of weights per offset (a convolution over one-hot bytes). They
run over chunks of 256 bytes that overlap by half and cover the whole document; each filter is max-pooled in
every chunk, and the chunks' values are combined (their mean and their largest) into one probability.

The network is fitted on a bounded sample of labelled rows (``max_rows``, drawn by a hash of the key and the text, the same in
every run), of each the whole text. Fitting and scoring share the forward pass, which goes over a text slab by slab and holds
a few MB whatever its length; the driver holds the sample's texts, ``MAX_BYTES`` at most. lang, source and doc_id are never inputs.

Defined results: null and empty texts get the score that no active filter gives; labels that are null take
no part, of repeated labels of a document the largest counts; rows that share a labelled doc_id (null ids have no label) all
take that label, and count for the bound each; without any label of both kinds every score
is the share of label 1 (a half without labels); other columns are passed on untouched, whatever their names; an empty table
stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import bounded_fraction, crc_bucket, hash_unit, table

WIDTH, FILTERS, STRIDE, SLAB = 6, 16, 128, 65_536
MAX_ROWS, FOLDS, THRESHOLD = 1500, 5, 0.3
#: Bytes of the sample's texts together.
MAX_BYTES = 64 << 20


@dataclass
class Network:
    """tables: weights (WIDTH, 256, FILTERS); mean and top: weights of a chunk's mean and largest values."""

    tables: np.ndarray
    bias: np.ndarray
    mean: np.ndarray
    top: np.ndarray
    shift: float

    def _slabs(self, data: bytes) -> Iterator[tuple[int, np.ndarray]]:
        """(first byte, values of all filters at each byte of the next blocks), block by block of ``STRIDE`` bytes."""
        n = len(data)
        for start in range(0, n, SLAB):
            stop = min(n, start + SLAB)
            here = -(-(stop - start) // STRIDE) * STRIDE
            part = np.zeros(here + WIDTH, dtype=np.uint8)
            given = np.frombuffer(data, dtype=np.uint8, offset=start, count=min(n - start, len(part)))
            part[: len(given)] = given
            values = self.tables[0].take(part[:here], axis=0)
            for k in range(1, WIDTH):
                values += self.tables[k].take(part[k : k + here], axis=0)
            values[stop - start :] = -1e9
            yield start, values.reshape(-1, STRIDE, FILTERS)

    def chunk_values(self, data: bytes) -> np.ndarray:
        """Max-pooled filter values of all chunks of a document; a chunk is a block and the next one."""
        if not data:
            return np.zeros((1, FILTERS), dtype=np.float32)
        best = np.concatenate([values.max(axis=1) for _, values in self._slabs(data)])
        return np.maximum((np.maximum(best[:-1], best[1:]) if len(best) > 1 else best) + self.bias, 0)

    def winners(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, FILTERS): the largest value of each filter in each chunk, and the first of the bytes that give it."""
        best, place = [], []
        for start, values in self._slabs(data):
            at = values.argmax(axis=1)
            best.append(np.take_along_axis(values, at[:, None], axis=1)[:, 0])
            place.append(at + start + STRIDE * np.arange(len(at))[:, None])
        if not best:
            return np.zeros((0, FILTERS), np.float32), np.zeros((0, FILTERS), np.int64)
        best, place = np.concatenate(best), np.concatenate(place)
        if len(best) == 1:
            return best, place
        later = best[1:] > best[:-1]
        return np.where(later, best[1:], best[:-1]), np.where(later, place[1:], place[:-1])

    def score(self, data: bytes) -> float:
        values = self.chunk_values(data)
        z = values.mean(axis=0) @ self.mean + values.max(axis=0) @ self.top + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 4, batch: int = 32, seed: int = 7) -> Network:
    """Adam on the logistic loss over all chunks of the texts. Max-pooling sends a filter's gradient to the bytes that won."""
    rng = np.random.default_rng(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    shape = (WIDTH, 256, FILTERS)
    shift = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if not len(labels) or not 0 < share < 1:
        return Network(np.zeros(shape, np.float32), np.zeros(FILTERS, np.float32), np.zeros(FILTERS), np.zeros(FILTERS), shift)
    p = {"tables": rng.normal(0, 0.05, shape).astype(np.float32), "bias": np.zeros(FILTERS, np.float32), "mean": rng.normal(0, 0.3, FILTERS), "top": rng.normal(0, 0.1, FILTERS), "shift": np.array(shift)}
    first, second, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    cell = np.arange(FILTERS)
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        rate = 0.03 * (1 - epoch / epochs) + 0.003
        for at in range(0, len(order), batch):
            ids = order[at : at + batch]
            network = Network(p["tables"], p["bias"], p["mean"], p["top"], float(p["shift"]))
            grad = {"tables": np.zeros(WIDTH * 256 * FILTERS)} | {k: np.zeros(FILTERS) for k in ("bias", "mean", "top")} | {"shift": np.zeros(())}
            for i in ids.tolist():
                best, place = network.winners(texts[i])
                raw = best + p["bias"] if len(best) else np.zeros((1, FILTERS))
                active = np.maximum(raw, 0)
                mean, top = active.mean(axis=0), active.max(axis=0)
                z = mean @ p["mean"] + top @ p["top"] + p["shift"]
                dz = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[i]) * weight[i] / len(ids)
                grad["mean"] += dz * mean
                grad["top"] += dz * top
                grad["shift"] += dz
                if len(best):
                    dvalue = dz / len(raw) * p["mean"] + np.where(active == top, dz * p["top"], 0)
                    dvalue = np.where(raw > 0, dvalue, 0.01 * dvalue)
                    grad["bias"] += dvalue.sum(axis=0)
                    data = np.frombuffer(texts[i] + bytes(WIDTH), dtype=np.uint8).astype(np.int64)
                    for k in range(WIDTH):
                        grad["tables"] += np.bincount(((k * 256 + data[place + k]) * FILTERS + cell).ravel(), weights=dvalue.ravel(), minlength=WIDTH * 256 * FILTERS)
            grad["tables"] = grad["tables"].reshape(shape)
            step += 1
            for k, v in p.items():
                g = grad[k] + 1e-4 * v
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                p[k] = (v - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(v.dtype)
    return Network(p["tables"], p["bias"].astype(np.float32), p["mean"], p["top"], float(p["shift"]))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """At most ``max_rows`` labelled texts of ``max_bytes`` together whose crc32 bucket is not 0: (order, text, quality). In the order of
    their hashes, texts that would go beyond the bytes are left out. Sizes are looked at first, so no other text is sent anywhere."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (crc_bucket(F.col("doc_id"), FOLDS) != 0)).groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    share = bounded_fraction(max_rows, known.count())
    sample = known.where(hash_unit(F.col("doc_id")) < 1.2 * share)  # about so many rows, so the broadcast is bounded as well
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.select(F.xxhash64("doc_id", "text").alias("order"), "text", "quality")
    sizes = texts.select("order", F.octet_length("text").alias("bytes")).orderBy("order").limit(max_rows).collect()
    held, over = 0, set()
    for row in sizes:
        if held + row["bytes"] > max_bytes:
            over.add(row["order"])
        else:
            held += row["bytes"]
    if over:  # else all of the first rows fit
        chosen = docs.sparkSession.createDataFrame([(x,) for x in {r["order"] for r in sizes} - over], "order long")
        texts = texts.join(F.broadcast(chosen), "order")
    return texts.orderBy("order", "text", "quality").limit(max_rows)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Network:
    """Fit on labelled documents whose crc32 bucket is not 0. ``labels`` has doc_id and quality."""
    rows = training_rows(docs, labels, max_rows).toArrow()
    return fit([t.as_py() for t in rows["text"].cast(pa.binary())], rows["quality"].to_numpy().astype(float))


def score(text: Column, network: Network) -> Column:
    """The probability of label 1 for each text."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([network.score(x.as_py() or b"") for x in batch.cast(pa.binary())], pa.float64())

    return run(text)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    network = train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (crc_bucket(F.col("doc_id"), FOLDS) == 0).alias("held_out"), score(F.col("text"), network).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
