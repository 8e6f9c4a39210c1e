"""Structured Streaming twins of the incremental jobs: pending embeddings, running statistics, arrival dedup."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docspark.operators.search import embed
from docspark.plans.fixtures import load
from docspark.registry import query
from docspark.scratch import written
from docspark.sources.sinks import Collection


def stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def embed_pending(chunks: DataFrame, target: Collection, checkpoint: str, skip_existing: bool = True) -> StreamingQuery:
    """Chunks that are not vectorised yet are embedded and upserted by id; a repeated batch changes nothing. Chunks that the collection has
    already are skipped before the model is called. Each batch is embedded once; what it came to is appended to ``<checkpoint>-counts``."""
    waiting = chunks.where(~F.col("vectorized")).select("id", "content", "source")

    def save(batch: DataFrame, number: int) -> None:
        new = batch.dropDuplicates(["id"])
        if skip_existing:
            new = new.join(target.read().select("id"), "id", "left_anti")
        seen = Observation()
        made = new.select("id", embed(F.col("content")).alias("vector"), "source", F.create_map(F.lit("content"), "content").alias("metadata"))
        made = written(made.observe(seen, F.count("*").alias("chunks"), F.count_if(F.col("vector").isNull()).alias("failed")), "embedded")
        target.upsert(made.where("vector is not null"))
        counts = batch.sparkSession.createDataFrame([(number, seen.get["chunks"], seen.get["failed"])], "batch long, chunks long, failed long")
        counts.write.mode("overwrite").parquet(f"{checkpoint}-counts/number={number}")

    return waiting.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _keyed_state(spark: SparkSession) -> None:
    """Keyed state with timers needs the state store on disk, for the session's streams that start from now on."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Uploads(StatefulProcessor):
    """Of each content the id under which it is stored: the stored set's, else the first that came."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "id long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:  # noqa: N802, N803
        known = int(initialState["id"].min())
        self.first.update((min(known, self.first.get()[0]) if self.first.exists() else known,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        ids = sorted(int(i) for part in rows for i in part["id"])
        new = not self.first.exists()
        kept = ids[0] if new else self.first.get()[0]
        if new:
            self.first.update((kept,))
        yield pd.DataFrame({"content_hash": key[0], "id": ids, "kept_id": kept, "inserted": [new and k == 0 for k in range(len(ids))]})

    def close(self) -> None:
        pass


def upload_decisions(docs: DataFrame, stored: DataFrame) -> DataFrame:
    """For each document of a stream (id, text) the id under which its content is kept, and whether it is to be inserted; ``stored`` (id,
    content_hash) is what the catalog has when the stream first starts. Later starts go on from the checkpoint."""
    _keyed_state(docs.sparkSession)
    keyed = docs.select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash")).groupBy("content_hash")
    known = stored.groupBy("content_hash").agg(F.min("id").alias("id")).groupBy("content_hash")
    return keyed.transformWithStateInPandas(Uploads(), "content_hash string, id long, kept_id long, inserted boolean", "append", "None", known)


class Stages(StatefulProcessor):
    """Open stages of a document and what closes them. Events wait for the watermark and are then taken in order of time, so that what comes
    late, but within it, changes nothing."""

    def __init__(self, patience: int, memory: int) -> None:
        self.patience, self.memory = patience, memory

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, event_id long, status string")
        self.open = handle.getListState("open", "at long, event_id long, told boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for part in rows:
            for at, event_id, status in zip(part["ms"], part["event_id"], part["status"], strict=True):
                self.waiting.appendValue((int(at), int(event_id), str(status)))
                self.handle.registerTimer(int(at))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        events = sorted(tuple(x) for x in self.waiting.get()) if self.waiting.exists() else []
        held = [tuple(x) for x in self.open.get()] if self.open.exists() else []
        tell = lambda start, at, success, state: out.append((key[0], key[1], start[1], start[0], at, success, state))
        for at, event_id, status in (e for e in events if e[0] <= now):
            if status == "started":
                held.append((at, event_id, False))
                self.handle.registerTimer(at + self.patience)
                self.handle.registerTimer(at + self.memory)
            else:
                for start in held:
                    tell(start, at, status == "succeeded", "late" if start[2] else "completed")
                held = []
        kept = []
        for at, event_id, told in held:
            if at + self.patience <= now and not told:
                tell((at, event_id), None, None, "stalled")
            if at + self.memory > now:
                kept.append((at, event_id, told or at + self.patience <= now))
        for state, values in ((self.waiting, [e for e in events if e[0] > now]), (self.open, kept)):
            if values:
                state.put(values)
            elif state.exists():
                state.clear()
        names = ["document_id", "stage", "event_id", "started", "completed", "success", "state"]
        found = pd.DataFrame(out, columns=names).astype({"completed": "Int64", "success": "boolean"})
        yield found

    def close(self) -> None:
        pass


def stage_pairs(log: DataFrame, late: str = "10 minutes", patience: int = 3_600_000, memory: int = 86_400_000) -> DataFrame:
    """Stages of a stream (document_id, stage, at, event_id, status) as they end: started_at, completed_at, success, as ``catalog.pair_stages``
    pairs them, and a state. A stage still open ``patience`` milliseconds after its start is told once as ``stalled``; what completes it after that
    is ``late``; after ``memory`` milliseconds it is forgotten."""
    _keyed_state(log.sparkSession)
    timed = log.withWatermark("at", late).select("document_id", "stage", "at", F.unix_millis("at").alias("ms"), "event_id", "status")
    schema = "document_id long, stage string, event_id long, started long, completed long, success boolean, state string"
    found = timed.groupBy("document_id", "stage").transformWithStateInPandas(Stages(patience, memory), schema, "append", "EventTime")
    ended = F.when(F.col("completed").isNotNull(), F.timestamp_millis("completed"))
    return found.select("document_id", "stage", "event_id", F.timestamp_millis("started").alias("started_at"), ended.alias("completed_at"), "success", "state")


def windowed_statistics(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and means by event-time window and type; the same plan runs on a stream (with a watermark) or a table."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def first_arrivals(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """The first document of each content hash within the watermark."""
    hashed = docs.withColumn("content_hash", F.sha2("text", 256))
    return hashed.withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"]) if docs.isStreaming else hashed.dropDuplicates(["content_hash"])


@query("stream_windowed_statistics", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 4) AS mean FROM events GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    x = windowed_statistics(load(s, d, "events"))
    return x.select(F.col("window.start").alias("window_start"), "event_type", "n", F.round("mean", 4).alias("mean"))


@query("stream_first_arrivals", "SELECT count(DISTINCT sha256(text)) AS n FROM documents")
def _(s: SparkSession, d: str) -> DataFrame:
    return first_arrivals(load(s, d, "documents")).agg(F.count("*").alias("n"))
