"""Language-model scores by stupid backoff, computed relationally.

S(w | u v) = c(u v w) / c(u v) where u v w occurs, else 0.4 S(w | v), and so on down to c(w) / c(), where c() is the
number of all words. The order is a parameter, three by default. Logarithms are natural.

A corpus scored by its own counts holds every n-gram of itself, so nothing would ever back off. A document's own
occurrences are therefore taken from all counts (``leave_out``): what is left is the model of all other documents. A word
that no other document has counts once.

Relations, all packed by block (some ``BLOCK`` bytes of documents) and bucket (a range of n-gram hashes):
- exploded: the distinct n-grams of each block, of every order, with their counts, dealt by bucket;
- counts: each bucket's table of n-grams and their sums, made in the task that has the bucket;
- joined: the exploded n-grams of each block with their counts from that table, dealt back by block;
- summed: a block's documents meet the counts of their n-grams and are summed one by one.
Words and n-grams are known by 64-bit hashes. A block holds an n-gram once, however often its documents repeat it, so no
word, pair or line is hot in any bucket: a bucket gets at most one row of each order from a block. Buckets and blocks are dealt
evenly by number. Nothing is collected or broadcast. There are at least as many buckets as ``BUCKET`` bytes of text
go into all texts, so memory depends on neither the corpus nor its vocabulary: a task holds one order of one bucket, or one
block; a single document beyond ``BLOCK`` is a block of its own and held whole.

The documents are read twice, once to be exploded and once to be summed, and must come in the same order both times and
when a lost task is run again, as the rows of files do; write other frames to a table first.

Words are maximal runs without white space, A-Z lower-cased. Defined results: null and empty texts have no words, a score
of 0 and a null mean; each row is a document of its own, so rows with one doc_id (null included) give a row each, and copies
count for each other; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import table

BACKOFF, ORDER = 0.4, 3
#: Bytes of text in a block, and at most about so many in all the blocks for each bucket.
BLOCK, BUCKET = 8 << 20, 16 << 20
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
EXPLODED = "block long, counted boolean, asked boolean, ngram_order int, bucket int, grams binary, counts binary"
JOINED = "block long, ngram_order int, bucket int, counts binary"
SCORED = "doc_id long, n_tokens long, log_score double, mean_log_score double"


@functools.cache
def _zstd() -> tuple:
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _planes(values: np.ndarray) -> bytes:
    """Numbers as byte planes, so that high bytes, mostly zero, lie together; compressed."""
    return _zstd()[0].compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes())


def _numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(_zstd()[1].decompress(data), dtype=np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()


def _pack(grams: np.ndarray) -> bytes:
    return _planes(np.diff(grams, prepend=np.uint64(0)))


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(_numbers(data), dtype=np.uint64)


class Words:
    """The words of some documents in order: their hashes, their document and place in it, the documents' lengths."""

    def __init__(self, texts: list[bytes]) -> None:
        import xxhash

        runs = [t.lower().split() for t in texts]
        self.lengths = np.array([len(r) for r in runs], dtype=np.int64)
        total = int(self.lengths.sum())
        self.hashes = np.fromiter((h for r in runs for h in map(xxhash.xxh64_intdigest, r)), dtype=np.uint64, count=total)
        self.owner = np.repeat(np.arange(len(runs)), self.lengths)
        self.place = np.arange(total) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)

    def grams(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """(position of the last word, hash) of every n-gram of an order; of order 0 one for each word, all alike."""
        n = len(self.hashes)
        if order == 0:
            return np.arange(n), np.zeros(n, dtype=np.uint64)
        at = np.flatnonzero(self.place >= order - 1)
        mixed = np.full(len(at), order, dtype=np.uint64)
        for k in range(order):
            mixed = (mixed ^ self.hashes[at - k]) * _ODD[k % len(_ODD)]
            mixed ^= mixed >> np.uint64(29)
        return at, mixed


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    """(number, ids, texts) of doc_id, text and the number of the partition: the same blocks whenever the same rows are read."""
    number, ids, texts, held = 0, [], [], 0
    for batch in batches:
        if not ids and not number and batch.num_rows:
            number = batch.column(2)[0].as_py() << 32
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            data = text.as_py() or b""
            if ids and held + len(data) > BLOCK:
                yield number, ids, texts
                number, ids, texts, held = number + 1, [], [], 0
            ids.append(key)
            texts.append(data)
            held += len(data) + 8
    if ids:
        yield number, ids, texts


def _exploder(order: int, buckets: int, counted: bool, asked: bool):  # noqa: ANN202
    """Rows of EXPLODED: the distinct n-grams of a block that belong to a bucket, with how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, _, texts in _blocks(batches):
            words = Words(texts)
            for k in range(order + 1):
                grams, n = np.unique(words.grams(k)[1], return_counts=True)
                bucket = ((grams >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)
                cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(grams)] if len(grams) else np.zeros(1, int)
                parts = [(slice(a, b), int(bucket[a])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                size = len(parts)
                columns = [
                    pa.array([number] * size, pa.int64()),
                    pa.array([counted] * size, pa.bool_()),
                    pa.array([asked] * size, pa.bool_()),
                    pa.array([k] * size, pa.int32()),
                    pa.array([b for _, b in parts], pa.int32()),
                    pa.array([_pack(grams[s]) for s, _ in parts], pa.binary()),
                    pa.array([_planes(n[s]) for s, _ in parts], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["block", "counted", "asked", "ngram_order", "bucket", "grams", "counts"])

    return run


def count_table(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams in order, and the sum of each one's counts."""
    if not grams or not (every := np.concatenate(grams)).size:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    order = np.argsort(every)
    every = every[order]
    starts = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
    return every[starts], np.add.reduceat(np.concatenate(counts)[order], starts)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of EXPLODED sorted by bucket and order; those that ask come back with the counts of the bucket's table."""

    def joined(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        counted = [r for r in rows if r["counted"]]
        known, total = count_table([_unpack(r["grams"]) for r in counted], [_numbers(r["counts"]) for r in counted])
        for r in rows:
            if r["asked"]:
                grams = _unpack(r["grams"])
                found = np.zeros(len(grams), dtype=np.uint64)
                if len(known):
                    at = np.searchsorted(known, grams).clip(0, len(known) - 1)
                    found = np.where(known[at] == grams, total[at], np.uint64(0))
                yield pa.RecordBatch.from_pylist([{"block": r["block"], "ngram_order": r["ngram_order"], "bucket": r["bucket"], "counts": _planes(found)}], schema=kind)

    kind = pa.schema([("block", pa.int64()), ("ngram_order", pa.int32()), ("bucket", pa.int32()), ("counts", pa.binary())])
    held: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if held and (held[0]["bucket"], held[0]["ngram_order"]) != (row["bucket"], row["ngram_order"]):
                yield from joined(held)
                held = []
            held.append(row)
    yield from joined(held)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row of JOINED for each block, ahead of those of its counts: its documents, compressed."""
    import zstandard

    for number, ids, texts in _blocks(batches):
        packed = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "text"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, packed.schema) as writer:
            writer.write_batch(packed)
        data = zstandard.compress(sink.getvalue().to_pybytes(), 6)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([data], pa.binary())], ["block", "ngram_order", "bucket", "counts"])


def block_scores(texts: list[bytes], counts: list[np.ndarray], leave_out: bool, backoff: float = BACKOFF) -> tuple[np.ndarray, np.ndarray]:
    """(words, sum of log S) of each document. ``counts`` has for every order those of the block's distinct n-grams in order."""
    words = Words(texts)
    n = len(words.hashes)
    shorter, best, level = np.zeros(n), np.zeros(n), np.zeros(n, dtype=np.int64)
    for k, total in enumerate(counts):
        at, grams = words.grams(k)
        order = np.argsort(grams, kind="stable")  # so that the same n-grams of a document lie together
        ordered, owner = grams[order], words.owner[at][order]
        new = np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)]
        here = total[np.cumsum(new) - 1].astype(np.float64)
        if leave_out:
            runs = np.flatnonzero(new | np.r_[True, owner[1:] != owner[:-1]][: len(owner)])
            here -= np.repeat(np.diff(np.r_[runs, len(ordered)]), np.diff(np.r_[runs, len(ordered)]))
        mine = np.zeros(n)
        mine[at[order]] = here
        if k == 0:
            shorter = np.maximum(mine, 1)
            continue
        # c() stands beside the word itself; any other history ends one word before it
        history = shorter if k == 1 else np.r_[0.0, shorter[:-1]]
        seen = np.arange(n) >= 0 if k == 1 else (words.place >= k - 1) & (mine > 0)
        top = np.maximum(mine, 1) if k == 1 else mine
        best[seen] = np.log(top[seen] / history[seen])
        level[seen] = k
        shorter = mine
    missed = np.minimum(words.place + 1, len(counts) - 1) - level
    return words.lengths, np.bincount(words.owner, weights=best + missed * np.log(backoff), minlength=len(texts))


def _summer(order: int, leave_out: bool):  # noqa: ANN202
    """Rows of JOINED sorted by block, order and bucket; of each block first the documents, then all counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close() -> pa.RecordBatch:
            docs = pa.ipc.open_stream(_zstd()[1].decompress(held)).read_all()
            n, x = block_scores(docs["text"].to_pylist(), [np.concatenate([np.zeros(0, np.uint64), *c]) for c in counts], leave_out)
            mean = pa.array(x / np.maximum(n, 1), mask=n == 0)
            return pa.RecordBatch.from_arrays([docs["doc_id"].combine_chunks(), pa.array(n, pa.int64()), pa.array(x), mean], ["doc_id", "n_tokens", "log_score", "mean_log_score"])

        now, held, counts = None, None, []
        for batch in batches:
            for block, k, data in zip(*(batch.column(c) for c in ("block", "ngram_order", "counts")), strict=True):
                if now is None or block.as_py() != now:
                    if now is not None:
                        yield close()
                    now, held, counts = block.as_py(), data.as_py(), [[] for _ in range(order + 1)]
                else:
                    counts[k.as_py()].append(_numbers(data.as_py()))
        if now is not None:
            yield close()

    return run


def scores(docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, leave_out: bool = True) -> DataFrame:
    """doc_id, n_tokens, log_score (sum of log S) and mean_log_score of each row of ``docs``, by the n-grams of ``corpus``.

    Without a corpus the documents are their own, and ``leave_out`` takes a document's own occurrences from all counts.
    """
    spark = docs.sparkSession
    text = lambda df: df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.spark_partition_id().alias("part"))
    own = corpus is None
    size = (docs if own else corpus).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET))
    exploded = text(docs).mapInArrow(_exploder(order, buckets, own, True), EXPLODED)
    if not own:
        exploded = exploded.unionByName(text(corpus).mapInArrow(_exploder(order, buckets, True, False), EXPLODED))
    dealt = exploded.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "ngram_order")
    joined = dealt.mapInArrow(_join, JOINED).unionByName(text(docs).mapInArrow(_carried, JOINED))
    by_block = joined.repartitionById(buckets, (F.shiftright("block", 32) % buckets).cast("int")).sortWithinPartitions("block", "ngram_order", "bucket")
    return by_block.mapInArrow(_summer(order, leave_out and own), SCORED)


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of words of every document and their mean log score by the trigrams of all other documents."""
    found = scores(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_tokens", F.round("mean_log_score", 6).alias("mean_log_score"))


#: Of each word the counts of the n-grams that it ends, in all documents but its own.
OP10_SQL = f"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS ws
  FROM documents),
placed AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words),
grams AS (SELECT doc_id, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u FROM placed),
counted AS (
  SELECT doc_id, i,
    count(*) OVER () - count(*) OVER (PARTITION BY doc_id) AS n0,
    count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS n1,
    CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) ELSE 0 END AS n2,
    CASE WHEN i > 2 THEN count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) ELSE 0 END AS n3
  FROM grams),
histories AS (
  SELECT *, lag(n1) OVER (PARTITION BY doc_id ORDER BY i) AS h1, lag(n2) OVER (PARTITION BY doc_id ORDER BY i) AS h2 FROM counted),
scored AS (
  SELECT doc_id, CASE
    WHEN n3 > 0 THEN ln(n3::DOUBLE / h2)
    WHEN n2 > 0 THEN ln(n2::DOUBLE / h1) + (least(i, {ORDER}) - 2) * ln({BACKOFF}::DOUBLE)
    ELSE ln(greatest(n1, 1)::DOUBLE / greatest(n0, 1)) + (least(i, {ORDER}) - 1) * ln({BACKOFF}::DOUBLE) END AS x
  FROM histories)
SELECT d.doc_id, count(s.x) AS n_tokens, round(avg(s.x), 6) AS mean_log_score
FROM documents d LEFT JOIN scored s ON s.doc_id = d.doc_id GROUP BY d.doc_id
"""
