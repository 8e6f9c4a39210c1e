"""Benchmark decontamination by SimHash over item-sized windows.

For every benchmark item, windows of the item's own number of words slide over whole documents. A window's
SimHash (128 bits, over its five-word shingles, repeats weighted) is looked up in a multi-index of the
items' fingerprints: eight blocks of 16 bits, each searched to distance 4, which by the pigeonhole principle
finds every fingerprint within ``RADIUS`` = 39 bits. A pair of weighted similarity 0.8 differs in about 19
bits, give or take 4, so the radius lies near five standard deviations beyond. Measured on 7,322 texts of 20 to
600 random words, changed as far as 0.8 allows (words at random, a run, the start): none differed in more than 36
bits. Candidates are verified by the exact weighted Jaccard similarity of the shingles, word by word.

A window without any shingle of any item has similarity 0, so windows are made only around shingles that an
item has; this drops nothing. Items come in blocks of bounded size (``MAX_ITEMS``, ``MAX_BYTES``), each
broadcast in turn, so a benchmark of any size takes bounded memory and one more pass for each block.

Words are runs of letters and digits, lower-cased. Defined results: an item of fewer than five words is
one shingle and must appear whole; a document shorter than an item is one window; items and documents that
are null or without words match nothing; a null id is carried along; repeated rows each match; empty tables
give an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from docspark.llm.common import table

SHINGLE, SIMILARITY, RADIUS, BLOCKS = 5, 0.8, 39, 8
MAX_ITEMS, MAX_BYTES = 1024, 4 << 20
_WORDS = re.compile(r"[^\W_]+").findall
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
MATCH = "array<struct<item_id:{id},similarity:double,start_word:bigint,n_words:bigint,distance:int>>"


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of a shingle's hash depends on all words."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def shingle_sums(hashes: np.ndarray, width: int) -> np.ndarray:
    n = len(hashes) - width + 1
    out = np.zeros(max(0, n), dtype=np.uint64)
    for k in range(width if n > 0 else 0):
        out += hashes[k : k + n] * _ODD[k]
    return out


def _bits(sums: np.ndarray) -> np.ndarray:
    """(shingles, 128) of 0 and 1."""
    both = np.stack([_mixed(sums, 0x1234567), _mixed(sums, 0x7654321000)], axis=1)
    return np.unpackbits(both.view(np.uint8).reshape(len(sums), 16), axis=1, bitorder="little")


def window_prints(sums: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints, as eight 16-bit blocks, of all windows of ``size`` shingles."""
    if len(sums) < size:
        return np.zeros((0, BLOCKS), np.uint16)
    ones = np.zeros((len(sums) + 1, 128), dtype=np.int32)
    np.cumsum(_bits(sums), axis=0, out=ones[1:])
    return np.packbits((ones[size:] - ones[:-size]) * 2 > size, axis=1, bitorder="little").view(np.uint16)


def similarity(a: list[str], b: list[str], width: int) -> float:
    """Weighted Jaccard similarity of the word shingles of two texts."""
    x, y = (Counter(zip(*(w[k : len(w) - width + 1 + k] for k in range(width)), strict=True)) for w in (a, b))
    shared = (x & y).total()
    return shared / max(1, x.total() + y.total() - shared)


@dataclass
class Index:
    """Items of one block: their words, shingles and the multi-index of their fingerprints."""

    items: list[tuple[int | None, list[str]]]
    widths: dict[int, tuple] = field(default_factory=dict)
    near: np.ndarray | None = None
    prints: np.ndarray | None = None

    def build(self) -> Index:
        n = len(self.items)
        self.prints = np.zeros((n, BLOCKS), np.uint16)
        for width in sorted({min(SHINGLE, len(w)) for _, w in self.items}):
            sums, owners = [], []
            for k, (_, words) in enumerate(self.items):
                if min(SHINGLE, len(words)) == width:
                    own = shingle_sums(word_hashes(words), width)
                    self.prints[k] = window_prints(own, len(own))[0]
                    sums.append(own)
                    owners.append(np.full(len(own), k))
            sums, owners = np.concatenate(sums), np.concatenate(owners)
            order = np.argsort(sums, kind="stable")
            seen = np.zeros(1 << 20, dtype=bool)
            seen[(sums >> np.uint64(44)).astype(np.int64)] = True
            self.widths[width] = sums[order], owners[order], seen
        values = np.arange(1 << 16, dtype=np.uint16)
        self.near = np.stack([np.packbits(np.bitwise_count(values[:, None] ^ self.prints[None, :, b]) <= RADIUS // BLOCKS, axis=1, bitorder="little") for b in range(BLOCKS)])
        return self

    def matches(self, text: str | None) -> list[dict]:
        words = _WORDS(text.lower()) if text else []
        if not words or not self.items:
            return []
        hashes, best = word_hashes(words), {}
        for width, (known, owners, seen) in self.widths.items():
            sums = shingle_sums(hashes, width)
            hits = np.flatnonzero(seen[(sums >> np.uint64(44)).astype(np.int64)])
            if not len(hits):
                continue
            first, last = np.searchsorted(known, sums[hits], "left"), np.searchsorted(known, sums[hits], "right")
            hits, first, last = (x[last > first] for x in (hits, first, last))
            sizes: dict[int, set[int]] = {}
            for h, a, b in zip(hits.tolist(), first.tolist(), last.tolist(), strict=True):
                for k in set(owners[a:b].tolist()):
                    sizes.setdefault(len(self.items[k][1]), set()).add(h)
            for size, at in sizes.items():
                self._search(words, sums, width, size, np.array(sorted(at)), best)
        return [best[k][1] for k in sorted(best)]

    def _search(self, words: list[str], sums: np.ndarray, width: int, size: int, hits: np.ndarray, best: dict) -> None:
        """Windows of ``size`` words around the hits, in runs; the best window of each item is kept."""
        shingles = min(size - width + 1, len(sums))
        of_size = np.packbits([len(w) == size for _, w in self.items], bitorder="little")
        low, high = np.maximum(hits - shingles + 1, 0), np.minimum(hits, len(sums) - shingles)
        begins = np.flatnonzero(np.r_[True, low[1:] > np.maximum.accumulate(high)[:-1] + 1])
        for a, b in zip(begins, np.r_[begins[1:], len(hits)], strict=True):
            lo, hi = int(low[a]), int(high[a:b].max())
            for start in range(lo, hi + 1, 4096):
                stop = min(hi, start + 4095)
                prints = window_prints(sums[start : stop + shingles], shingles)
                found = self.near[0][prints[:, 0]]
                for k in range(1, BLOCKS):
                    found = found | self.near[k][prints[:, k]]
                at, item = np.nonzero(np.unpackbits(found & of_size, axis=1, count=len(self.items), bitorder="little"))
                distance = np.bitwise_count(prints[at] ^ self.prints[item]).sum(axis=1)
                close = np.flatnonzero(distance <= RADIUS)
                for c in close[np.argsort(distance[close], kind="stable")].tolist():
                    k, s = int(item[c]), start + int(at[c])
                    if k in best and best[k][0][0] >= 1.0:
                        continue
                    alike = similarity(words[s : s + size], self.items[k][1], width)
                    if alike >= SIMILARITY and (k not in best or (alike, -s) > best[k][0]):
                        best[k] = (alike, -s), {"item_id": self.items[k][0], "similarity": alike, "start_word": s, "n_words": min(size, len(words) - s), "distance": int(distance[c])}


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, list[str]]]]:
    """The items with words, in blocks of bounded size."""
    block, held = [], 0
    for row in benchmark.select("item_id", "text").where("text is not null").toLocalIterator():
        if words := _WORDS(row["text"].lower()):
            if block and (len(block) >= MAX_ITEMS or held + len(row["text"]) > MAX_BYTES):
                yield block
                block, held = [], 0
            block.append((row["item_id"], words))
            held += len(row["text"])
    if block:
        yield block


def match_columns(spark: SparkSession, text: Column, benchmark: DataFrame) -> list[Column]:
    """For each block of items a column of the matches in a text: an array of structs, empty for most texts."""
    id_type = benchmark.schema["item_id"].dataType
    return [_match_column(text, spark.sparkContext.broadcast(block), id_type) for block in _blocks(benchmark)]


def _match_column(text: Column, shared: Broadcast, id_type: DataType) -> Column:
    built: list[Index] = []

    @F.arrow_udf(MATCH.format(id=id_type.simpleString()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not built:
            built.append(Index(shared.value).build())
        kind = pa.list_(pa.struct([("item_id", to_arrow_type(id_type)), ("similarity", pa.float64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("distance", pa.int32())]))
        for batch in batches:
            yield pa.array([built[0].matches(x.as_py()) for x in batch], kind)

    return run(text)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, similarity, start_word, n_words, distance."""
    spark = docs.sparkSession
    parts = [docs.select("doc_id", F.explode(c).alias("m")).select("doc_id", "m.*") for c in match_columns(spark, F.col("text"), benchmark)]
    return reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, similarity double, start_word bigint, n_words bigint, distance int")


def without(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item; nothing is shuffled."""
    for found in match_columns(docs.sparkSession, F.col("text"), benchmark):
        docs = docs.where(F.size(found) == 0)
    return docs


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the item and the place."""
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
