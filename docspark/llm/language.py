"""Language identification by multilingual mixture inference.

A language is a distribution over hashed character trigrams. A document's trigrams are taken to come from a
mixture of languages; expectation-maximisation estimates its proportions. The set of languages is grown one
by one from the best single one; a language stays only if the log-likelihood rises by more than a penalty
that grows with the logarithm of the document's length. The log-likelihood is concave in the proportions, so
its slope towards a language bounds what that language could add, and most need no run at all.

The distributions are fitted on a sample of at most about ``max_rows`` documents of each language, drawn by
a hash of the key; predictions read whole texts, slab by slab.

Defined results: ``und`` with score 0 if the text is null or has no letter (or no language was learned);
null langs are not learned from; equally likely languages go to the first name; repeated rows are predicted each and learned
from each; other columns, whatever their names, are passed on untouched; an empty table stays empty. There may be any number
of languages: the driver and each worker hold 128 KB for each.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import bounded_fraction, crc_bucket, table

CELLS, SLAB, FOLDS, MAX_ROWS = 32_768, 1 << 18, 3, 1500
#: Neighbouring trigrams overlap, so a document holds about a third as many independent observations.
DEPENDENCE = 3.0
#: Expectation-maximisation ends when no proportion moves by more than this, or after so many rounds.
CONVERGED, ROUNDS = 1e-4, 500


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def trigram_counts(text: str) -> np.ndarray | None:
    """Counts of hashed lower-cased trigrams with a letter in the middle; None without any letter."""
    total, letters = None, _letters()
    for start in range(0, len(text), SLAB):
        before = text[start - 1].lower()[-1] if start else " "
        after = text[start + SLAB : start + SLAB + 1].lower()[:1] or " "
        part = f"{before}{text[start : start + SLAB].lower()}{after}"
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        known = letters[codes]
        if known[1:-1].any():
            c = np.where(known, codes, 32).astype(np.uint32)
            cell = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35))[known[1:-1]]
            counts = np.bincount(((cell ^ (cell >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17), minlength=CELLS)
            total = counts if total is None else total + counts
    return total


def proportions(chances: np.ndarray, n: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Expectation-maximisation: the most likely proportions of languages (rows of ``chances``) for counts ``n`` of cells."""
    pi, total = start, n.sum()
    for _ in range(ROUNDS):
        before, pi = pi, pi * (chances @ (n / (pi @ chances))) / total
        if np.abs(pi - before).max() <= CONVERGED:
            break
    return pi / pi.sum()


@dataclass
class LanguageModel:
    """names in order; chances (languages, CELLS) of trigrams."""

    names: list[str]
    chances: np.ndarray

    def mixture(self, counts: np.ndarray) -> dict[str, float]:
        """The languages of a document and their proportions."""
        cells = np.flatnonzero(counts)
        n = counts[cells].astype(np.float64) / DEPENDENCE
        q = self.chances[:, cells].astype(np.float64)
        total = n.sum()
        penalty = 0.5 * np.log(total + 1) + 2.0
        chosen = [int((np.log(q) @ n).argmax())]
        shares, mixed = np.ones(1), q[chosen[0]]
        best = n @ np.log(mixed)
        while len(chosen) < len(self.names):
            slope = q @ (n / mixed) - total
            tried = [k for k in np.flatnonzero(slope > penalty) if k not in chosen]
            found = None
            for k in tried:
                own = q[[*chosen, k]]
                pi = proportions(own, n, np.r_[shares * 0.8, 0.2])
                gain = n @ np.log(pi @ own) - best
                if gain > penalty and (found is None or gain > found[0]):
                    found = gain, k, pi
            if found is None:
                break
            chosen.append(int(found[1]))
            shares, mixed = found[2], found[2] @ q[chosen]
            best += found[0]
        return {self.names[k]: float(s) for k, s in zip(chosen, shares, strict=True)}

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        counts = trigram_counts(text) if text and self.names else None
        if counts is None:
            return "und", 0.0, {}
        mix = self.mixture(counts)
        name = min(mix, key=lambda k: (-mix[k], k))
        return name, min(1.0, max(0.0, mix[name])), mix


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n) of all rows of a task."""
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if (counts := trigram_counts(text.as_py() or "")) is not None:
                found[lang] = found[lang] + counts if lang in found else counts
    for lang, counts in found.items():
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cells)), pa.array(cells.astype(np.int32)), pa.array(counts[cells].astype(np.int64))], ["lang", "cell", "n"])


def train(docs: DataFrame, max_rows: int = MAX_ROWS) -> LanguageModel:
    """Learn from text and non-null lang of documents whose crc32 bucket is not 1."""
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (crc_bucket(F.col("doc_id"), FOLDS) != 1))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return LanguageModel([], np.zeros((0, CELLS), np.float32))
    shares = docs.sparkSession.createDataFrame([(n, bounded_fraction(max_rows, sizes[n])) for n in sorted(sizes)], "lang string, share double")
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < F.col("share") * F.lit(1 << 30)  # by id and text: rows of one id are drawn apart
    sample = known.join(F.broadcast(shares), "lang").where(drawn).select("lang", "text")
    # at most languages x cells rows reach the driver, whatever the input
    sums = sample.mapInArrow(_count, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(sums["lang"]))  # a language of which no sampled text has a letter can't be told from others
    if not names:
        return LanguageModel([], np.zeros((0, CELLS), np.float32))
    counts = np.full((len(names), CELLS), 0.05)
    at = {n: k for k, n in enumerate(names)}
    np.add.at(counts, (sums["lang"].map(at).to_numpy(dtype=int), sums["cell"].to_numpy(dtype=int)), sums["n"].to_numpy(dtype=float))
    return LanguageModel(names, (counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def identify(text: Column, model: LanguageModel) -> Column:
    """A struct (lang_pred string, score double, mixture map<string,double>) for each text."""
    spark = SparkSession.getActiveSession()
    shared = spark.sparkContext.broadcast(model)  # languages x cells, whatever the corpus

    @F.arrow_udf("lang_pred string, score double, mixture map<string,double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [shared.value.predict(x.as_py()) for x in batch]
            mixture = pa.array([list(m.items()) for _, _, m in found], pa.map_(pa.string(), pa.float64()))
            yield pa.StructArray.from_arrays([pa.array([p for p, _, _ in found], pa.string()), pa.array([s for _, s, _ in found], pa.float64()), mixture], ["lang_pred", "score", "mixture"])

    return run(text)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document, and its share in the document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = docs.select("doc_id", (crc_bucket(F.col("doc_id"), FOLDS) == 1).alias("held_out"), identify(F.col("text"), train(docs)).alias("x"))
    return found.select("doc_id", "held_out", "x.lang_pred", "x.score", "x.mixture")
