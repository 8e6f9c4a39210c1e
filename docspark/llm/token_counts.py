"""Token counts of whole texts, by the library of the vocabulary.

Every text is encoded in overlapping chunks; one that fits a chunk is its own only one. The library gives each token's byte
offset. Where two chunks overlap the offsets are laid side by side, and the encodings are spliced at the first boundary that
both have and that the vocabulary proves stable: a space after another character, where a token always starts if no piece
holds a word sign after another character, so no merge crosses it, whatever comes before or after. Where an overlap has
none, it is widened fourfold and tried again, up to the rest of the text if need be, so a text without spaces is encoded
about once in all. Vocabularies without that proof have no stable boundary and are widened at once.

Memory holds a text and the tokens of one chunk. Defined results: null and empty texts have no tokens and no bytes; extra
columns, whatever their names, are passed on untouched; repeated rows are counted each; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import table
from docspark.llm.piece_vocab import SPACE, PieceVocabulary, vocabulary
from docspark.llm.sentencepiece_codec import default_model

#: Bytes.
CHUNK, OVERLAP = 4096, 256
LIMIT = 4096
_SIGN = SPACE.encode()


def _whole(data: bytes, at: int) -> int:
    """The first end of a character from ``at`` on."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


def stable(data: bytes, at: int) -> bool:
    """A word starts at ``at``: a proven boundary for vocabularies whose pieces hold word signs only in front."""
    return 0 < at < len(data) and data[at] == 32 and data[at - 1] != 32 and data[max(0, at - 3) : at] != _SIGN


def _splice(data: bytes, left: list, start: int, right: list, stop: int) -> tuple[int, int, int] | None:
    """(offset, left tokens before it, right tokens before it) of the first stable boundary after ``stop`` that both have."""
    begins = {}
    for k in range(len(left) - 1, -1, -1):
        if (at := start + left[k].begin) <= stop:
            break
        begins[at] = k
    last = max(begins, default=stop)
    for k, token in enumerate(right):
        if (at := stop + token.begin) > last:
            break
        if at > stop and at in begins and stable(data, at):
            return at, begins[at], k
    return None


def count_by_overlap(data: bytes, vocab: PieceVocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text in UTF-8 from overlapping chunks, exactly as many as of the whole."""
    tokens = lambda a, b: vocab.library.encode(data[a:b].decode(), return_type="proto", num_threads=1).pieces
    n, total, start, stop, skip, held = len(data), 0, 0, chunk, 0, None
    while True:
        stop, width = _whole(data, stop), overlap if vocab.segmented else n
        while True:
            end = _whole(data, stop + width)
            if end == n:
                return total - skip + (len(held[1]) if held and held[0] == n else len(vocab.library.encode(data[start:].decode(), num_threads=1)))
            left = held[1] if held and held[0] == end else tokens(start, end)
            follow_end = _whole(data, stop + chunk + width)
            right = tokens(stop, follow_end)
            if spliced := _splice(data, left, start, right, stop):
                break
            width *= 4  # alignment failed: widen the overlap and try again
        total += spliced[1] - skip
        start, skip, held = stop, spliced[2], (follow_end, right)
        stop = max(start + chunk, spliced[0] + 1)


def count_tokens(text: Column, model_file: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Number of tokens of each text, without begin, end or added special tokens; 0 for null."""
    file = model_file or default_model()

    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(file)
        for batch in batches:
            yield pa.array([count_by_overlap(x.as_py() or b"", vocab, chunk, overlap) for x in batch.cast(pa.binary())], pa.int64())

    return run(text)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, and whether they pass 4,096 tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), count_tokens(F.col("text")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
