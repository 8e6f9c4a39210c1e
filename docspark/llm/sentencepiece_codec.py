"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Texts are cut where the vocabulary proves a token boundary; each segment is encoded by a score-ordered
agenda of adjacent symbol pairs and, when first seen by a worker, checked against the library in the same
Arrow batch. Segments are remembered in a memo of bounded bytes that ends with its task, and batches are taken in parts of some megabytes. The ids are always the agenda's; segments of a
text whose ids the library has otherwise are counted in ``differences``, each time that they occur. Models whose
boundaries can't be proven are encoded and checked text by text.

Defined results: a null or empty text has no ids but the end id and decodes to the empty text; the length
of a text is bounded only by a row's size; every other column is passed on untouched, whatever its name;
an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.common import hand_back, pieces_of, table
from docspark.llm.piece_vocab import SPACE, KeyMemo, PieceVocabulary, vocabulary

MODEL = "piece_bpe_32k.model"
#: Characters whose segments are looked up at once.
LOOKUP = 1 << 20
#: Bytes of a generation of the memo: segments of some 25 million characters are then made once, not again and again.
MEMO_BYTES = 64 << 20


class Differing(bytes):
    """Packed ids of a segment for which the library has others."""


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


def checked(keys: list[str], vocab: PieceVocabulary) -> list[bytes]:
    """The agenda's packed ids of segments; the library's, all encoded at once, are held beside them."""
    own = [vocab.key_ids(k) for k in keys]
    return [vocab.packed(a) if a == b else Differing(vocab.packed(a)) for a, b in zip(own, vocab.library_ids(keys), strict=True)]


def _memo(vocab: PieceVocabulary) -> KeyMemo:
    """A task's memo of packed ids, of bounded bytes."""
    return KeyMemo(lambda keys: checked(keys, vocab), MEMO_BYTES)


def _encode_slices(texts: list[str], vocab: PieceVocabulary, memo: KeyMemo) -> list[tuple[list[bytes], int]]:
    """For each text the packed ids of its slices, and how many segments differ from the library's. Segments of all texts are looked up
    at once, very long texts slice by slice."""
    if not vocab.segmented:
        own = [vocab.agenda_ids(vocab.normalised(t)) if t else [] for t in texts]
        return [([vocab.packed(ids)], int(ids != vocab.library.encode(t))) if t else ([], 0) for t, ids in zip(texts, own, strict=True)]
    out: list[tuple[list[bytes], int]] = [([], 0) for _ in texts]
    parts = [(k, part) for k, t in enumerate(texts) if t for part in vocab.slices(t)]
    start = 0
    while start < len(parts):
        end, size = start + 1, len(parts[start][1])
        while end < len(parts) and size + len(parts[end][1]) <= LOOKUP:
            size += len(parts[end][1])
            end += 1
        keys = [vocab.keys(part) for _, part in parts[start:end]]
        packed, at = memo.values([key for own in keys for key in own]), 0
        for (k, _), own in zip(parts[start:end], keys, strict=True):
            ids = packed[at : at + len(own)]
            at += len(own)
            out[k] = ([*out[k][0], b"".join(ids)], out[k][1] + list(map(type, ids)).count(Differing))
        start = end
    return out


def _decode(ids: list[int], vocab: PieceVocabulary, most: int = 1 << 20) -> str:
    """The library's decode(ids); very long lists are cut before a piece that starts a word.

    Cut so, a part's own leading word sign is dropped by the library, and the space comes back by the join.
    """
    if len(ids) <= most or not vocab.simple:
        return vocab.library.decode(ids)
    parts, start = [], 0
    while len(ids) - start > most:
        cut = start + most
        while cut > start and not vocab.library.id_to_piece(ids[cut]).startswith(SPACE):
            cut -= 1
        if cut == start:
            break
        parts.append(vocab.library.decode(ids[start:cut]))
        start = cut
    return " ".join([*parts, vocab.library.decode(ids[start:])])


def encode_decode(text: Column, model_file: str | None = None, add_end: bool = True) -> Column:
    """A struct (ids array<int>, decoded string, differences int) for a column of texts."""
    file = model_file or default_model()

    @F.arrow_udf("ids array<int>, decoded string, differences int")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        vocab = vocabulary(file)
        memo = _memo(vocab)
        for texts in (part for batch in batches for part in pieces_of(batch)):
            ids, ends, decoded, differences, end = [], [0], [], [], 0
            for slices, found in _encode_slices(texts.fill_null("").to_pylist(), vocab, memo):
                parts = [np.frombuffer(s, dtype=np.int32).tolist() for s in slices]
                decoded.append(" ".join(_decode(p, vocab) for p in parts))
                if add_end:
                    slices.append(vocab.packed([vocab.end_id]))
                ids += slices
                end += sum(map(len, slices)) // 4
                ends.append(end)
                differences.append(found)
            values = pa.array(np.frombuffer(b"".join(ids), dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.StructArray.from_arrays([lists, pa.array(decoded, pa.string()), pa.array(differences, pa.int32())], ["ids", "decoded", "differences"])
        memo.clear()
        hand_back()

    return run(text)


def decode_ids(ids: Column, model_file: str | None = None) -> Column:
    """Texts of a column of id lists, as the library's decode(ids) gives them; null for null."""
    file = model_file or default_model()

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocab = vocabulary(file)
        for batch in batches:
            yield pa.array([None if x is None else _decode(x, vocab) for x in batch.to_pylist()], pa.string())

    return run(ids)


def encode_documents(docs: DataFrame, text: str = "text", model_file: str | None = None, add_end: bool = True) -> DataFrame:
    """``docs`` with one struct column ``pieces``: ids, decoded text, differences of agenda and library.

    An input column named ``pieces`` is replaced.
    """
    return docs.withColumn("pieces", encode_decode(F.col(text), model_file, add_end))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of documents: ids as the library gives them with an end id, decoded again, as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_documents(docs)
    return coded.select(
        "doc_id",
        F.size("pieces.ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("pieces.ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("pieces.decoded"), 256).alias("decoded_sha256"),
        F.col("pieces.differences").alias("differences"),
    )
