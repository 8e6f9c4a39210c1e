"""The registered queries on the smallest tables: against their SQL, or column by column against brute force."""

import hashlib
import re
import zlib

import duckdb
import pytest
import sentencepiece

from docspark.llm import decontaminate, language, quality, queries, sentencepiece_codec
from tests.llm.test_llm_operators import brute_components, brute_mixture, brute_print, brute_quality

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings benchmark labels conversations".split()


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())


def rows(spark, name):
    found = queries.QUERIES[name](spark, SF).collect()
    keyed = {r["doc_id"]: r for r in found}
    assert len(keyed) == len(found)
    return keyed


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_every_operator_has_a_query():
    assert {name.split("_")[0] for name in queries.QUERIES} == {f"op{n}" for n in range(1, 14)} and set(queries.SQL) < set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, other = queries.QUERIES[name](spark, SF), con.execute(queries.SQL[name])
    names = [d[0] for d in other.description]
    plain = lambda row: tuple(round(v, 5) if isinstance(v, float) else v for v in row)
    assert sorted(df.columns) == sorted(names)
    assert sorted((plain(r) for r in df.select(*names).collect()), key=repr) == sorted(map(plain, other.fetchall()), key=repr)


def test_op1(spark, texts, library):
    found = rows(spark, "op1_sentencepiece")
    for k, t in texts.items():
        ids = [*library.encode(t), library.eos_id()]
        r = found.pop(k)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["differences"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), 0)
    assert not found


def test_op2(spark, texts):
    keys = sorted(texts)
    prints = [brute_print(texts[k]) for k in keys]
    expected = {k: (f"{p:016x}", comp) for k, p, comp in zip(keys, prints, brute_components(keys, prints), strict=True)}
    assert {k: (r["fingerprint"], r["component_id"]) for k, r in rows(spark, "op2_simhash_dedup").items()} == expected


def test_op3(spark, texts):
    network = quality.train(*(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels")))
    found = rows(spark, "op3_quality")
    assert set(found) == set(texts)
    for k, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1
        if len(texts[k]) < 1500:
            assert r["score"] == pytest.approx(brute_quality(network, texts[k].encode()), abs=1e-4)


def test_op5(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model, langs = language.train(docs), {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = rows(spark, "op5_language_id")
    assert set(found) == set(texts)
    for k, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r["score"] <= 1
        if len(texts[k]) < 700:
            mix = brute_mixture(model, texts[k])
            assert (r["lang_pred"], r["score"]) == ((max(mix, key=mix.get), pytest.approx(max(mix.values()), abs=0.02)) if mix else ("und", 0.0))
    assert sum(r["lang_pred"] == langs[k] for k, r in found.items()) > 0.97 * len(found)


def test_op8(spark, texts, library):
    found = rows(spark, "op8_token_counts")
    expected = {k: (len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 4096) for k, t in texts.items()}
    assert {k: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for k, r in found.items()} == expected


def test_op9(spark, texts):
    items = {r["item_id"]: re.findall(r"[^\W_]+", (r["text"] or "").lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    expected = {}
    for k, t in texts.items():
        words = re.findall(r"[^\W_]+", t.lower())
        for item, own in items.items():
            if own and set(own) & set(words):
                width = min(5, len(own))
                best = max(decontaminate.similarity(words[s : s + len(own)], own, width) for s in range(max(1, len(words) - len(own) + 1)))
                if best >= 0.8:
                    expected[k, item] = best
    found = queries.QUERIES["op9_decontamination"](spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in found} == pytest.approx(expected) and len(found) == len(expected) > 0
