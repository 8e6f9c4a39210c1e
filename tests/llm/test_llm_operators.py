"""The llm operators against brute force, with nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docspark.llm import chat, common, components, decontaminate, language, lm_score, mtree, quality, sentencepiece_codec, sharding, simhash, token_counts
from docspark.llm.piece_vocab import KeyMemo, vocabulary

c = F.col
MODEL = sentencepiece_codec.default_model()
ODD = [None, "", " ", "  two  spaces ", "line\nfeed\n\n x", "▁ literal ▁▁", "é中𝒳\x00\t", "a" * 3000, "the cat sat on the mat. " * 4000, "x" * 70_000, "the cat"]
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, texts, lang="en"):
    return spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t in enumerate(texts)], DOCS)


def noise(n, seed=0, alphabet="ab \n\t▁é中𝒳e.the"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(n)]


# --- SentencePiece and token counts ----------------------------------------------------------------------


def test_agenda_and_boundaries_match_the_library():
    v = vocabulary(MODEL)
    assert v.simple and v.segmented
    for text in noise(600) + [t for t in ODD if t]:
        right = v.library.encode(text)
        assert [i for k in v.keys(text) for i in v.key_ids(k)] == right
        assert [i for ids in v.library_ids(v.keys(text)) for i in ids] == right
        assert [i for part in v.slices(text, 25) for k in v.keys(part) for i in v.key_ids(k)] == right
        assert sentencepiece_codec._decode(right, v, 6) == v.library.decode(right)


def test_codec_query_columns(spark):
    docs = table(spark, ODD).withColumn("pieces", F.lit("clash")).withColumn("ids", F.lit(1))
    rows = sentencepiece_codec.encode_documents(docs).orderBy("doc_id").collect()
    v = vocabulary(MODEL)
    for row, text in zip(rows, ODD, strict=True):
        ids = v.library.encode(text or "") + [v.end_id]
        assert row["pieces"]["ids"] == ids and row["pieces"]["decoded"] == v.library.decode(ids) and row["pieces"]["differences"] == 0 and row["ids"] == 1
    assert sentencepiece_codec.encode_documents(table(spark, [])).count() == 0
    back = spark.createDataFrame([([1526, 2],), (None,)], "i array<int>").select(sentencepiece_codec.decode_ids(c("i")).alias("t")).collect()
    assert [r["t"] for r in back] == [v.library.decode([1526, 2]), None]


def test_ids_are_the_agendas(monkeypatch):
    """With a library that answers otherwise, the ids stay the agenda's and each differing segment is counted."""
    v = vocabulary(MODEL)
    right, other = v.library.encode("the cat the dog"), lambda keys: [[7] if k == "the" else v.key_ids(k) for k in keys]
    monkeypatch.setattr(v, "library_ids", other)
    memo = KeyMemo(lambda keys: sentencepiece_codec.checked(keys, v))
    for _ in range(2):  # the second time from the memo
        ((packed, differences),) = sentencepiece_codec._encode_slices(["the cat the dog"], v, memo)
        assert np.frombuffer(b"".join(packed), dtype=np.int32).tolist() == right and differences == 2


def test_overlap_counts():
    v = vocabulary(MODEL)
    for text in noise(300, 1) + [t for t in ODD if t]:
        for chunk, overlap in ((40, 8), (7, 1), (4096, 256)):
            assert token_counts.count_by_overlap(text.encode(), v, chunk, overlap) == len(v.library.encode(text))


def test_overlap_counts_splice_and_widen(monkeypatch):
    """Many splices in a text of words, one encoding of the whole in a text without any boundary."""
    v, spliced, real = vocabulary(MODEL), [], token_counts._splice
    monkeypatch.setattr(token_counts, "_splice", lambda *a: spliced.append(real(*a)) or spliced[-1])
    text = "the cat sat on the mat. " * 500 + "y" * 20_000 + " and the dog" * 9000
    assert token_counts.count_by_overlap(text.encode(), v) == len(v.library.encode(text))
    assert sum(x is not None for x in spliced) >= 5 and None in spliced
    spliced.clear()
    assert token_counts.count_by_overlap(b"x" * 300_000, v) == len(v.library.encode("x" * 300_000)) and set(spliced) == {None} and len(spliced) < 8


def test_token_counts(spark):
    docs = table(spark, ODD + ODD).withColumn("n", F.lit("clash")).withColumn("n_tokens", F.lit(-1))
    found = [r["n"] for r in docs.orderBy("doc_id").select(token_counts.count_tokens(c("text")).alias("n")).collect()]
    assert found == [len(vocabulary(MODEL).library.encode(t or "")) for t in ODD + ODD]


# --- SimHash ---------------------------------------------------------------------------------------------


def brute_print(text):
    import xxhash

    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))] if ws else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(keys, prints, radius=3):
    comp = list(range(len(keys)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                comp[max(find(i), find(j))] = min(find(i), find(j))
    return [min(keys[j] for j in range(len(keys)) if find(j) == find(i)) for i in range(len(keys))]


def near_texts():
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 6) for _ in range(400)) for _ in range(12)]
    out = []
    for t in base:
        out += [t, t] if rng.random() < 0.5 else [t]
        for _ in range(rng.randint(0, 5)):
            ws = t.split()
            ws[rng.randrange(len(ws))] = "zz"
            t = " ".join(ws)
            out.append(t)
    return [*out, None, "", "one two", "One TWO"]


@pytest.mark.parametrize("hot", [4096, 1])
def test_near_duplicates_against_brute_force(spark, hot):
    texts = near_texts()
    prints = [brute_print(t) for t in texts]
    expected = brute_components(list(range(len(texts))), prints)
    rows = simhash.near_duplicates(table(spark, texts).withColumn("key", F.lit(0)).withColumn("fp", F.lit("x")), hot=hot).collect()
    found = {r["doc_id"]: (r["fp"] % 2**64, r["component"]) for r in rows}
    assert found == {k: (p, e) for k, (p, e) in enumerate(zip(prints, expected, strict=True))}
    assert len(set(expected)) < len(texts) - 5


def test_near_duplicates_edges(spark):
    assert simhash.near_duplicates(table(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c d"), (None, "q r s t"), (7, "a b c d"), (7, "a b c d")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["component"]) for r in simhash.near_duplicates(rows).collect() if r["component"]) == [(0, 7), (7, 7), (7, 7)]


def test_crowded_buckets_are_split_until_small(spark):
    """Fingerprints that share all but a few bits: no bucket that is compared stays crowded, no link is lost."""
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**63))
    prints = sorted({base ^ int(sum(1 << int(b) for b in rng.choice(20, 4, replace=False))) for _ in range(300)})
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp bigint"), hot=8).collect()
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert (a ^ b).bit_count() <= 3
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert [find(p) for p in prints] == brute_components(prints, prints)
    masks = [simhash._signed(0)]
    for _ in range(9):
        masks = [m for x in masks for m in simhash.finer(x)][:8]
    assert all(bin(m % 2**64).count("1") >= 52 for m in masks)


@pytest.mark.parametrize("radius", [2, 3])
def test_bit_slices(radius):
    rng = np.random.default_rng(radius)
    prints = []
    for b in rng.integers(0, 2**63, 40):
        for _ in range(6):
            v = int(b)
            for _ in range(rng.integers(0, 4)):
                v ^= 1 << int(rng.integers(0, 64))
            prints.append(v)
    prints = np.array(prints, dtype=np.uint64)
    bucket = np.sort(rng.integers(0, 9, len(prints)))
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in zip(*simhash.spanning_links(prints, bucket, radius), strict=True):
        assert bucket[i] == bucket[j] and int(prints[i] ^ prints[j]).bit_count() <= radius
        root[max(find(i), find(j))] = min(find(i), find(j))
    for i in range(len(prints)):
        for j in range(i):
            if bucket[i] == bucket[j] and int(prints[i] ^ prints[j]).bit_count() <= radius:
                assert find(i) == find(j)


def test_buckets_over_batches():
    """A bucket cut by batches is still compared as a whole."""
    import pyarrow as pa

    fp = np.arange(10, dtype=np.int64)
    keys = np.array([0, 1, 1, 1, 1, 1, 2, 2, 3, 4])
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[s]), pa.array(keys[s] * 0), pa.array(fp[s])], ["mask", "value", "fp"]) for s in (slice(0, 3), slice(3, 4), slice(4, 8), slice(8, 10))]
    links = {frozenset(x) for b in simhash._spans(iter(batches)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)}
    assert {x for link in links for x in link} == {1, 2, 3, 4, 5, 6, 7} and len(links) == 5


def test_components(spark):
    rng = random.Random(5)
    links = [(k, k + 1) for k in range(60)] + [(100, 200), (200, 100), (5, 5)] + [(rng.randrange(300, 340), rng.randrange(300, 340)) for _ in range(25)]
    found = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {x: x for link in links for x in link}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert found == root
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- quality and language --------------------------------------------------------------------------------


def judged(spark, n=400):
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["the", "cat", "sat", "mat", "on"]) + ("!!$$" if k % 4 == 0 else "") for _ in range(60)) for k in range(n)]
    return table(spark, texts), spark.createDataFrame([(k, int(k % 4 != 0), 0) for k in range(n)] + [(1, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")


def test_quality_learns_and_covers_whole_texts(spark):
    docs, labels = judged(spark)
    network = quality.train(docs, labels)
    rows = docs.select("doc_id", quality.score(c("text"), network).alias("s")).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert np.mean([(r["s"] >= quality.THRESHOLD) == (r["doc_id"] % 4 != 0) for r in held]) > 0.95
    good, bad = b"the cat sat on the mat " * 6000, b"the!!$$ cat!!$$ sat!!$$ " * 4000
    assert network.score(good) > 0.5 > network.score(bad) and network.score(good + bad) != network.score(good)
    assert 0 <= network.score(b"") <= 1


def brute_quality(network, data):
    """The score of a text, one byte and one chunk at a time."""
    at = lambda t: data[t] if t < len(data) else 0
    values = [[sum(float(network.tables[k][at(t + k)][f]) for k in range(quality.WIDTH)) for f in range(quality.FILTERS)] for t in range(len(data))]
    starts = range(0, max(1, len(data) - quality.STRIDE), quality.STRIDE)
    chunks = [[max(0.0, max(v[f] for v in values[s : s + 2 * quality.STRIDE]) + float(network.bias[f])) for f in range(quality.FILTERS)] for s in starts] if data else [[0.0] * quality.FILTERS]
    z = network.shift
    for f in range(quality.FILTERS):
        column = [chunk[f] for chunk in chunks]
        z += sum(column) / len(column) * network.mean[f] + max(column) * network.top[f]
    return 1 / (1 + np.exp(-min(30, max(-30, z))))


def random_network(seed=0):
    rng = np.random.default_rng(seed)
    f = quality.FILTERS
    return quality.Network(rng.normal(0, 0.3, (quality.WIDTH, 256, f)).astype(np.float32), rng.normal(0, 0.1, f).astype(np.float32), rng.normal(0, 0.3, f), rng.normal(0, 0.1, f), 0.1)


@pytest.mark.parametrize("size", [0, 1, 5, 127, 128, 129, 256, 257, 700, 1300])
def test_quality_scores_against_brute_force(monkeypatch, size):
    """Whole texts, over the borders of chunks and slabs; fitting sees the same values and where they come from."""
    monkeypatch.setattr(quality, "SLAB", 512)
    network, data = random_network(), np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    assert network.score(data) == pytest.approx(brute_quality(network, data), abs=1e-5)
    best, place = network.winners(data)
    if size:
        assert np.allclose(np.maximum(best + network.bias, 0), network.chunk_values(data))
        at = lambda t: data[t] if t < size else 0
        assert np.allclose(best, [[sum(network.tables[k][at(t + k)][f] for k in range(quality.WIDTH)) for f, t in enumerate(row)] for row in place], atol=1e-5)


def test_quality_gradient():
    """One step of the fit lowers the loss of its batch; the end of a text counts as much as its beginning."""
    texts = [b"a" * 1500 + (b"good text " if k % 2 else b"!!$$!!$$!! ") * 9 for k in range(60)]
    labels = np.array([float(k % 2) for k in range(60)])
    network = quality.fit(texts, labels, epochs=6, batch=12)
    assert np.mean([(network.score(t) > 0.5) == y for t, y in zip(texts, labels, strict=True)]) > 0.95


def test_quality_of_repeats_nulls_and_clashes(spark):
    docs, labels = judged(spark, 60)
    odd = docs.union(docs).union(table(spark, ["x"]).withColumn("doc_id", F.lit(None).cast("long"))).withColumn("quality", F.lit("clash")).withColumn("order", F.lit(1))
    rows = quality.training_rows(odd, labels, 30)
    assert rows.count() == 30 and quality.training_rows(odd, labels).count() == 2 * sum(zlib.crc32(str(k).encode()) % 5 != 0 for k in range(60))
    a, b = quality.train(odd, labels), quality.train(odd.repartition(3), labels)
    assert np.array_equal(a.tables, b.tables)
    assert quality.train(docs.where("false"), labels).score(b"x") == 0.5


def test_quality_without_labels(spark):
    docs = table(spark, ODD)
    network = quality.train(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert {round(r["s"], 6) for r in docs.select(quality.score(c("text"), network).alias("s")).collect()} == {0.5}


def test_language(spark):
    words = {"en": ["the", "house", "with", "that"], "de": ["das", "haus", "mit", "nicht"], "fr": ["une", "maison", "avec", "pas"]}
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(40)), lang, "s", 0) for k, lang in enumerate(["en", "de", "fr"] * 80)] + [(1000, "the house", None, "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("clash"))
    model = language.train(docs)
    assert model.names == ["de", "en", "fr"]
    found = docs.select("lang", language.identify(c("text"), model).alias("x")).collect()
    assert np.mean([r["x"]["lang_pred"] == (r["lang"] or "en") for r in found]) > 0.99
    mixed = model.predict(" ".join(words["en"] * 30 + words["de"] * 30))
    assert set(mixed[2]) == {"en", "de"} and 0.3 < mixed[1] < 0.7
    assert [model.predict(t)[:2] for t in (None, "", "12 ?")] == [("und", 0.0)] * 3
    assert language.trigram_counts("ab" * language.SLAB).sum() == 2 * language.SLAB
    assert language.train(table(spark, [])).predict("the house")[0] == "und"


def brute_mixture(model, text):
    """The mixture of a text by plain loops: every language set that one more language makes, each with its own long EM."""
    padded, n = f" {text.lower()} ", collections.Counter()
    norm = "".join(ch if ch.isalpha() else " " for ch in padded)
    for k in range(1, len(norm) - 1):
        if norm[k].isalpha():
            a, b, d = (ord(ch) for ch in norm[k - 1 : k + 2])
            h = (a * 0x9E3779B1 + b * 0x85EBCA6B + d * 0xC2B2AE35) % 2**32
            n[((h ^ h >> 15) * 0x2C1B3C6D % 2**32) >> 17] += 1 / language.DEPENDENCE
    if not n:
        return None
    total = sum(n.values())
    like = lambda pi: sum(x * np.log(sum(share * float(model.chances[k][cell]) for k, share in pi.items())) for cell, x in n.items())

    def fitted(ks):
        pi = {k: 1 / len(ks) for k in ks}
        for _ in range(300):
            new = dict.fromkeys(ks, 0.0)
            for cell, x in n.items():
                parts = {k: pi[k] * float(model.chances[k][cell]) for k in ks}
                for k in ks:
                    new[k] += x * parts[k] / sum(parts.values()) / total
            pi = new
        return pi

    chosen = fitted([max(range(len(model.names)), key=lambda k: (like({k: 1.0}), -k))])
    while len(chosen) < len(model.names):
        best = max((fitted([*chosen, k]) for k in range(len(model.names)) if k not in chosen), key=like)
        if like(best) - like(chosen) <= 0.5 * np.log(total + 1) + 2.0:
            break
        chosen = best
    return {model.names[k]: x for k, x in chosen.items()}


def tongues(spark):
    words = {"en": "the house with that of and".split(), "de": "das haus mit nicht und der".split(), "fr": "une maison avec pas et le".split(), "es": "una casa con que y el".split()}
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(40)), lang, "s", 0) for k, lang in enumerate(list(words) * 30)]
    return words, spark.createDataFrame(rows, DOCS)


def test_mixtures_against_brute_force(spark):
    words, docs = tongues(spark)
    model, rng = language.train(docs), random.Random(3)
    for langs in (["en"], ["de", "fr"], ["en", "es"], ["en", "de", "fr"], ["fr", "es", "de", "en"]):
        text = " ".join(rng.choice(words[lang]) for lang in langs for _ in range(rng.randint(15, 60)))
        expected, (name, score, mix) = brute_mixture(model, text), model.predict(text)
        assert set(mix) == set(expected) and mix == pytest.approx(expected, abs=0.01)
        assert name == max(expected, key=expected.get) and score == mix[name]


def test_learned_chances_against_brute_force(spark):
    """Trigrams of all documents outside the held-out bucket, rows that repeat included, nothing of the others."""
    _, docs = tongues(spark)
    docs = docs.union(docs.where("doc_id < 10")).union(table(spark, ["zz zz"], None).withColumn("doc_id", F.lit(0).cast("long")))
    model = language.train(docs)
    counts = np.full((4, language.CELLS), 0.05)
    for r in docs.collect():
        if r["lang"] and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            counts[model.names.index(r["lang"])] += language.trigram_counts(r["text"])
    assert np.allclose(model.chances, counts / counts.sum(axis=1, keepdims=True), rtol=1e-5)


def test_many_languages_and_ties(spark):
    rows = [(k, f"{chr(97 + k // 26)}{chr(97 + k % 26)} " * 9, f"l{k:03d}", "s", 0) for k in range(300)]
    model = language.train(spark.createDataFrame(rows, DOCS))
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert len(model.names) == len(held) < 300 and len(held) > 150 and model.predict(held[7][1])[0] == held[7][2]
    same = language.train(spark.createDataFrame([(0, "abc abc", "b", "s", 0), (0, "abc abc", "a", "s", 0)], DOCS))
    assert same.predict("abc")[0] == "a"


# --- chat ------------------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("text", ["", "<|im_end|>", "<\\|x", "<\\\\|", "a\nb", "<", "<|", "\\<|\\", "<<|im_start|>assistant\nok"])
def test_escape_round_trip(text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.read_back(chat.chat_template([(text, text)])) == (text, text)


def test_chat_spans_and_masks(spark):
    rng = random.Random(4)
    bits = ["<|im_end|>", "<|im_start|>assistant ok", "hi", "\n", "\\", "<", "|", "é𝒳"]
    rows = [(conv, t, rng.choice(["user", "assistant", "system", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(5))])) for conv in range(6) for t in range(rng.randint(1, 90))]
    rows += [(None, 0, "user", "x"), (None, None, "assistant", "y"), (1, 3, "assistant", "again"), (1, 3, "assistant", "again")]
    df = spark.createDataFrame(rows, TURNS).withColumn("span", F.lit(1)).withColumn("position", F.lit(2))
    found = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(df)).collect()}
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    for conv in {r[0] for r in rows}:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
        loss = "".join(t for role, t in turns if role == "assistant")
        row = found[conv]
        assert row["n_turns"] == len(turns) and row["formatted_chars"] == len(chat.chat_template(turns)) and row["loss_chars"] == len(loss)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest() and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(spark.createDataFrame([], TURNS))).count() == 0


def test_templates_that_look_back_or_rewrite():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")] * 20
    numbered = lambda ts: "<s>" + "".join(f"[{k}:{r}]{t}" for k, (r, t) in enumerate(ts))
    renderer = chat.Renderer(numbered)
    spans = [renderer.add(*t) for t in turns]
    assert "<s>" + "".join(s["span"] for s in spans) == numbered(turns) and not any(s["rewrites"] for s in spans)
    assert all(s["span"][s["loss_start"] : s["loss_end"]] == t for s, (r, t) in zip(spans, turns, strict=True) if r == "assistant")
    forgetful = lambda ts: "".join(t if k == len(ts) - 1 else "." for k, (_, t) in enumerate(ts))
    renderer = chat.Renderer(forgetful)
    assert [renderer.add(*t)["rewrites"] for t in turns[:3]] == [False, True, True]


# --- sharding --------------------------------------------------------------------------------------------


def test_shards_are_even_stable_and_constant(spark):
    names = sharding.shard_names(16)
    owner = sharding.lookup_table(names)
    sizes = np.bincount(owner)
    assert sizes.max() - sizes.min() <= 1
    fewer = sharding.lookup_table(names[:-1])
    moved = sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 15) / len(owner)
    assert moved < 0.1
    docs = spark.createDataFrame([(k, "x") for k in [None, 1, 1, 2, 3]], "doc_id bigint, shard string").withColumn("slot", F.lit(9))
    rows = sharding.assign_shards(docs, "doc_id", names).collect()
    assert len(rows) == 5 and all(r["shard"] == owner[int(hashlib.md5(str(r["doc_id"] if r["doc_id"] is not None else "").encode()).hexdigest()[:15], 16) % sharding.SLOTS] for r in rows)
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(names, 2050)


def test_written_shards(spark, tmp_path):
    names = sharding.shard_names(3)
    sharding.write_shards(spark.range(300).withColumn("text", F.lit("t")), "id", names, f"{tmp_path}/s", 101)
    assert spark.read.parquet(f"{tmp_path}/s").groupBy("shard").count().count() == 3 and spark.read.parquet(f"{tmp_path}/s").count() == 300


# --- exact top-k -----------------------------------------------------------------------------------------


def brute_topk(rows, k=5):
    """{query id: [[(rank, vec_id, score), ...] for each of its rows]} by Python's integers."""
    usable = [(i, [math.floor(float(c) * 256) for c in x]) for i, x in rows if i is not None and x and all(c is not None and math.isfinite(c) for c in x)]
    out = {}
    for a, (q, x) in enumerate(usable):
        if q % 50 == 0:
            order = sorted((-sum(s * t for s, t in zip(x, y, strict=False)), i) for b, (i, y) in enumerate(usable) if a != b)[:k]
            out.setdefault(q, []).append([(n, i, max(-(2**63), min(2**63 - 1, -s))) for n, (s, i) in enumerate(order, 1)])
    return {q: sorted(answers) for q, answers in out.items()}


def found_topk(spark, rows):
    df = spark.createDataFrame([(i, None if x is None else [None if c is None else float(c) for c in x], 0, "clash") for i, x in rows], "vec_id bigint, embedding array<double>, score int, row string")
    flat = sorted(map(tuple, mtree.top_k(mtree.quantised(df, "vec_id", "embedding")).collect()))
    return {q: sorted(r[1:] for r in flat if r[0] == q) for q in {r[0] for r in flat}}


def flat_topk(expected):
    return {q: sorted(x for answer in answers for x in answer) for q, answers in expected.items()}


@pytest.mark.parametrize(("page", "queries", "leaf"), [(60, 3, 8), (16_384, 16_384, 256)])
def test_topk_against_brute_force(spark, monkeypatch, page, queries, leaf):
    for name, value in (("PAGE", page), ("QUERIES", queries), ("LEAF", leaf)):
        monkeypatch.setattr(mtree, name, value)
    vectors = np.random.default_rng(8).normal(size=(400, 6)).round(2)
    vectors[50:200] = vectors[50]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)] + [(1000, None), (1050, [1.0, None]), (1051, [float("nan")] * 6), (None, [1.0] * 6), (1052, [float("inf")] * 6), (1053, []), (1054, [9.0])]
    assert found_topk(spark, rows) == flat_topk(brute_topk(rows))


def test_topk_of_repeated_queries_and_large_values(spark):
    """Each row of a repeated id has its own answer; scores beyond 2^53 and 2^63 rank exactly."""
    repeats = [(0, [1.0]), (0, [-1.0]), (0, [1.0]), (1, [2.0]), (2, [2.0]), (3, [-3.0])]
    assert found_topk(spark, repeats) == flat_topk(brute_topk(repeats))
    large = [(0, [5000.0, 1e12]), (1, [5000.0, 1e12]), (2, [4999.5, 1e12]), (3, [5000.25, 1e12]), (4, [1.0, 2.0]), (50, [-1e14, 3.0]), (51, [1e14, 1.0]), (52, [1e14, 0.99]), (53, [-1e13, 1.0]), (54, [-1e13, 1.1])]
    assert found_topk(spark, large) == flat_topk(brute_topk(large))
    rng = np.random.default_rng(3)
    wild = [(k, (rng.normal(size=4) * 10.0 ** rng.integers(-3, 13)).tolist()) for k in range(0, 500, 5)]
    assert found_topk(spark, wild) == flat_topk(brute_topk(wild))


def test_topk_few_and_none(spark):
    assert found_topk(spark, [(0, [1.0]), (3, [2.0])]) == {0: [(1, 3, 131072)]}
    assert found_topk(spark, [(0, [1.0])]) == found_topk(spark, [(1, [1.0]), (2, [2.0])]) == found_topk(spark, []) == {}


def test_tree_avoids_distances(monkeypatch):
    monkeypatch.setattr(mtree, "LEAF", 64)
    rng = np.random.default_rng(1)
    points = np.floor(np.concatenate([rng.normal(m, 0.05, (200, 8)) for m in (-4, 0, 4)]) * 256).astype(np.int64)
    tree = mtree.MTree(np.arange(600), np.arange(600), points, float((points**2).sum(axis=1).max()))
    best = tree.search(points[-1], -1, None)
    scores = points @ points[-1]
    assert sorted((b[:2] for b in best), key=lambda b: (-b[0], b[1])) == [(int(scores[i]), int(i)) for i in np.lexsort((np.arange(600), -scores))[:5]]
    assert tree.avoided > 0 and tree.computed < 600


# --- decontamination -------------------------------------------------------------------------------------


def passage(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def test_decontamination_against_brute_force(spark):
    items = [(1, " ".join(passage(1, 30))), (2, " ".join(passage(2, 12))), (3, "just four short words"), (4, None), (5, "!!"), (6, " ".join(passage(1, 30)))]
    changed = passage(1, 30)
    changed[0] = "new"
    broken = passage(1, 30)
    broken[10] = broken[20] = broken[25] = "new"
    texts = [None, "", " ".join(passage(9, 50) + passage(1, 30) + passage(8, 20)), " ".join(passage(7, 3) + changed), " ".join(passage(7, 3) + broken), " ".join(passage(2, 12)).upper().replace(" ", ", "), "it has Just four, short WORDS in it", " ".join(passage(2, 11)), " ".join(passage(6, 5000) + passage(2, 12)), "just four other short words"]
    docs = table(spark, texts + texts[2:3]).withColumn("item_id", F.lit("clash")).withColumn("similarity", F.lit(0))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.contaminated(docs, bench).collect()}
    expected = {}
    for k, t in enumerate(texts + texts[2:3]):
        ws = re.findall(r"[^\W_]+", (t or "").lower())
        for item, b in items:
            iw = re.findall(r"[^\W_]+", (b or "").lower())
            if ws and iw:
                best = max(decontaminate.similarity(ws[s : s + len(iw)], iw, min(5, len(iw))) for s in range(max(1, len(ws) - len(iw) + 1)))
                if best >= 0.8:
                    expected[k, item] = best
    assert found == pytest.approx(expected) and len(expected) >= 8
    assert {r["doc_id"] for r in decontaminate.without(docs, bench).collect()} == set(range(len(texts) + 1)) - {k for k, _ in expected}
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == 0
    assert decontaminate.contaminated(table(spark, []), bench).count() == 0


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "MAX_ITEMS", 3)
    bench = spark.createDataFrame([(k, " ".join(passage(k, 20))) for k in range(10)], "item_id bigint, text string")
    docs = table(spark, [" ".join(passage(k, 20)) for k in range(10)])
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()} == {(k, k) for k in range(10)}


def test_radius_keeps_alike_passages():
    missed = 0
    for seed in range(60):
        words = passage(seed, 45)
        other = list(words)
        other[seed % 45] = "changed"
        index = decontaminate.Index([(1, words)]).build()
        if decontaminate.similarity(other, words, 5) >= 0.8:
            missed += not index.matches(" ".join(passage(999, 9) + other + passage(998, 9)))
    assert missed == 0


# --- language-model scores -------------------------------------------------------------------------------


def brute_scores(texts, order=3, corpus=None, backoff=0.4):
    """(words, sum of log S) of each text, from counts of all other texts or of a corpus."""
    runs = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in texts]
    counted = runs if corpus is None else [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for t in corpus]
    grams = lambda r: collections.Counter(tuple(r[i - k : i]) for k in range(order + 1) for i in range(max(1, k), len(r) + 1))
    every = sum(map(grams, counted), collections.Counter())
    out = []
    for r in runs:
        left, total = every if corpus is not None else every - grams(r), 0.0
        for i, w in enumerate(r):
            k, factor = min(order, i + 1), 1.0
            while k > 1 and not left[tuple(r[i + 1 - k : i + 1])]:
                k, factor = k - 1, factor * backoff
            history = tuple(r[i + 1 - k : i])
            total += np.log(factor * (left[*history, w] if k > 1 else max(1, left[(w,)])) / (left[history] if k > 1 else max(1, left[()])))
        out.append((len(r), total))
    return out


LM_TEXTS = [None, "", "the", "the cat\x0bsat", "the cat sat", "The CAT sat", "zz " * 3000, "only here"]


@pytest.mark.parametrize("order", [1, 2, 3, 5])
def test_lm_scores_against_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(lm_score, "BLOCK", 200)
    monkeypatch.setattr(lm_score, "BUCKET", 100)
    rng = random.Random(6)
    texts = [" ".join(rng.choice("the a Of cat dog sat x1 x2 x3 x4".split()) for _ in range(rng.randint(0, 25))) for _ in range(30)] + LM_TEXTS
    docs = table(spark, texts).withColumn("n", F.lit(1)).withColumn("block", F.lit(1)).withColumn("counts", F.lit("x")).repartition(3, "doc_id")
    for corpus in (None, texts[:9]):
        other = None if corpus is None else table(spark, corpus)
        found = {r["doc_id"]: r for r in lm_score.scores(docs, other, order).collect()}
        for k, (n, total) in enumerate(brute_scores(texts, order, corpus)):
            assert found[k]["n_tokens"] == n and found[k]["log_score"] == pytest.approx(total)
            assert found[k]["mean_log_score"] == (pytest.approx(total / n) if n else None)


def test_lm_scores_of_odd_tables(spark):
    assert lm_score.scores(table(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (2, "q")], "doc_id bigint, text string")
    found = sorted(((r["doc_id"] or 0), r["n_tokens"], round(r["log_score"], 9)) for r in lm_score.scores(rows).collect())
    assert found == [(k, n, round(float(x), 9)) for k, (n, x) in zip([0, 1, 1, 2], brute_scores(["a b", "a b", "a b", "q"]), strict=True)]


# --- pipeline --------------------------------------------------------------------------------------------


def brute_near(rows):
    """The indices that stay of (doc_id, text) rows: one of each component of fingerprints and five-word similarities."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    texts = [rows[i][1] or "" for i in order]
    five = [set(zip(*(re.findall(r"[^\x20\x09-\x0D]+", t.lower())[k:] for k in range(5)), strict=False)) for t in texts]
    prints, comp = [brute_print(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            alike = five[i] and len(five[i] & five[j]) >= 0.8 * len(five[i] | five[j])
            if alike or texts[i] == texts[j] or (prints[i] ^ prints[j]).bit_count() <= 3:
                comp = [min(comp[i], comp[j]) if x in (comp[i], comp[j]) else x for x in comp]
    return {order[k] for k in set(comp)}


def brute_leaks(text, items):
    """Whether a text has a window of an item's length with a weighted five-word similarity of 0.8."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    grams = lambda ws, n: collections.Counter(tuple(ws[k : k + n]) for k in range(len(ws) - n + 1))
    for item in items:
        iw = re.findall(r"[^\W_]+", (item or "").lower())
        n = min(5, len(iw))
        own = grams(iw, n) if iw else {}
        for at in range(max(1, len(words) - len(iw) + 1)) if iw else ():
            window = grams(words[at : at + len(iw)], n)
            if (shared := sum((window & own).values())) and shared >= 0.8 * (sum(window.values()) + sum(own.values()) - shared):
                return True
    return False


def test_pipeline_against_brute_force(spark):
    """Each stage's decisions on the smallest tables, taken again one document at a time by code of its own."""
    import sentencepiece

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, labels, bench = docs.columns, spark.read.parquet(f"{sf}/labels.parquet"), [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    network = quality.train(docs, labels)
    kept = {k for k, t in rows.items() if (brute_quality(network, t.encode()) if len(t) < 500 else network.score(t.encode())) >= corpus_pipeline.QUALITY_FLOOR}
    model = language.train(docs.where(c("doc_id").isin(sorted(kept))))
    mixtures = {k: brute_mixture(model, rows[k]) if len(rows[k]) < 400 else model.predict(rows[k])[2] for k in kept}
    kept = sorted(k for k, x in mixtures.items() if x and max(x.values()) >= corpus_pipeline.LANGUAGE_FLOOR)
    kept = {kept[i] for i in brute_near([(k, rows[k]) for k in kept])}
    kept = {k for k in kept if not brute_leaks(rows[k], bench)}
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    found = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert set(found) == kept and all(r["ids"] == [*library.encode(rows[k]), library.eos_id()] and r["round_trip"] for k, r in found.items())
    assert 0.5 * len(rows) < len(kept) < len(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == columns


def test_near_dedup_of_clashing_and_null_ids(spark):
    """Rows with one id and different texts are different documents; null ids take part; exact copies of a row leave one."""
    a, b, d, e = (" ".join(passage(k, 60)) for k in (11, 12, 13, 14))
    rows = [(7, a), (7, b), (7, b), (None, d), (None, d), (None, a), (None, e), (9, e), (3, d + " end"), (8, None), (10, ""), (None, None)]
    found = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted(map(tuple, found), key=repr) == sorted([(7, a), (7, b), (3, d + " end"), (9, e), (8, None)], key=repr)


@pytest.mark.parametrize("kind", ["odd", "empty"])
def test_stages_on_odd_tables(spark, tmp_path, kind):
    rows = [] if kind == "empty" else [(k % 4 if k % 3 else None, t, None if k % 2 else "en", None, None) for k, t in enumerate(ODD + ODD)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = vocabulary(MODEL).library
    found = {(r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    # without labels every text is of quality 0.5; what has a letter is of the one language known, and one row of each text stays
    kept = {}
    for k, t, *_ in rows:
        if any(ch.isalpha() for ch in t or ""):
            kept[t] = min(kept.get(t, (True, 0)), (k is None, k or 0))
    kept = {(None if none else k, (*model.encode(t), model.eos_id())) for t, (none, k) in kept.items()}
    assert found == (kept if rows else set())


def planted_copies():
    """(similarity, original, copy) of five-word sets, planted at 0.8 to 0.95 in texts of 60 to 1,000 words."""
    rng = random.Random(8)
    five = lambda t: set(zip(*(t.split()[k:] for k in range(5)), strict=False))
    out = []
    while len(out) < 120:
        ws = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice((60, 100, 200, 1000)))]
        changed = list(ws)
        for _ in range(rng.randint(1, max(1, len(ws) // 45))):
            changed[rng.randrange(len(ws))] = f"x{rng.randrange(10**6)}"
        a, b = " ".join(ws), " ".join(changed)
        j = len(five(a) & five(b)) / len(five(a) | five(b))
        if 0.8 <= j <= 0.95:
            out.append((j, a, b))
    return out


def test_hot_keys_of_joins(spark):
    left = spark.createDataFrame([(k % 3 if k < 900 else k, k) for k in range(1000)], "key bigint, x bigint")
    right = left.groupBy("key").agg(F.count("*").alias("n")).where("key <> 1")
    found = common.join_counted(left, right, ["key"], 1000, 10)
    assert sorted((r["key"], r["x"]) for r in found.collect()) == sorted((r["key"], r["x"]) for r in left.collect() if r["key"] != 1)


def shuffled_bytes(spark):
    """Bytes that all stages so far have written to shuffles."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_sieves_hold_all_their_keys(spark):
    """Also hashes of either sign; few others pass, and the rest are just those that don't."""
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("hash"))
    rows = rows.unionByName(spark.createDataFrame([(-k, x) for k, x in enumerate((0, -1, 2**63 - 1, -(2**63)), 1)], "id bigint, hash bigint"))
    held = common.sieve(rows.where("id % 10 = 0 or id < 0"), "hash")
    found = {r["id"] for r in common.sift(rows, "hash", held).collect()}
    rest = {r["id"] for r in common.sift(rows, "hash", held, "left_anti").collect()}
    assert set(range(0, 20_000, 10)) | {-1, -2, -3, -4} <= found and len(found) < 2_050
    assert not found & rest and len(found) + len(rest) == 20_004
    empty = common.sieve(rows.where("false"), "hash")
    assert common.sift(rows, "hash", empty).count() == 0 and common.sift(rows, "hash", empty, "left_anti").count() == 20_004


def test_near_dedup_deals_no_texts_without_copies(spark):
    """Where joins are not broadcast, only texts that something is like are dealt, and the keys of all bands: under half of the bytes."""
    rng = random.Random(12)
    texts = [" ".join(rng.randbytes(8).hex() for _ in range(300)) for _ in range(600)]  # so many that no key is hot
    rows = [*enumerate(texts), (600, texts[3]), (3, texts[3]), (601, texts[5] + " end"), (7, texts[8] + " end"), (None, texts[9]), (None, None), (602, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    path = f"{common.shared_dir(spark)}/dealt-{rng.random()}"
    docs.write.parquet(path)
    before, limit = shuffled_bytes(spark), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, spark.read.parquet(path), "").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted(kept, key=str) == sorted([x for x in enumerate(texts) if x[0] != 8] + [(7, texts[8] + " end"), (602, None)], key=str)
    assert shuffled_bytes(spark) - before < sum(map(len, texts)) // 2


def test_large_groups_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(simhash, "GROUP", 5)
    test_near_dedup_of_planted_copies(spark)


def test_near_dedup_of_planted_copies(spark):
    """Each copy of similarity 0.8 to 0.95 goes, none of those that share half of an original."""
    pairs = planted_copies()
    halves = [a[: len(a) // 2] + " " + " ".join(f"y{k}-{n}" for n in range(a.count(" ") // 2)) for k, (_, a, _) in enumerate(pairs[:20])]
    rows = [(k, t) for k, t in enumerate([a for _, a, _ in pairs] + [b for _, _, b in pairs] + halves)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n", F.lit("clash")).withColumn("text_hash", F.lit(1))
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == set(range(len(pairs))) | set(range(2 * len(pairs), len(rows)))
    prints = [(simhash.simhash(a.encode()) ^ simhash.simhash(b.encode())).bit_count() for _, a, b in pairs]
    assert sum(x <= simhash.RADIUS for x in prints) < len(pairs) // 2  # the fingerprints alone miss most


def test_verified_links_against_brute_force():
    rng = random.Random(9)
    base = [[rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(60)] for _ in range(3)]
    texts = []
    for k in range(60):
        ws = list(base[k % 3])
        for _ in range(rng.randint(0, 3)):
            ws[rng.randrange(len(ws))] = "zz"
        texts.append(" ".join(ws).encode())
    sets = [set(simhash.shingle_set(t).tolist()) for t in [*texts, b"", b"one two"]]
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                comp = [min(comp[i], comp[j]) if x in (comp[i], comp[j]) else x for x in comp]
    found = list(range(len(sets)))
    for i, j in simhash.verified_links([*texts, b"", b"one two"]):
        found = [min(found[i], found[j]) if x in (found[i], found[j]) else x for x in found]
    assert found == comp and 3 < len(set(comp)) < 60


def test_near_dedup_stage_against_brute_force(spark):
    """The stage on the smallest tables: what is kept of components by fingerprints or by a five-word similarity of 0.8."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    by_prints = set(brute_components(sorted(k for k, _ in rows), [brute_print(t) for _, t in sorted(rows)]))
    kept = {rows[i][0] for i in brute_near(rows)}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == kept < by_prints


def test_long_chats_of_templates_that_look_back():
    """Whatever its turn, a rewrite is seen at the turn where it happens, and at no other."""
    line = lambda turns: "".join(f"<{r}>{t}\n" for r, t in turns)
    first = lambda turns: "".join(f"<{r}>{t}{turns[0][1] if r == 'tool' else ''}\n" for r, t in turns)
    last_40 = lambda turns: line(turns[-40:])
    summary = lambda turns: line(turns) if len(turns) < 90 else f"[{len(turns) - 1} turns]" + line(turns[-1:])
    turns = [("tool" if k % 50 == 49 else "user", f"t{k}") for k in range(100)]
    for template, rewritten in ((line, 0), (first, 0), (last_40, 60), (summary, 11)):
        renderer = chat.Renderer(template)
        found = [renderer.add(*turn)["rewrites"] for turn in turns]
        assert renderer.output == template(turns)
        assert found == [False] * (100 - rewritten) + [True] * rewritten


def test_chats_keep_the_type_of_ids(spark):
    rows = spark.createDataFrame([("b", 1, "user", "x"), ("a", 1, "assistant", "y"), (None, 1, "user", "")], "conv_id string, turn bigint, role string, text string")
    assert {r["conv_id"]: r["loss_chars"] for r in chat.digests(chat.format_conversations(rows)).collect()} == {"a": 1, "b": 0, None: 0}


def test_prints_of_texts_at_the_least_similarity_stay_within_the_radius():
    """Texts that are changed word by word, as far as a similarity of 0.8 allows, at random, in a run or from the start."""
    rng, far, n_pairs = random.Random(1), 0, 0
    for size in (20, 40, 80, 150, 300):
        for trial in range(60):
            words = [f"w{rng.randrange(5000)}" for _ in range(size)]
            changed, start = list(words), rng.randrange(size)
            order = rng.sample(range(size), size) if trial % 3 == 0 else [(k + start * (trial % 3 == 1)) % size for k in range(size)]
            for at in order:
                kept, changed[at] = changed[at], f"x{rng.randrange(5000)}"
                if decontaminate.similarity(changed, words, 5) < decontaminate.SIMILARITY:
                    changed[at] = kept
                    break
            a, b = (decontaminate.window_prints(decontaminate.shingle_sums(decontaminate.word_hashes(w), 5), size - 4)[0] for w in (words, changed))
            far, n_pairs = max(far, int(np.bitwise_count(a ^ b).sum())), n_pairs + (changed != words)
    assert n_pairs > 200 and far <= decontaminate.RADIUS


def test_memo_holds_the_segments_of_a_task():
    memo, made = sentencepiece_codec._memo(None), []
    memo.fill = lambda keys: (made.append(len(keys)), [b"12345678"] * len(keys))[1]
    for _ in range(2):
        for start in range(0, 280_000, 10_000):
            memo.values([f"segment{k}" for k in range(start, start + 10_000)])
    assert sum(made) == 280_000
