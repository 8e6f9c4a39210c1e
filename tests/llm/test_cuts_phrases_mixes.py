"""Fill-in-middle, collocations and mixing: against brute force, with nulls, empty and long texts, ties, repeats, empty tables, clashing columns."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docspark.llm import collocations, fill_in_middle, mixing

DOCS = "doc_id bigint, text string, lang string, source string, n bigint, size string, digest string, phrase string, target int"


def table(spark, rows):
    """(doc_id, text, lang, source) with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, "mine", "d", "p", 5) for r in rows], DOCS)


# --- fill in the middle ----------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(30))
def test_elias_fano_holds_any_list_that_does_not_fall(seed):
    rng = np.random.default_rng(seed)
    values = np.sort(rng.integers(0, [1, 7, 300, 10**6, 2**40][seed % 5], rng.integers(1, 400)))
    packed = fill_in_middle.elias_fano(values)
    assert [fill_in_middle.select(packed, k) for k in range(len(values))] == values.tolist()
    with pytest.raises(IndexError):
        fill_in_middle.select(packed, len(values))


def test_a_list_takes_two_bits_and_the_width_of_a_line():
    ends = np.arange(0, 64 * 10_001, 64)
    assert len(fill_in_middle.elias_fano(ends)) < 10_001 * 8.1 / 8 + 8


def brute_cut(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    i, j = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return (doc_id, len(lines), "plain", None, None, text)
    p, m, s = ("".join(x) for x in (lines[:i], lines[i:j], lines[j:]))
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, len(lines), "spm" if h4 % 100 < spm else "psm", len(p), len(m), out)


TEXTS = [None, "", "\n", "\n\n\n", "one", "one\n", "a\nb\nc", "é中𝒳\nx\r\n\x0b y\n", "has <P> in\nit", "<S", "P>\n<", "x<M>", "line\n" * 40_000, "z" * 200_000, " \n \n", "a<\nS>\n"]


def test_cuts_match_brute_force(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate(TEXTS * 12)] + [(None, "a\nb\nc", "en", "s"), (None, None, None, None), (3, "\n", "en", "s"), (3, "\n", "en", "s"), (3, "other\nline", "en", "s")]
    found = fill_in_middle.fill_in_middle(table(spark, rows))
    assert found.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((brute_cut(r[0], r[1]) for r in rows), key=repr)
    again = found.select("doc_id", fill_in_middle.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(((r["doc_id"], r["t"]) for r in again), key=repr) == sorted(((r[0], r[1] or "") for r in rows), key=repr)
    assert {r["form"] for r in found.select("form").distinct().collect()} == {"plain", "psm", "spm"}


def test_parameters_string_ids_and_empty_tables(spark):
    rows = [(str(k), "a\nb\n" * (k % 5 + 1)) for k in range(60)]
    docs = spark.createDataFrame(rows, "name string, body string")
    found = fill_in_middle.fill_in_middle(docs, "name", "body", seed=3, rate=60, spm=0)
    assert sorted(map(tuple, found.collect())) == sorted(brute_cut(k, t, 3, 60, 0) for k, t in rows)
    assert fill_in_middle.fill_in_middle(docs.limit(0), "name", "body").collect() == []


def test_documents_of_a_frequent_text_are_dealt_and_it_is_indexed_once_a_part(spark):
    rows = [(k, "same\ntext\n", "en", "s") for k in range(500)] + [(k, f"own {k}\n", "en", "s") for k in range(500, 600)]
    docs = table(spark, rows)
    assert sorted(map(tuple, fill_in_middle.fill_in_middle(docs, part=50).collect())) == sorted(brute_cut(r[0], r[1]) for r in rows)
    dealt = fill_in_middle._dealt(docs, "doc_id", "text", fill_in_middle._digest, 50)
    assert dealt.where("text = 'same\ntext\n'").groupBy("part").count().agg(F.max("count")).first()[0] < 100
    assert fill_in_middle.text_index(dealt).where("text = 'same\ntext\n'").count() == 10
    whole = fill_in_middle.text_index(fill_in_middle._dealt(docs, "doc_id", "text", fill_in_middle._digest, 1000))
    assert whole.count() == 101


def test_texts_that_share_a_digest_are_told_apart_by_content(spark):
    docs = table(spark, [(1, "one", "en", "s"), (2, "two", "en", "s")])
    with pytest.raises((PySparkException, Py4JJavaError), match="share a digest"):  # the latter if two stages fail at once
        fill_in_middle.fill_in_middle(docs, digest=lambda t: F.length(t)).collect()


def test_texts_are_dealt_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = fill_in_middle.fill_in_middle(table(spark, [(1, "a\n", "en", "s")]))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "partial_collect_set" in plan
    with_texts = [x for x in plan.split("\n") if "Sort [digest" in x]
    joins = plan.split("SortMergeJoin")
    assert len(joins) == 3 and with_texts  # cuts and texts meet where the texts were gathered
    below = plan[plan.rindex("collect_set(text") :]
    assert "Exchange" in below


# --- collocations ----------------------------------------------------------------------------------------


def pieces_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute_phrases(rows, least=30, top=2000, depth=4, cover=80):
    """rows: (lang, text). Straight from the definition, with every longer candidate tried."""
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for ws in pieces_of(text):
            n[lang] += len(ws)
            f.update((lang, tuple(ws[i : i + k])) for k in range(1, depth + 1) for i in range(len(ws) - k + 1))
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    out = collections.defaultdict(list)
    for (lang, p), a in candidates.items():
        if any(g == lang and len(q) > len(p) and 100 * b >= cover * a and inside(p, q) for (g, q), b in candidates.items()):
            continue
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, r, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for r, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1))


def prose(n, seed, words="the cat sat on a mat and ran off to sea"):
    rng, words = random.Random(seed), words.split()
    return [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_states_are_the_sets_of_end_positions(seed):
    rng = random.Random(seed)
    symbols, begins = [], []
    for _ in range(rng.randint(0, 12)):
        piece = [rng.randint(1, 3) for _ in range(rng.randint(1, 9))]
        symbols += piece
        begins += [True] + [False] * (len(piece) - 1)
    ends = collections.defaultdict(set)
    for k in range(len(symbols)):
        for n in range(1, 5):
            if k - n + 1 >= 0 and not any(begins[k - n + 2 : k + 1]):
                ends[tuple(symbols[k - n + 1 : k + 1])].add(k)
    states = collections.defaultdict(list)
    for phrase, at in ends.items():
        states[frozenset(at)].append(phrase)
    found = collocations.automaton(np.array(symbols, dtype=np.int64), np.array(begins, dtype=bool))
    got = sorted((tuple(row[:n][::-1]), int(short), int(count)) for row, n, short, count in zip(found.longest.tolist(), found.length, found.shortest, found.ends, strict=True))
    assert got == sorted((max(ps, key=len), min(map(len, ps)), len(at)) for at, ps in states.items())
    for phrase, short, _ in got:  # the suffix link leads to the longest phrase of another state
        assert short == 1 or phrase[len(phrase) - short + 1 :] in {g[0] for g in got}
    for n in range(1, 5):
        rows, counts = found.phrases(n)
        assert {tuple(r): c for r, c in zip(rows.tolist(), counts.tolist(), strict=True)} == {p: len(at) for p, at in ends.items() if len(p) == n}


HARD = [None, "", "  ", "...", "A a\tA a. a a", "É é É", "x\x0by\x0cz\r\nw", "no" * 9000, "ÀB c d", "a.b,c;d:e!f?g", "\t lead and trail \t", "中 文 中 文"]


@pytest.mark.parametrize(("most", "size"), [(1 << 20, 1 << 20), (7, 5), (1, 1), (50, 16)])
def test_shards_and_slices_cut_nothing(most, size):
    texts = HARD + prose(20, 1)
    langs = [["en", None, "fr"][k % 3] for k in range(len(texts))]
    batches = [pa.RecordBatch.from_arrays([pa.array(langs[a:b], pa.string()), pa.array(texts[a:b], pa.string())], ["lang", "text"]) for a, b in ((0, 5), (5, 5), (5, 6), (6, len(texts)))]
    found = [x for s in collocations.shards(iter(batches), most, size) for x in _listed(s)]
    right = [(lang or "und", ws) for lang, t in zip(langs, texts, strict=True) for ws in pieces_of(t) if ws]
    assert [x[:2] for x in found] == [(lang, w) for lang, ws in right for w in ws]
    assert [x[2] for x in found] == [k == 0 for _, ws in right for k in range(len(ws))]


def _listed(shard):
    names, langs = (x.cast(pa.string()).to_pylist() for x in (shard.names, shard.langs))
    return [(langs[k], names[k], first) for k, first in list(zip(shard.symbols - 1, shard.begins.tolist(), strict=True))[shard.known :]]


def phrases(spark, rows, **kinds):
    docs = spark.createDataFrame([(lang, t, 1) for lang, t in rows], "lang string, text string, n int").repartition(3)
    return sorted(map(tuple, collocations.collocations(docs, **kinds).collect()))


def test_phrases_match_brute_force(spark):
    rows = [(["en", "fr", None, "und"][k % 4], t) for k, t in enumerate(HARD * 2 + prose(260, 2) + ["in the end of it all. in the end of it"] * 40 + prose(100, 3, "tick tock tick"))]
    found = phrases(spark, rows)
    assert found == brute_phrases(rows) and len(found) > 20
    assert phrases(spark, rows, least=3, top=25, cover=60) == brute_phrases(rows, 3, 25, cover=60)
    assert phrases(spark, rows, depth=2) == brute_phrases(rows, depth=2)


def test_a_full_filter_changes_no_count(spark, monkeypatch):
    rows = [("en", t) for t in prose(200, 4)]
    monkeypatch.setattr(collocations, "key_filter", lambda keys: keys.sparkSession.sparkContext.broadcast(np.full(8, 255, dtype=np.uint8)))
    assert phrases(spark, rows, least=5) == brute_phrases(rows, 5)


def test_shards_of_any_size_give_the_same_phrases(spark, monkeypatch):
    rows = [("en", t) for t in prose(60, 5)]
    whole = phrases(spark, rows, least=4)
    assert whole == brute_phrases(rows, 4)
    docs = spark.createDataFrame(rows, "lang string, text string")
    for name, value in (("SHARD", 9), ("SLICE", 12)):
        monkeypatch.setattr(collocations, name, value)
    assert sorted(map(tuple, collocations.collocations(docs, least=4).collect())) == whole


def test_no_phrases(spark):
    assert phrases(spark, []) == [] and phrases(spark, [("en", "a b c"), (None, None)]) == []
    with pytest.raises(ValueError, match="depth"):
        phrases(spark, [], depth=1)


def test_scores_are_exact_beyond_64_bits(spark):
    a, left, right = 9 * 10**17 + 7, 9 * 10**17 + 11, 9 * 10**17 + 13
    phrases_ = spark.createDataFrame([("en", "x y", 2, a)], "lang string, phrase string, words int, f long")
    counts = spark.createDataFrame([("en", "x", left), ("en", "y", right)], "lang string, phrase string, f long")
    row = collocations.scored(phrases_, counts).first()
    assert (row["l"], row["r"], row["score"]) == (left, right, 2_000_000 * a // (left + right))


# --- mixing ----------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, "" if s is None else s.encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, rest = {}, set(names), sum(sizes.values())
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] >= most * sizes[s]}
        if not over:
            return target | share
        target |= {s: float(most * sizes[s]) for s in over}
        rest -= sum(most * sizes[s] for s in over)
        free -= over
    return target


def mixed_rows(n, seed=0):
    rng = random.Random(seed)
    sources = [None, "", "a", "b", "ä", "𝒳", "￮", "tiny", "hot"] + ["hot"] * 4
    return [(k, rng.choice([None, "", " \t\n", "one", "two words", "\x1cnot a space ", "w " * rng.randint(1, 30)]), "en", rng.choice(sources)) for k in range(n)] + [(None, "null id", "en", "a"), (1, "twice", "en", "b"), (1, "twice", "en", "b")]


@pytest.mark.parametrize("broadcast", [1 << 16, 0])
def test_targets_and_copies(spark, broadcast):
    rows = mixed_rows(2500)
    docs = table(spark, rows)
    found = mixing.mixture(docs, broadcast=broadcast)
    assert set(found.columns) == {*docs.columns, "source_size", "copies"} and found.columns.count("size") == 1
    got = found.collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += words(r[1])
    target = brute_targets(sizes)
    assert sorted(((r["doc_id"], r["text"], r["source"]) for r in got), key=repr) == sorted(((r[0], r[1], r[3]) for r in rows), key=repr)
    taken = collections.Counter()
    for r in got:
        assert (r["size"], r["source_size"], r["target"]) == (words(r["text"]), sizes[r["source"]], pytest.approx(target[r["source"]]))
        rate = r["target"] / r["source_size"]
        assert int(rate) <= r["copies"] <= min(3, int(rate) + 1)
        taken[r["source"]] += r["size"] * r["copies"]
    for s in sizes:
        assert taken[s] == pytest.approx(target[s], rel=0.15)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    assert sorted(map(repr, mixing.mixture(docs.repartition(7), broadcast=broadcast).collect())) == sorted(map(repr, got))
    copies = mixing.emitted(found)
    assert copies.count() == sum(r["copies"] for r in got) and copies.groupBy("doc_id", "text").agg(F.max("copy").alias("m")).where("m > 3").count() == 0


def test_targets_of_many_rounds_and_weights(spark):
    for sizes, weights in itertools.product(({f"s{k:02d}": 3**k for k in range(20)}, {"a": 0, "b": 10}, {"a": 0}, {None: 5}, {"x": 1, "y": 10**12, None: 7}), ((1, 2, 3), (5,), (1, 100))):
        docs = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        found = {r["source"]: r["target"] for r in mixing.source_targets(docs, weights).collect()}
        assert found == pytest.approx(brute_targets(sizes, weights), rel=1e-12)


def test_mixing_of_nothing(spark):
    docs = table(spark, [])
    assert mixing.mixture(docs).collect() == [] and mixing.emitted(mixing.mixture(docs)).collect() == []
    empty = mixing.mixture(table(spark, [(1, None, "en", None), (2, " ", "en", "s")])).collect()
    assert [(r["size"], r["target"], r["copies"]) for r in empty] == [(0, 0.0, 0)] * 2


def test_mixing_uses_no_python(spark):
    plan = mixing.mixture(table(spark, mixed_rows(5)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# --- ids of any type, bounded samples, hubs and crowded bands ---------------------------------------------


def test_ids_that_are_texts(spark):
    import corpus_pipeline
    from docspark.llm import decontaminate

    passage = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([("b", f"before {passage} after"), ("a", "nothing of it here"), (None, passage), ("c", "nothing of it here")], "doc_id string, text string")
    items = spark.createDataFrame([("item-1", passage), (None, passage + " more")], "item_id string, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, items).collect()}
    assert {("b", "item-1"), (None, "item-1")} <= found
    assert sorted(r["doc_id"] for r in decontaminate.without(docs, items).collect()) == ["a", "c"]
    assert decontaminate.contaminated(docs, items.limit(0)).schema["item_id"].dataType.simpleString() == "string"
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == ["a", "b"]  # of near copies the null id goes


def test_the_quality_sample_is_bounded_in_bytes(spark):
    from docspark.llm import quality

    docs = spark.createDataFrame([(k, "x" * (10_000 if k % 7 == 0 else 100)) for k in range(100)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id bigint, quality int")
    rows = quality.training_rows(docs, labels, max_bytes=9_000).collect()
    assert 0 < sum(len(r["text"]) for r in rows) <= 9_000 and {len(r["text"]) for r in rows} == {100} and len(rows) > 50


def test_a_star_of_many_links(spark):
    from docspark.llm import components

    links = spark.range(1, 20_001).selectExpr("0 AS a", "id AS b").union(spark.range(20_000, 20_050).selectExpr("id AS a", "id + 1 AS b"))
    found = components.connected_components(links)
    assert found.where("root <> 0").count() == 0 and found.count() == 20_051


def test_languages_of_one_id_are_sampled_row_by_row(spark):
    from docspark.llm import language

    rows = [(1, f"the cat sat on the mat number {k}", "en") for k in range(3000)] + [(k, f"der hund lief durch den garten {k}", "de") for k in range(2, 40)] + [(50, "123", "xx")]
    model = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert sorted(model.names) == ["de", "en"] and model.predict("the cat sat on the mat")[0] == "en" and model.predict("der hund lief")[0] == "de"


def test_a_band_of_thousands_of_different_texts(spark):
    """Texts that share one frame, but not enough of it, stay; those that share nearly all of it are linked."""
    from docspark.llm import simhash

    frame = " ".join(f"frame{k}" for k in range(40))
    docs = spark.range(3000).selectExpr(f"'{frame}' || ' own' || id || ' tail' || id AS text")
    links = simhash.similar_links(docs)
    assert links.selectExpr("count(distinct a) + count(distinct b)").first()[0] > 0
