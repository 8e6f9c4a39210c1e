"""Dictionary joins, phrase protection and the correctors, against plain Python."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from docspark.operators import correctors, dictionary, phrases, spelling
from tests import brute_speller

ENTRY = spelling.ENTRY


def noisy(rng, word, edits, alphabet="abcx"):
    w = list(word)
    for _ in range(edits):
        k = rng.randrange(len(w) + 1)
        kind = rng.randint(0, 3)
        if kind == 0 or not w:
            w.insert(k, rng.choice(alphabet))
        elif kind == 1:
            del w[min(k, len(w) - 1)]
        elif kind == 2:
            w[min(k, len(w) - 1)] = rng.choice(alphabet)
        elif len(w) > 1:
            k = min(k, len(w) - 2)
            w[k], w[k + 1] = w[k + 1], w[k]
    return "".join(w)


@pytest.fixture(scope="module")
def words():
    rng = random.Random(1)
    word = lambda most: "".join(rng.choice("abc") for _ in range(rng.randint(1, most)))
    terms = sorted({word(22) for _ in range(140)} | {"abcdef", "ab", "é" * 9, "aé𝒳bc" * 3})
    tokens = sorted({noisy(rng, rng.choice(terms), rng.randint(0, 3)) for _ in range(500)} | {word(24) for _ in range(60)} | {"abxdyf", "", "é" * 8})
    return terms, tokens


def frame(spark, values, name, **more):
    return spark.createDataFrame([(v, *(m[v] for m in more.values())) for v in values], f"{name} string" + "".join(f", {k} int" for k in more))


def lcs(a, b):
    rows = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, rows[j + 1] = rows[j + 1], last + 1 if x == y else max(rows[j], rows[j + 1])
    return rows[-1]


@pytest.mark.parametrize("cutoff", [67, 90, 92, 95, 100])
def test_fuzzy_terms_against_brute_force(spark, words, cutoff):
    terms, tokens = words
    best = {}
    for w in filter(None, tokens):
        ratio, _, t = min((-2 * lcs(w, t) / (len(w) + len(t)), t, t) for t in terms)
        if -200 * lcs(w, t) <= -cutoff * (len(w) + len(t)):
            best[w] = (t, -ratio)
    found = dictionary.fuzzy_terms(frame(spark, [*tokens, tokens[5], None], "token"), frame(spark, [*terms, "", None], "word"), cutoff).collect()
    assert {r["token"]: (r["word"], round(r["ratio"], 9)) for r in found} == {w: (t, round(x, 9)) for w, (t, x) in best.items()} and len(found) == len(best) > 20
    with pytest.raises(ValueError, match="cutoff"):
        dictionary.fuzzy_terms(frame(spark, [], "token"), frame(spark, [], "word"), 66)


@pytest.mark.parametrize("most", [1, 2])
def test_nearest_words_against_brute_force(spark, words, most):
    terms, tokens = words
    right = {w: min((brute_speller.edit_distance(w, t), t) for t in terms) for w in tokens if len(w) >= 3}
    found = dictionary.nearest_words(frame(spark, tokens, "token"), frame(spark, terms, "word"), most).collect()
    assert {r["token"]: (r["distance"], r["word"]) for r in found} == {w: x for w, x in right.items() if x[0] <= most}
    assert ("abxdyf" in {r["token"] for r in found}) == (most == 2)
    with pytest.raises(ValueError, match="most"):
        dictionary.nearest_words(frame(spark, [], "token"), frame(spark, [], "word"), 3)


def test_suggestions_against_brute_force(spark, words):
    terms, tokens = words
    counts = {t: len(t) % 4 + 1 for t in terms}
    by = brute_speller.Corrector({}, counts)
    right = {w: v for w in tokens if w and (v := by.suggestion(w))}
    found = dictionary.suggestions(frame(spark, tokens, "token"), frame(spark, terms, "word", count=counts)).collect()
    assert {r["token"]: r["word"] for r in found} == right
    assert any(len(w) > dictionary.SHORT + 2 for w in right) and any(len(w) < 5 for w in right)


def test_very_long_tokens_meet_by_pieces(spark):
    long = "".join(random.Random(3).choice("abcdefgh") for _ in range(5000))
    found = dictionary.suggestions(frame(spark, [long[:77] + "zz" + long[77:], long[:-1]], "token"), frame(spark, [long], "word", count={long: 1})).collect()
    assert len(found) == 2 and {r["word"] for r in found} == {long}


def test_halves(spark):
    found = dictionary.halves(frame(spark, ["ToolKits", "toolkit", "abcdefgh", "kitstool", None], "token"), frame(spark, ["tool", "kits", "abcdefgh", "too", "lkits"], "word")).collect()
    assert {tuple(r) for r in found} == {("ToolKits", "Too", "lKits"), ("kitstool", "kits", "tool")}


# --- phrases ---------------------------------------------------------------------------------------------


def brute_protected(text, listed):
    for phrase in sorted(listed, key=lambda p: (-len(p), p)):
        text = re.sub(rf"(?i)\b{re.escape(phrase)}\b", lambda m: m[0].replace(" ", "_"), text)
    return text


@pytest.mark.parametrize("most", [1 << 20, 8])
def test_phrases_in_one_pass_are_those_of_one_pass_each(spark, most):
    rng = random.Random(4)
    listed = ["a b", "a b c", "b c", "c d e f", "a a", "é b", "x-y z", "(q) r", "single", "of the", "in the end", "the end"]
    texts = [" ".join(rng.choice(["a", "b", "c", "d", "e", "f", "A", "B", "é", "x-y", "z", "(q)", "r", "of", "the", "in", "end", "ab", "\n", "İ"]) for _ in range(rng.randint(0, 40))) for _ in range(150)]
    texts += ["", "a a a a a", "a_b c", "of the end of the", "A B", "a b" * 2000]
    frame_ = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])], "doc_id int, text string")
    table = spark.createDataFrame([(p.upper() if k % 3 == 0 else f" {p} ",) for k, p in enumerate([*listed, "a b"])] + [(None,)], "phrase string")
    found = {r["doc_id"]: r["t"] for r in frame_.select("doc_id", phrases.protected(frame_["text"], table, most).alias("t")).collect()}
    assert found == {k: brute_protected(t, [p for p in listed if " " in p]) for k, t in enumerate(texts)} | {len(texts): None}


def test_no_phrases(spark):
    frame_ = spark.createDataFrame([("a b",), (None,)], "text string")
    assert [r[0] for r in frame_.select(phrases.protected(frame_["text"], spark.createDataFrame([], "phrase string"))).collect()] == ["a b", None]


# --- correctors ------------------------------------------------------------------------------------------

TERMS = [("heat", "HEAT"), ("alternator", "alternator"), ("maintenance check", "Maintenance Check"), ("airworthiness", "airworthiness"), ("certification", "certification"), ("ok", "OK"), ("in the", "IN THE")]
KNOWN = {"consider": 5, "considered": 9, "haters": 1, "tool": 3, "kit": 2, "house": 4, "mouse": 7, "form": 2, "kits": 1, "inspection": 3}
GUARDED, COMMON = ("ntsb",), frozenset({"alternation"})


@pytest.fixture(scope="module")
def tables(spark):
    entries = spark.createDataFrame([(None if t == s.lower() and " " in t else t, s, None, None, None, None) for t, s in TERMS], ENTRY)
    return entries, spark.createDataFrame(list(KNOWN.items()), "word string, count int")


@pytest.fixture(scope="module")
def speller():
    return brute_speller.Corrector({s.lower(): s for _, s in sorted(TERMS)}, KNOWN, frozenset(GUARDED), COMMON)


def made_up(n):
    rng = random.Random(6)
    base = [t for t, _ in TERMS if " " not in t] + list(KNOWN) + ["alternation", "ntsb", "a1", "f16b", "42", "NASA", "Heat", "toolkit", "toolhouse", "maintenance_check", "x-y", "a/b", "_", "é", "HéAT", "²", "ok", "ab"]
    out = set(base)
    while len(out) < n:
        w = noisy(rng, rng.choice(base), rng.randint(0, 3), "aeiotrsk")
        out.add(rng.choice([w, w, w.capitalize(), w.upper()]))
    return sorted(filter(None, out))


@pytest.mark.parametrize("variant", list(correctors.CUTOFF))
def test_tokens_are_judged_as_word_by_word(spark, tables, speller, variant):
    tokens = made_up(350)
    found = {r["token"]: (r["new"], r["changed"], r["method"]) for r in correctors.judge(frame(spark, [*tokens, tokens[3]], "token"), *tables, variant, GUARDED, COMMON).collect()}
    assert found == {t: getattr(speller, variant)(t) for t in tokens}
    assert {m for _, _, m in found.values()} <= set(correctors.LABELS[variant]) and len({m for _, _, m in found.values()}) > 4


@pytest.mark.parametrize("variant", list(correctors.CUTOFF))
@pytest.mark.parametrize("most", [1000, 0])
def test_texts_are_corrected_as_text_by_text(spark, tables, speller, variant, most):
    rng, tokens = random.Random(7), made_up(200)
    texts = ["".join(rng.choice(tokens) + rng.choice([" ", " ", ", ", "\n", "-", "! "]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    texts += ["", "heat,  considerd\n-x!", "Maintenance check, toolhouse! ab heat louse in the house", texts[0]]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None])] + [(3, "heat twice")], "doc_id int, text string")
    rows = correctors.correct(docs, *tables, variant, GUARDED, COMMON, most).collect()
    plain = lambda r: (r["corrected"], r["total_words"], [tuple(x) for x in r["corrections"] or ()])

    def right(text):
        if variant != "enhanced":
            text = re.sub(r"([A-Za-z0-9_]+)-\s*\n\s*([A-Za-z0-9_]+)", r"\1\2", unicodedata.normalize("NFKC", text))
        made = speller.text(text, variant, {})
        return made["text"], made["total_words"], [tuple(x.values()) for x in made["corrections"]]

    expected = [(k, *right(t)) for k, t in enumerate(texts)] + [(len(texts), None, None, []), (3, *right("heat twice"))]
    assert sorted(((r["doc_id"], *plain(r)) for r in rows), key=repr) == sorted(expected, key=repr)
    with pytest.raises(ValueError, match="unknown corrector"):
        correctors.correct(docs, *tables, "other")


@pytest.mark.parametrize("most", [1000, 0])
def test_conservative_corrections_keep_every_row(spark, most):
    entries = spark.createDataFrame([("pax", "PAX", None, "passengers", ["passengerz"], ["paxx", "pax", "the", "PAXX "]), ("bad", "NaN", None, None, None, ["good"]), ("gear", None, None, None, None, ["geer"]), (" ", "x", None, None, None, ["y y"])], ENTRY)
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "The paxx, passengers: Pax PAX geer a é_x passengerz good"), (3, "paxx"), (None, "geer"), (None, "x")], "doc_id int, text string")
    found = correctors.correct_conservative(docs, entries, frozenset({"the"}), most).collect()
    assert sorted(((r["doc_id"], r["corrected"], r["total_words"]) for r in found), key=repr) == sorted([(1, None, None), (2, "", 0), (3, "The PAX, PAX: PAX PAX gear a é_x PAX good", 10), (3, "PAX", 1), (None, "gear", 1), (None, "x", 1)], key=repr)
    assert {x["method"] for r in found for x in r["corrections"] or ()} == {"exact_misspelling_correction", "case_standardization"}
    assert {r["corrected"] for r in correctors.correct_conservative(docs.limit(0), entries).collect()} == set()


def test_a_token_of_200_000_characters_costs_nothing(spark):
    long = "ab" * 100_000
    tokens, known = frame(spark, [long, "heatt", "toolhouse"], "token"), frame(spark, ["heat", "tool", "house"], "word", count={"heat": 1, "tool": 2, "house": 1})
    assert [tuple(r)[:2] for r in dictionary.fuzzy_terms(tokens, known, 80).collect()] == [("heatt", "heat")]
    assert [tuple(r) for r in dictionary.nearest_words(tokens, known, 2).collect()] == [("heatt", "heat", 1)]
    assert [tuple(r) for r in dictionary.suggestions(tokens, known).collect()] == [("heatt", "heat")]
    assert [tuple(r) for r in dictionary.halves(tokens, known).collect()] == [("toolhouse", "tool", "house")]


@pytest.mark.parametrize("edits", [1, 2])
def test_patterns_meet_just_where_few_edits_lead(edits):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(90)})
    for a in words:
        own = dictionary.holes(a, edits)
        for b in words:
            assert (not own.isdisjoint(dictionary.around(b, edits))) == (dictionary.swap_distance(a, b) <= edits), (a, b)


def test_suggestions_of_a_crowd_stay_in_proportion(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ab") for _ in range(10))
    known = {w: rng.randint(1, 5) for w in {word() for _ in range(500)}} | {"x" * 26: 3, "q￿r": 9}
    tokens = sorted({word()[: rng.randint(8, 10)] for _ in range(300)} | {"x" * 25, "qr", "q￿"})
    right = {}
    for t in set(tokens) - set(known):
        near = [(d, -n, w) for w, n in known.items() if 1 <= (d := dictionary.swap_distance(t, w)) <= 2]
        right |= {t: min(near)[2]} if near else {}
    seen = Observation()
    pairs = dictionary._first_near(spark.createDataFrame(list(enumerate(tokens)), "id long, token string"), spark.createDataFrame(list(enumerate(sorted(known))), "rank long, word string"), 2)
    pairs.observe(seen, F.count("*").alias("n")).collect()
    assert seen.get["n"] <= len(tokens)
    plan = dictionary.suggestions(frame(spark, tokens, "token"), frame(spark, known, "word", count=known))
    assert {r["token"]: r["word"] for r in plan.collect()} == right


def test_sieve_keeps_unaltered_tokens_from_the_shuffle(spark):
    altered = [f"é{k}x" for k in range(200)]
    texts = spark.createDataFrame([(1, " ".join([*altered[:50], *(f"n{k}" for k in range(5000))])), (2, None)], "doc_id int, text string")
    sieve = correctors.sieved(frame(spark, altered, "token"), len(altered))
    kept = {r["doc_id"]: r["ts"] for r in texts.select("doc_id", correctors._tokens(F.col("text"), "enhanced", sieve).alias("ts")).collect()}
    assert set(altered[:50]) <= set(kept[1]) and len(kept[1]) < 500 and kept[2] == []
    judged = frame(spark, altered, "token").select("token", F.upper("token").alias("new"), F.lit(True).alias("changed"), F.lit("m").alias("method"), F.array(F.upper("token")).alias("parts"))
    take = lambda most: sorted(map(str, correctors.replaced(texts, judged, "enhanced", most).collect()))
    assert take(0) == take(1000)


def test_contextual_query_is_its_sql_on_odd_texts(spark, tmp_path):
    import duckdb

    from docspark import registry

    texts = [None, "", "\n", "that", "café-\nbar that", "caf-\n bar", "foo-\xa0\nbar", "a-\x0b\nb", "aé-\nbé", "ﬁre that…", "“that” ‘the one’", "ｔｈａｔ", "é x–y that—was", "a-\n-b", "Haet² was"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("spelling_contextual", "spelling_statistics"):
        run, sql = registry.load()[name]
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        made = con.execute(sql)
        rows = run(spark, str(tmp_path)).select(*[x[0] for x in made.description]).collect()
        assert sorted(map(tuple, rows)) == sorted(made.fetchall()), name


def test_altered_tokens_are_shared_in_few_bytes(spark):
    table = spark.range(40_000).select(F.concat(F.lit("Tokén"), "id").alias("token"), F.concat(F.lit("new"), "id").alias("new"), F.lit(True).alias("changed"), F.lit("spellcheck").alias("method"), F.array(F.concat(F.lit("new"), "id")).alias("parts"))
    held = correctors.shared(table).value
    assert isinstance(held, bytes) and len(held) < 40_000 * 80
    import pyarrow as pa

    found = correctors.found_in(pa.ipc.open_stream(held).read_all(), {"Tokén7", "Tokén39999", "Tokén40000", ""})
    assert {t: (r["new"], r["changed"], r["method"], r["parts"]) for t, r in found.items() if t.startswith("Tokén")} == {f"Tokén{k}": (f"new{k}", True, "spellcheck", [f"new{k}"]) for k in (7, 39999)}
    none = pa.ipc.open_stream(correctors.shared(table.limit(0)).value).read_all()
    assert correctors.found_in(none, {"a"}) == {} == correctors.found_in(none, set())


def test_codes_that_tokens_share_lose_none(spark):
    import zlib

    same = ["plumless", "buckeroo"]
    assert zlib.crc32(b"plumless") == zlib.crc32(b"buckeroo")
    judged = frame(spark, same, "token").select("token", F.upper("token").alias("new"), F.lit(True).alias("changed"), F.lit("m").alias("method"), F.array(F.upper("token")).alias("parts"))
    texts = spark.createDataFrame([(1, "a buckeroo, plumless"), (2, "plumless b"), (3, None)], "doc_id int, text string")
    assert sorted((r["doc_id"], r["corrected"]) for r in correctors.replaced(texts, judged, "enhanced").collect()) == [(1, "a BUCKEROO, PLUMLESS"), (2, "PLUMLESS b"), (3, None)]


def test_shared_tokens_of_many_tasks_are_one_piece(spark):
    import pyarrow as pa

    table = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("t"), "id").alias("token"), F.lit("n").alias("new"), F.lit(True).alias("changed"), F.concat(F.lit("m"), (F.col("id") / 500).cast("int")).alias("method"), F.array(F.lit("n")).alias("parts"))
    held = pa.ipc.open_stream(correctors.shared(table).value).read_all()
    assert held["code"].num_chunks == 1
    assert {t: r["method"] for t, r in correctors.found_in(held, {f"t{k}" for k in range(4000)}).items()} == {f"t{k}": f"m{k // 500}" for k in range(4000)}
