"""Operators of problems 1, 2, 8, 9 and 10 against brute force and on awkward input."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomline.llm.keys import words
from loomline.llm import grading, leak, mixing, pairs, queries, tokens
from loomline.llm.lang import detect_language
from loomline.session import table
from tests.conftest import rows

LONG = "word " * 60_000


# ---- problem 1 ----

QA = "record_id bigint, question string, answer string, lang string, source string, category string, tokens string, kept_0 string"
QA_ROWS = [
    (1, "What is a tree?", "A graph.", "EN ", "s", "c", "t", "k"),
    (2, None, "", None, None, None, None, None),
    (3, "Wie geht das mit der Spalte?", None, None, "s", "c", "t", "k"),
    (4, LONG, "<|endoftext|>", "fr", "s", None, "t", "k"),
    (4, LONG, "<|endoftext|>", "fr", "s", None, "t", "k"),
]


def counted(spark, data):
    return tokens.token_counts(spark.createDataFrame(data, QA), "record_id", ["question", "answer"], "lang", ["source", "category"])


def test_token_counts_and_cube(spark):
    encode = tokens.load_tokenizer(tokens.TOKENIZER)
    got = {r["record_id"]: r for r in counted(spark, QA_ROWS).collect()}
    assert got[1]["question_tokens"] == len(encode(["What is a tree?"])[0]) and got[1]["lang"] == "en"
    assert (got[2]["question_tokens"], got[2]["answer_tokens"], got[2]["lang"]) == (0, 0, None)
    assert got[3]["lang"] == "de" and got[4]["answer_tokens"] > 1
    cube = {(r["source"], r["lang"], r["category"]): r for r in tokens.token_budget(counted(spark, QA_ROWS)).collect()}
    assert cube[("*", "*", "*")]["records"] == 5
    assert cube[("s", "fr", "(none)")]["tokens"] == 2 * (got[4]["question_tokens"] + got[4]["answer_tokens"])
    assert cube[("(none)", "(none)", "(none)")]["tokens"] == 0
    assert counted(spark, []).count() == tokens.token_budget(counted(spark, [])).filter("source <> '*'").count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_tokenizers_round_trip(name):
    path = "/opt/tokenizers/" + name
    texts = ["Größe: 12 <|endoftext|>", "été\n\ttab"]
    ids = tokens.load_tokenizer(path)(texts)
    assert tokens.count_tokens([*texts, None, ""], path) == [len(i) for i in ids] + [0, 0]


def test_same_vocabulary_same_counts(spark, data):
    texts = [r[0] for r in table(spark, data, "documents").select("text").limit(50).collect() if r[0]]
    assert tokens.count_tokens(texts, "/opt/tokenizers/byte_bpe_50k.tiktoken") == tokens.count_tokens(texts, "/opt/tokenizers/byte_bpe_50k.json")


@pytest.mark.parametrize("text, lang", [("How can I sort the rows before the week ends?", "en"), ("Comment trier les lignes avant la fin de la semaine ?", "fr"), ("Wie kann ich die Zeilen vor dem Ende der Woche sortieren?", "de"), ("Cómo puedo ordenar las filas antes del fin de la semana", "es"), ("", None), ("1234 5678", None)])
def test_language_of_a_text(text, lang):
    assert detect_language(words(text)) == lang


# ---- problem 2 ----

Q = "How can the wrapper batrosik sort the values without leaking labels, and what comes first?"
GOOD = "Check the types, then the shapes, then the order of the rows. Try it on a small sample first."
DEFECTS = [
    (Q, None, "empty"), (Q, " ​\n", "empty"), (Q, "<p></p>", "empty"), (Q, "[no answer]", "empty"), (Q, "N/A", "empty"), (Q, "```\n```", "empty"),
    (Q, Q.upper(), "copy"), (Q, f"You asked: {Q}", "copy"), (Q, f"{Q}\n{Q}", "copy"), (Q, Q.replace("wrapper ", ""), "copy"), (Q, Q + "\nA:", "copy"),
    (Q, Q + " " + GOOD + " " + GOOD, None),
    (Q, "I'm sorry, but I can't help with that request. My guidelines do not allow it.", "refusal"), (Q, "Hmm, I am not able to answer this question.", "refusal"), (Q, "Ich kann diese Frage nicht beantworten.", "refusal"), (Q, "No me es posible ayudar con esto.", "refusal"), (Q, "Je dois décliner cette demande.", "refusal"),
    (Q, "I cannot stress enough that the order of these two steps matters. " + GOOD, None),
    (Q, "Sorry for the long detour, but filling the gaps only makes sense once the labels are fixed. " + GOOD, None),
    (Q, "Prüfen Sie die Typen, dann die Formen und dann die Reihenfolge. Mehr braucht man in der Regel nicht.", "wrong_language"),
    (Q + " Please answer in German.", "Prüfen Sie die Typen, dann die Formen und dann die Reihenfolge. Mehr braucht man in der Regel nicht.", None),
    (Q, GOOD, None), (Q, GOOD[:-1], None), (Q, GOOD + "\n- sort batrosik\n- merge tropasin", None), (Q, GOOD + "\n```python\nx = 1\n```", None),
    (Q, GOOD + "\n```python\nx = 1", "truncated"), (Q, GOOD + " The steps are:\n1. sort\n2.", "truncated"), (Q, GOOD[:-30] + " (see also", "truncated"), (Q, GOOD[:-40], "truncated"), (Q, GOOD + " In short, it is the", "truncated"), (Q, GOOD[:70] + " […]", "truncated"), (Q, GOOD[:-1] + ", for example,", "truncated"),
    (None, None, None), ("?!", "", None), ("", "TBD", None),
    (LONG + Q, LONG + GOOD, None),
]


def broken(spark, data):
    df = spark.createDataFrame([(i, q, a, "x", "y", 1) for i, (q, a, *_) in enumerate(data)], "record_id bigint, question string, answer string, defect string, closing string, length int")
    return dict(rows(pairs.broken_pairs(df), "record_id", "defect"))


def test_defects(spark):
    # closings that others end properly
    filler = [(Q, f"Set the limit to {i} and watch the loss. Try it on a small sample first.", None) for i in range(5)]
    data = DEFECTS + filler + DEFECTS[:3]
    got = broken(spark, data)
    wrong = {i: (a, d, got.get(i)) for i, (_, a, d) in enumerate(data) if got.get(i) != d}
    assert not wrong


def test_defects_of_nothing(spark):
    assert broken(spark, [(Q, GOOD, None)]) == {}
    df = spark.createDataFrame([], "record_id bigint, question string, answer string, source string")
    assert rows(pairs.broken_pairs(df)) == [] == rows(pairs.defect_report(pairs.broken_pairs(df), df))


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_comparison_matches_brute_force(spark, adaptive):
    rng = random.Random(7)
    texts = list({" ".join(rng.choices(["sort", "the", "rows", "row"], k=rng.randint(1, 5))) + rng.choice(["", "."]) for _ in range(300)})
    # a third of all responses begin alike
    texts += ["sort the rows and the " + "".join(rng.choices("abcde", k=rng.randint(1, 6))) + rng.choice(["", "."]) for _ in range(150)]
    ended = {t.rstrip(".") for t in texts if t.endswith(".")}
    every = {t.rstrip(".") for t in texts}
    expected = {s: any(o != s and o.startswith(s) for o in every) for s in every - ended}
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        got = {bytes(r["closing"]): r["shortened"] for r in pairs.compared_closings(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "answer string")).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert got == {pairs._digest(s): short for s, short in expected.items()}


def test_whole_texts_decide(spark):
    # no length hides a refusal, a placeholder or a shortened closing
    long_sentence = "we sort " + "very " * 2000 + "large tables"
    data = [
        (Q, " " * 3000 + "I cannot help with that request.", "refusal"),
        (Q, "<p>" * 400 + "N/A" + "</p>" * 400, "empty"),
        (Q, "Yes. " + long_sentence, "truncated"),
        (Q, "No. " + long_sentence + " by key.", None),
    ]
    assert broken(spark, data) == {i: d for i, (*_, d) in enumerate(data) if d}


def test_length_limits_are_spikes(spark):
    data = [(n, False) for n in range(985, 1045)] + [(1001, False)] * 30
    df = spark.createDataFrame([(n, e, None) for n, e in data], "length int, ended boolean, defect string")
    assert rows(pairs.length_limits(df)) == [(1001,)]


def test_defect_counts_on_the_test_table(spark):
    got = Counter(r["defect"] for r in queries.p2_found(spark, "/root/testdata/sf0.01").collect())
    assert set(got) == {"empty", "truncated", "refusal", "copy", "wrong_language"} and min(got.values()) > 20


# ---- problem 8 ----


def brute_leaks(documents, items):
    grams = lambda t: {tuple(words(t)[i : i + 4]) for i in range(len(words(t)) - 3)}
    held = {i: grams(t) for i, t in items}
    found = []
    for d, t in documents:
        own = grams(t)
        found += [(d, i) for i, g in held.items() if g and 2 * len(g & own) >= len(g)]
    return sorted(found, key=repr)


def leaks(spark, documents, items, **how):
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in documents], "doc_id bigint, text string, item_id int, source string")
    return leak.leaked_items(d, spark.createDataFrame([(i, t, 2) for i, t in items], "item_id bigint, text string, doc_id int"), **how)


def test_leaks_match_brute_force(spark, data):
    documents = [tuple(r) for r in table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, data, "test_items").select("item_id", "text").collect()]
    expected = brute_leaks(documents, items)
    assert expected and rows(leaks(spark, documents, items), "doc_id", "item_id") == expected
    assert rows(leaks(spark, documents, items, item_block=100), "doc_id", "item_id") == expected


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=14), min_size=1, max_size=5), st.lists(st.lists(st.sampled_from("abcd"), max_size=16), min_size=1, max_size=5))
def test_suffix_search_matches_brute_force(items, documents):
    test = leak.TestSuffixes([(i, " ".join(t)) for i, t in enumerate(items)])
    codes = [c for d in documents for c in [*(test.codes.get(w, 0) for w in d), 0]]
    doc = np.repeat(np.arange(len(documents)), [len(d) + 1 for d in documents])
    place = np.concatenate([np.arange(len(d) + 1) for d in documents])
    array = leak.ShardArray(test, np.array(codes, np.int64), doc, place)
    found, item = array.holders() if array.n else ((), ())
    got = sorted(((int(d), int(test.ids[i])) for d, i in zip(found, item)), key=repr)
    assert got == brute_leaks([(i, " ".join(d)) for i, d in enumerate(documents)], [(i, " ".join(t)) for i, t in enumerate(items)])
    if not got:
        return
    longest, where = array.longest(found, item)
    for d, i, n, p in zip(found.tolist(), test.ids[item].tolist(), longest.tolist(), where.tolist()):
        text = " " + " ".join(documents[d]) + " "
        runs = [k for a in range(len(items[i])) for k in range(1, len(items[i]) - a + 1) if f" {' '.join(items[i][a : a + k])} " in text]
        assert n == max(runs)
        assert f" {' '.join(documents[d][p : p + n])} " in f" {' '.join(items[i])} "


def test_longest_match_has_no_bound(spark, monkeypatch):
    rng = random.Random(3)
    item = " ".join(str(rng.randrange(500)) for _ in range(5000))
    documents = [(1, "x y " + item + " z"), (2, "a " + item[:-7000] + " b " + item[-7000:])]
    got = rows(leaks(spark, documents, [(1, item)]))
    assert got[0] == (1, 1, 5000, 2) and got[1][:2] == (2, 1) and 2500 < got[1][2] < 5000


def test_small_shards_and_chunks_find_the_same(data, monkeypatch):
    import pandas as pd
    import pyarrow as pa

    documents = pd.read_parquet(f"{data}/documents.parquet", columns=["doc_id", "text"])
    items = pd.read_parquet(f"{data}/test_items.parquet", columns=["item_id", "text"])

    class Shared:
        value = list(items.itertuples(index=False, name=None))

    def found():
        batches = leak._matched(Shared)(iter(pa.Table.from_pandas(documents, preserve_index=False).to_batches(max_chunksize=30)))
        return sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))

    whole = found()
    monkeypatch.setattr(leak, "SHARD_WORDS", 500)
    monkeypatch.setattr(leak.chunks, "__defaults__", (3,))
    assert whole and found() == whole


def test_leaks_on_awkward_rows(spark):
    item = "one two three four five six"
    documents = [(1, None), (2, ""), (3, "ONE two, three: four_five six"), (4, LONG + item), (5, "two three four five"), (5, "three four five six two three four five"), (6, "one two three")]
    items = [(1, item), (2, item), (3, "too short"), (4, None), (5, "")]
    got = rows(leaks(spark, documents, items), "doc_id", "item_id")
    assert got == [(3, 1), (3, 2), (4, 1), (4, 2), (5, 1), (5, 2)]
    assert rows(leaks(spark, [], items)) == rows(leaks(spark, documents, [])) == []
    d = spark.createDataFrame(documents, "doc_id bigint, text string")
    assert rows(leak.clean_documents(d, leaks(spark, documents, items)), "doc_id") == [(1,), (2,), (6,)]
    assert rows(leak.leak_report(leaks(spark, documents, items))) == [(1, 3, 6), (2, 3, 6)]


# ---- problem 9 ----

DOCS = "doc_id bigint, text string, lang string, source string, key double, bin int"


def documents(spark, counts):
    rng = random.Random(5)
    data = [(1000 * k + i, " ".join(["tree"] * rng.randint(50, 150)), "en", s, 0.0, 0) for k, (s, n) in enumerate(counts.items()) for i in range(n)]
    return spark.createDataFrame(data, DOCS)


def weights(spark, data):
    return spark.createDataFrame(data, "source string, target_share double, max_repeats int")


def test_mix_meets_the_shares(spark):
    counted = mixing.document_tokens(documents(spark, {"a": 400, "b": 100, "c": 40, None: 60}))
    goal = weights(spark, [("a", 0.5, 3), ("b", 0.4, 4), ("c", 0.1, 1), ("gone", 0.0, 2)])
    mix, report = mixing.mix_sources(counted, goal)
    mix = mix.collect()
    total = sum(r["tokens"] for r in counted.collect())
    used = defaultdict(int)
    for r in mix:
        used[r["source"]] += r["tokens"] * r["repeats"]
    assert abs(used["a"] / total - 0.5) < 0.005 and abs(used["b"] / total - 0.4) < 0.005
    # c has too little even once
    assert {r["repeats"] for r in mix if r["source"] == "c"} == {1} and len([r for r in mix if r["source"] == "c"]) == 40
    assert {r["repeats"] for r in mix if r["source"] == "b"} <= {2, 3}
    assert rows(report.filter("short"), "source") == [("c",)]
    report = {r["source"]: r for r in report.collect()}
    assert report["c"]["missing"] == round(0.1 * total) - report["c"]["tokens"] and report["a"]["missing"] == 0
    assert all(r["tokens"] == used[s] for s, r in report.items()) and abs(sum(r["wanted"] for r in report.values()) - total) <= 2
    assert report["gone"]["tokens"] == 0 and report["c"]["most_repeats"] == 1 and abs(sum(r["share"] for r in report.values()) - 1) < 1e-4


def test_better_documents_are_drawn_more_often(spark):
    data = [(i, "s", 100, 1.0 if i % 2 else 0.1) for i in range(2000)]
    counted = spark.createDataFrame(data, "doc_id bigint, source string, tokens bigint, quality double")
    drawn = [r["doc_id"] for r in mixing.mix_sources(counted, weights(spark, [("s", 0.3, 1)]))[0].collect()]
    assert abs(len(drawn) - 600) <= 1 and sum(i % 2 for i in drawn) > 480


def test_mix_on_awkward_tables(spark):
    odd = spark.createDataFrame([(1, None, None, "a", 0.0, 1), (2, "", "x", "a", 0.0, 1), (3, "tree", None, None, 0.0, 1), (4, LONG, "en", "b", 0.0, 1), (4, LONG, "en", "b", 0.0, 1)], DOCS)
    goal = weights(spark, [("a", 0.5, 2), ("b", 0.25, 1), ("b", 0.25, 1), (None, 0.1, 1), ("z", None, None)])
    mix, _ = mixing.mix_sources(mixing.document_tokens(odd), goal)
    assert rows(mix, "doc_id", "repeats") == [(4, 1)]
    empty = mixing.document_tokens(spark.createDataFrame([], DOCS))
    mix, report = mixing.mix_sources(empty, goal)
    assert rows(mix) == rows(report.filter("short")) == [] and report.count() == 3


def test_no_bin_is_hot_whatever_the_quality(spark):
    # one source holds all rows, most of them of the poorest quality
    counted = spark.range(20_000).selectExpr("id as doc_id", "'s' as source", "100L as tokens", "if(id % 10 = 0, 1.0, 0.05) as quality")
    key = -F.log((F.pmod(F.xxhash64(F.lit(42), F.col("doc_id")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))) / F.col("quality")
    largest = counted.groupBy(F.floor(F.log(key) * mixing.BINS_PER_UNIT)).count().agg(F.max("count")).first()[0]
    assert largest <= 40  # expected: at most 20,000 / (e * 1024) = 7 on average
    assert mixing.mix_sources(counted, weights(spark, [("s", 0.5, 1)]))[0].count() == 10_000


# ---- problem 10 ----


def test_prose_and_sentences():
    text = "# Head\nFirst line\ngoes on. Second one!\n- item one\nThird <b>bold</b> 3.5 end\n\n```\ncode here.\n```\n| a | b |\n[post 1 by x]\nLast"
    assert grading.sentences(text) == [["first", "line", "goes", "on"], ["second", "one"], ["third", "bold", "3", "5", "end"], ["last"]]
    assert grading.sentences(None) == grading.sentences("") == grading.sentences("``` open\ncode. more") == []


def test_bands_match_the_formula(spark, data):
    df = table(spark, data, "documents")
    expected = []
    for r in df.collect():
        d, _ = grading.difficulty(grading.sentences(r["text"]))
        if d is not None:
            expected.append((r["doc_id"], grading.band_of(d)))
            assert min(abs(d - b) for b in grading.BOUNDARIES) > 2
    assert rows(grading.reading_levels(df), "doc_id", "band") == sorted(expected, key=repr)


def test_models_are_right_on_held_out_documents(spark):
    df = table(spark, "/root/testdata/sf0.1", "documents")
    models = grading.GradeModels(grading.train_models(df.filter("doc_id % 5 <> 0"), sample=4000))
    symbols, bands = [], []
    for r in df.filter("doc_id % 5 = 0").collect():
        parts = grading.sentences(r["text"])
        d, _ = grading.difficulty(parts)
        if d is not None:
            symbols.append(grading.shapes(parts))
            bands.append(grading.band_of(d))
    got = models.band[models.grade(np.array(symbols, float))[0]]
    assert len(bands) > 1500 and (got == bands).mean() > 0.998


def test_training_moves_the_models(spark, data):
    counts = grading.train_models(table(spark, data, "documents"))
    assert counts and not np.array_equal(grading.GradeModels(counts).log, grading.GradeModels([]).log)


def test_models_count_every_document(spark):
    # more documents than any sample held
    df = spark.range(25_000).selectExpr("id as doc_id", "repeat('cat sat on the mat. ', 10) as text")
    assert [tuple(r) for r in grading.train_models(df)][0][1:] == (0, 25_000 * 50, 25_000 * 10)


def test_models_agree_with_the_formula_away_from_boundaries():
    rng = np.random.default_rng(3)
    words_, ends = rng.integers(80, 3000, 20_000), rng.integers(2, 200, 20_000)
    ends = np.minimum(ends, words_)
    long = (words_ * rng.random(20_000)).astype(int)
    d = words_ / ends + 100 * long / words_
    far = (np.abs(d[:, None] - np.array(grading.BOUNDARIES)) > 2).all(axis=1)
    models = grading.GradeModels([])
    got = models.band[models.grade(np.stack([long, words_ - long, ends], axis=1)[far].astype(float))[0]]
    assert (got == [grading.band_of(x) for x in d[far]]).mean() > 0.99


def test_levels_on_awkward_rows(spark):
    short = "cat sat. " * 10
    data = [(1, None), (2, ""), (3, short), (4, "cat sat on. " * 30), (5, LONG), (5, LONG), (6, "```\n" + "code " * 100)]
    df = spark.createDataFrame([(i, t, None, "s", 1, 2.0) for i, t in data], "doc_id bigint, text string, lang string, source string, band int, difficulty double").withColumn("kind", F.lit("k"))
    assert rows(grading.reading_levels(df), "doc_id", "band") == [(4, 1), (5, 4), (5, 4)]
    empty = df.limit(0)
    assert rows(grading.reading_levels(empty)) == []
    assert rows(grading.level_profile(grading.reading_levels(df, kept=grading.PROFILED)), "lang", "kind", "band", "documents") == [("(none)", "k", 1, 1), ("(none)", "k", 4, 2)]


# ---- SQL twins ----


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    data = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    for t in ("documents", "test_items", "merged_dataset", "splits", "validation", "python_balanced_1000", "case_studies", "sample_targets", "topic_reference", "source_weights"):
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    expected = connection.sql(queries.SQL[name])
    got = rows(queries.QUERIES[name](spark, data), *expected.columns)
    assert got and got == sorted((tuple(r) for r in expected.fetchall()), key=repr)
