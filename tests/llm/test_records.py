"""Operators of problems 3 to 7 against brute force and on awkward input."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm.keys import form_key, words
from loomline.llm import bloom, canonical_map, form_duplicates, linked_split, quota_sample, split_overlap
from loomline.session import table
from tests.conftest import rows

RECORDS = "record_id bigint, question string, category string, topic string, key string, group_id int, maybe string, entity string, text string, train string"


def records(spark, data):
    return spark.createDataFrame([(i, q, c, t, "k", 1, "m", "e", "t", "x") for i, q, c, t in data], RECORDS)


LONG = "word " * 50_000 + "end"
AWKWARD = [
    (1, "What is a tree?", "A", "Pivot Tables"),
    (2, "what is, a TREE", "B", " pivot_tables "),
    (3, None, None, None),
    (4, "", "", ""),
    (5, "?!", "A", "???"),
    (6, LONG, "A", LONG),
    (7, LONG.upper(), None, "Tables, Pivot"),
    (8, "About CS-0000001 and Ziklap", "B", "PT"),
    (9, "the (ziklap) case", "A", "pvot tables"),
    (10, "cs 0000001 again", "A", "origami"),
    (11, "alone", "A", "Pivot Tab"),
]
CASES = [(1, "CS-0000001", "Stovad orchard"), (2, "CS-0000002", "Ziklap tram"), (3, None, None), (4, "CS-0000004", "Trees grow")]


def cases(spark, data=CASES):
    return spark.createDataFrame(data, "case_id bigint, case_code string, name string")


# ---- bloom and problem 6 ----


def test_bloom_has_no_false_negatives(spark):
    rng = np.random.default_rng(1)
    codes = rng.integers(-(2**62), 2**62, 5000)
    twice = codes[:700]
    df = spark.createDataFrame([(int(c),) for c in [*codes, *twice]] + [(None,)], "code bigint").repartition(5)
    bits = bloom.merged_filter(df, "code", bloom.log_bits_for(5700), "repeated")
    assert bloom.contains(bits, twice).all()
    assert bloom.contains(bits, codes[700:]).mean() < 0.05
    seen = bloom.merged_filter(df, "code", bloom.log_bits_for(5700), "seen")
    assert bloom.contains(seen, codes).all()


def test_bloom_of_nothing_is_empty(spark):
    assert not bloom.merged_filter(spark.createDataFrame([], "code bigint"), "code", 15, "seen").any()


def brute_forms(data):
    held = defaultdict(list)
    for i, q, *_ in data:
        if form_key(q):
            held[form_key(q)].append(i)
    return held


def test_form_groups_match_brute_force(spark, data):
    df = table(spark, data, "merged_dataset")
    held = brute_forms([tuple(r) for r in df.select("record_id", "question").collect()])
    assert rows(form_duplicates.form_groups(df)) == sorted(((i, min(v)) for v in held.values() if len(v) > 1 for i in v), key=repr)
    assert rows(form_duplicates.collapse_forms(df)) == sorted(((min(v), len(v)) for v in held.values()), key=repr)


def test_form_groups_on_awkward_rows(spark):
    df = records(spark, AWKWARD + AWKWARD[:1])
    assert rows(form_duplicates.form_groups(df)) == [(1, 1), (1, 1), (2, 1), (6, 6), (7, 6)]
    empty = records(spark, [])
    assert rows(form_duplicates.form_groups(empty)) == rows(form_duplicates.collapse_forms(empty)) == []


def test_sharded_filters_find_the_same(spark):
    df = table(spark, "/root/testdata/sf0.01", "merged_dataset")
    assert rows(form_duplicates.form_groups(df, max_log_bits=bloom.MIN_LOG_BITS)) == rows(form_duplicates.form_groups(df))
    assert rows(form_duplicates.collapse_forms(df, max_log_bits=bloom.MIN_LOG_BITS)) == rows(form_duplicates.collapse_forms(df))


# ---- problem 3 ----


def test_records_without_key_are_not_joined(spark):
    # half of all records without key: no task gets them all
    df = records(spark, [(i, None if i % 2 else f"question {i // 4}", "A", "t") for i in range(4000)]).repartition(4)
    groups = linked_split.record_groups(df, cases(spark))
    alone = [sum(r["record_id"] % 2 for r in p) for p in groups.rdd.glom().collect()]
    assert sum(alone) == 2000 and max(alone) <= 800
    assert groups.filter("record_id % 2 = 1 and group_id = record_id and size = 1").count() == 2000



def union_find(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in list(parent))


def brute_groups(data, entities):
    named = {}
    for case, code, name in entities:
        if words(name):
            named[words(name)[0]] = case
        if code:
            named[code[-7:]] = case
    edges = []
    for i, q, *_ in data:
        edges.append((("r", i), ("r", i)))
        if form_key(q):
            edges.append((("r", i), ("k", form_key(q))))
        edges += [(("r", i), ("c", named[w])) for w in linked_split.name_candidates(q) if w in named]
    group = dict(union_find(edges))
    held = defaultdict(list)
    for i, *_ in data:
        held[group[("r", i)]].append(i)
    return sorted(((i, min(v)) for v in held.values() if len(v) > 1 for i in v), key=repr)


def test_linked_records_match_brute_force(spark, data):
    df, entities = table(spark, data, "merged_dataset"), table(spark, data, "case_studies")
    expected = brute_groups([tuple(r) for r in df.select("record_id", "question").collect()], [tuple(r) for r in entities.collect()])
    assert expected and rows(linked_split.linked_records(df, entities)) == expected


def test_linked_records_on_awkward_rows(spark):
    got = rows(linked_split.linked_records(records(spark, AWKWARD), cases(spark)))
    assert got == [(1, 1), (10, 8), (2, 1), (6, 6), (7, 6), (8, 8), (9, 8)]
    assert rows(linked_split.linked_records(records(spark, []), cases(spark))) == []
    assert rows(linked_split.linked_records(records(spark, AWKWARD), cases(spark, []))) == [(1, 1), (2, 1), (6, 6), (7, 6)]


TARGETS = [("train", 0.9), ("validation", 0.05), ("test", 0.05)]


def test_split_keeps_groups_and_shares(spark):
    df, entities = table(spark, "/root/testdata/sf0.01", "merged_dataset"), table(spark, "/root/testdata/sf0.01", "case_studies")
    assigned = linked_split.stratified_group_split(linked_split.record_groups(df, entities), df, TARGETS).collect()
    assert len(assigned) == df.count() == len({r["record_id"] for r in assigned})
    assert max(Counter(g for g, _ in {(r["group_id"], r["split"]) for r in assigned}).values()) == 1
    share = Counter(r["split"] for r in assigned)
    assert all(abs(share[s] / len(assigned) - t) < 0.01 for s, t in TARGETS)
    labels = Counter(r["label"] for r in assigned)
    test = Counter(r["label"] for r in assigned if r["split"] == "test")
    assert all(abs(test[x] / n - 0.05) < 0.01 for x, n in labels.items() if n > 100)


def test_split_on_awkward_rows(spark):
    df = records(spark, AWKWARD + [AWKWARD[0]])
    assigned = rows(linked_split.stratified_group_split(linked_split.record_groups(df, cases(spark)), df, TARGETS), "record_id", "split")
    assert len(assigned) == len(AWKWARD)
    empty = records(spark, [])
    assert rows(linked_split.stratified_group_split(linked_split.record_groups(empty, cases(spark)), empty, TARGETS)) == []


def test_hot_group_leaves_the_others_in_proportion(spark):
    # one group of a third of all rows, many small ones
    data = [(i, f"about cs0000001 number {i}", "A", "t") for i in range(500)] + [(1000 + i, f"question {i}", "AB"[i % 2], "t") for i in range(1000)]
    df = records(spark, data)
    assigned = linked_split.stratified_group_split(linked_split.record_groups(df, cases(spark)), df, TARGETS).collect()
    share = Counter(r["split"] for r in assigned)
    assert abs(share["test"] - 75) <= 2 and abs(share["validation"] - 75) <= 2


def test_labels_beyond_the_bound_are_balanced_together(spark):
    df = records(spark, [(i, f"question {i}", "AB"[i % 2] if i < 300 else f"rare {i}", "t") for i in range(400)])
    assigned = linked_split.stratified_group_split(linked_split.record_groups(df, cases(spark)), df, TARGETS, max_labels=2).collect()
    rare = Counter(r["split"] for r in assigned if r["label"].startswith("rare"))
    assert len(assigned) == 400 and rare == {"train": 90, "validation": 5, "test": 5}


def test_rarest_label_is_placed_first():
    vectors = [(i, {"common": 1}) for i in range(80)] + [(100 + i, {"rare": 1, "common": 1}) for i in range(20)]
    wanted = np.outer([0.8, 0.2], [100.0, 20.0])
    placed = linked_split.place(vectors, wanted, ["common", "rare"])
    assert sum(placed[100 + i] for i in range(20)) == 4 and sum(placed.values()) == 20


# ---- problem 4 ----


def brute_overlaps(train, evaluation):
    found = set()
    for a, x in train:
        for b, y in evaluation:
            s, t = set(words(x)), set(words(y))
            if (form_key(x) and form_key(x) == form_key(y)) or (s | t and 4 * len(s & t) >= 3 * len(s | t)):
                found.add((a, b))
    return sorted(found, key=repr)


def frame(spark, data):
    return spark.createDataFrame([(i, q, "w", "k", True) for i, q in data], "record_id bigint, question string, words string, key string, train boolean")


def overlaps(train, evaluation):
    return split_overlap.expanded_pairs(*split_overlap.cross_split_overlaps(train, evaluation))


def test_overlaps_match_brute_force(spark, data):
    splits, validation = table(spark, data, "splits"), table(spark, data, "validation")
    train = [tuple(r) for r in splits.filter("split = 'train'").select("record_id", "question").collect()]
    evaluation = [tuple(r) for r in splits.filter("split = 'test'").select("record_id", "question").union(validation.select("record_id", "question")).collect()]
    got = rows(overlaps(frame(spark, train), frame(spark, evaluation)), "train_id", "eval_id")
    assert got and got == brute_overlaps(train, evaluation)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcdefghijkl"), min_size=1, max_size=14), min_size=1, max_size=8), st.lists(st.lists(st.sampled_from("abcdefghijkl"), min_size=1, max_size=14), min_size=1, max_size=8))
def test_passages_lose_no_partner(left, right):
    former = split_overlap.Former()
    sides = [[former.form(" ".join(t)) for t in side] for side in (left, right)]
    shard = split_overlap.EvaluationShard([(str(i).encode(), key, form) for i, (key, _, form) in enumerate(sides[1])])
    found = [(a, int(e), coverage) for a, (key, _, form) in enumerate(sides[0]) for e, coverage, _ in shard.scan(key, form)]
    assert sorted(((a, e) for a, e, _ in found), key=repr) == brute_overlaps(list(enumerate(" ".join(t) for t in left)), list(enumerate(" ".join(t) for t in right)))
    assert all(0 < coverage <= 1 for *_, coverage in found)


def test_intervals_merge():
    assert split_overlap.merged_length([(4, 6), (0, 2), (1, 3), (0, 2)]) == 5


def test_shards_and_passes_find_the_same(spark, data, monkeypatch):
    splits, validation = table(spark, data, "splits"), table(spark, data, "validation")
    whole = rows(overlaps(splits, validation))
    monkeypatch.setattr(split_overlap, "EVAL_SHARD", 3)
    assert whole and rows(overlaps(splits, validation)) == whole


WORD_LISTS = st.lists(st.lists(st.sampled_from("abcdefghijkl"), min_size=1, max_size=14) | st.integers(30, 140).flatmap(lambda n: st.integers(0, 20).map(lambda a: [f"w{i}" for i in range(a, a + n)])), min_size=1, max_size=8)


@settings(max_examples=150, deadline=None)
@given(WORD_LISTS, WORD_LISTS, st.dictionaries(st.sampled_from([*"abcdefghijkl", *(f"w{i}" for i in range(160))]), st.integers(2, 9)))
def test_partners_share_a_signature(left, right, counts):
    former = split_overlap.Former()
    often = sorted((former.form(w)[2][0], n) for w, n in counts.items())
    order = [np.array([x[i] for x in often], np.int64) for i in (0, 1)]

    def signed(side, train):
        forms = [former.form(" ".join(t)) for t in side]
        flat = np.array([c for *_, form in forms for c in form], np.int64)
        found = [set() for _ in side]
        for row, values in split_overlap.signatures([key for key, *_ in forms], flat, np.array([len(form) for *_, form in forms]), *order, train):
            for i, x in zip(row.tolist(), values.tolist()):
                found[i].add(x)
        return found

    train, evaluation = signed(left, True), signed(right, False)
    pairs = brute_overlaps(list(enumerate(map(" ".join, left))), list(enumerate(map(" ".join, right))))
    assert all(train[a] & evaluation[b] for a, b in pairs)


def test_training_texts_are_read_once_for_many_shards(spark, data, monkeypatch):
    splits, validation = table(spark, data, "splits"), table(spark, data, "validation")
    whole = rows(overlaps(splits, validation))
    monkeypatch.setattr(split_overlap, "EVAL_SHARD", 3)
    monkeypatch.setattr(split_overlap, "FILTER_BITS", 1 << 15, raising=False)
    matches, members = split_overlap.cross_split_overlaps(splits, validation)
    assert matches._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 1
    assert whole and rows(split_overlap.expanded_pairs(matches, members)) == whole


def test_few_texts_meet_that_are_no_partners():
    # questions of one template: the shared words are frequent ones
    former, rng = split_overlap.Former(), random.Random(9)
    forms = [former.form("how can the loader of " + " ".join(f"w{rng.randrange(3000)}" for _ in range(5)) + " read the rows in order") for _ in range(3000)]
    flat, sizes = np.array([c for *_, form in forms for c in form], np.int64), np.array([len(form) for *_, form in forms])
    codes, counts = np.unique(flat, return_counts=True)
    sides = []
    for train in (True, False):
        found = list(split_overlap.signatures([key for key, *_ in forms], flat, sizes, codes, counts, train))
        sides.append(Counter(x for _, values in found for x in values.tolist()))
    met = sum(n * sides[1][x] for x, n in sides[0].items())
    assert met < 40 * len(forms)


def test_overlaps_on_awkward_rows(spark):
    train = [(1, "data set of trees"), (2, None), (3, ""), (4, "?!"), (5, LONG), (6, "one two three four"), (6, "one two three four")]
    evaluation = [(11, "Dataset of trees!"), (12, None), (13, "_"), (14, LONG + " more"), (15, "four three two"), (16, "one")]
    got = rows(overlaps(frame(spark, train), frame(spark, evaluation)), "train_id", "eval_id")
    # LONG has two distinct words, with "more" three: 2/3 is too little
    assert got == [(1, 11), (6, 15), (6, 15)]
    assert rows(overlaps(frame(spark, []), frame(spark, evaluation))) == []
    assert rows(overlaps(frame(spark, train), frame(spark, []))) == []


def test_overlap_report_counts_every_evaluation_row(spark):
    members = spark.createDataFrame([(11, b"a", "test", "s"), (12, None, "test", None), (13, b"c", "validation", "s"), (14, b"a", "validation", "s")], "eval_id bigint, text binary, split string, source string")
    matches = spark.createDataFrame([(1, b"a", 1.0, 1.0), (2, b"a", 1.0, 0.8)], "train_id bigint, text binary, coverage double, similarity double")
    assert rows(split_overlap.overlap_report(matches, members)) == [("test", "", 1, 0, 0), ("test", "s", 1, 1, 2), ("validation", "s", 2, 1, 2)]


# ---- problem 5 ----

POOL = "row_id bigint, category string, topic string, quota string, _b string"


def pool(spark, counts):
    data, i = [], 0
    for (c, t), n in counts.items():
        for _ in range(n):
            data.append((i, c, t, "q", "b"))
            i += 1
    return spark.createDataFrame(data, POOL)


def targets(spark, data):
    return spark.createDataFrame(data, "category string, topic string, target_share double, min_rows int")


def test_short_stratum_passes_quota_to_siblings_then_cousins(spark):
    df = pool(spark, {("A", "x"): 5, (" a", "Y\t"): 300, ("B", "z"): 300, ("C", None): 400, ("o", "ther"): 395})
    goal = targets(spark, [("A", "x", 0.2, 5), ("A", "y", 0.3, 5), ("B", "z", 0.5, 5)])
    sample, report = quota_sample.quota_sample(df, goal, 0.2)
    drawn = Counter((r["category"], r["topic"]) for r in sample.collect())
    # 280 rows: 56 due from x, which has 5; 51 go to its sibling
    assert drawn == {("A", "x"): 5, ("A", "y"): 135, ("B", "z"): 140}
    assert {(r["topic"], r["drawn"], r["short"]) for r in report.collect()} == {("x", 5, True), ("y", 135, False), ("z", 140, False)}
    assert rows(report.filter("short"), "category", "topic") == [("A", "x")]


def test_cousins_take_what_a_category_cannot_give(spark):
    df = pool(spark, {("A", "x"): 5, ("B", "z"): 995})
    drawn = Counter(r["topic"] for r in quota_sample.quota_sample(df, targets(spark, [("A", "x", 0.5, 1), ("B", "z", 0.5, 1)]), 0.2)[0].collect())
    assert drawn == {"x": 5, "z": 195}


def test_sample_on_awkward_tables(spark):
    goal = targets(spark, [("A", "x", 0.5, 3), ("a ", "X", 0.2, 4), (None, "x", 0.1, 1), ("B", None, None, None), ("C", "none", 0.2, 2)])
    df = pool(spark, {("A", "x"): 10, (None, None): 3, ("", ""): 2})
    sample, report = quota_sample.quota_sample(df, goal, 0.4)
    assert len({r["row_id"] for r in sample.collect()}) == sample.count() == 6 and report.count() == 4
    empty = spark.createDataFrame([], POOL)
    sample, report = quota_sample.quota_sample(empty, goal)
    assert sample.count() == report.filter("short").count() == 0 and report.count() == 4


def test_sample_is_a_permutation_prefix(spark):
    df = pool(spark, {("A", "x"): 3000})
    a = {r["row_id"] for r in quota_sample.quota_sample(df, targets(spark, [("A", "x", 1.0, 1)]), 0.2)[0].collect()}
    b = {r["row_id"] for r in quota_sample.quota_sample(df.repartition(7), targets(spark, [("A", "x", 1.0, 1)]), 0.2)[0].collect()}
    assert a == b and len(a) == 600 and 1200 < sum(a) / len(a) < 1800


# ---- problem 7 ----

REFERENCE = [(1, "Pivot Tables", "PT", "X"), (2, "Random Forests", None, "X"), (3, "Part of Speech Tagging", "POS", "X"), (4, None, None, None), (None, "Nothing", None, "X")]


def reference(spark, data=REFERENCE):
    return spark.createDataFrame(data, "topic_id int, topic string, short_form string, category string")


def test_mapping_on_awkward_rows(spark):
    df = records(spark, AWKWARD + AWKWARD[-1:])
    expected = [(10, 0), (11, 1), (11, 1), (2, 1), (5, 0), (6, 0), (7, 1), (8, 1), (9, 1)]
    assert rows(canonical_map.map_to_reference(df, reference(spark))) == expected
    # the same through shards of one entry
    assert rows(canonical_map.map_to_reference(df, reference(spark), max_broadcast=1)) == expected
    assert {t for _, t in rows(canonical_map.map_to_reference(df, reference(spark, [])))} == {0}
    assert rows(canonical_map.map_to_reference(records(spark, []), reference(spark))) == []
    unmatched = canonical_map.unmatched_values(df, canonical_map.map_to_reference(df, reference(spark)))
    assert {r["value"] for r in unmatched.collect()} == {"???", "origami", LONG}


@pytest.mark.parametrize("value, topic", [("part of speech tagging", 3), ("Tagging, Part of Speech", 3), ("intro to Pivot Tables", 1), ("Pivot Tables - part 2", 1), ("P.O.S.", 3), ("pos basics", 3), ("forests random", 2), ("Rnadom Froests", 2), ("Random For.", 2), ("random gardens", 0), ("picnic tables today", 0)])
def test_forms_of_a_topic(value, topic):
    entries = [(i, t, s) for i, t, s, _ in REFERENCE if i and t]
    assert canonical_map.Matcher(entries).match([value]) == [topic]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("abcde", min_size=1, max_size=9), min_size=1, max_size=12, unique=True), st.lists(st.text("abcdef", max_size=10), min_size=1, max_size=6))
def test_bk_tree_returns_everything_within_the_threshold(entries, values):
    tree = canonical_map.BKTree([(t, i) for i, t in enumerate(entries)])
    for value, found in zip(values, tree.within(values, lambda n: 2)):
        assert sorted(found) == sorted((canonical_map.levenshtein(value, t), i) for i, t in enumerate(entries) if canonical_map.levenshtein(value, t) <= 2)


def merged(shards, value):
    """The rule by which shards are merged, in plain Python."""
    ranked = [s.ranked([value])[0] for s in shards]
    best = min(r[:5] for r in ranked)
    if best[0] < canonical_map.NONE:
        return best[4]
    cut = [r[5:] for r in ranked if r[5] is not None]
    return min(c for *_, c in cut) if cut and min(low for low, *_ in cut) == max(high for _, high, _ in cut) else 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from(["graph", "search", "methods", "graphs", "Graph", "sea"]), min_size=1, max_size=3), st.sampled_from([None, "gs", "GM"])), min_size=1, max_size=9), st.lists(st.lists(st.sampled_from(["graph", "search", "methods", "grph", "in", "depth", "gs", "graph-sea", "meth"]), min_size=1, max_size=4), min_size=1, max_size=5), st.randoms())
def test_shards_decide_like_the_whole_list(entries, values, rng):
    entries = [(i + 1, " ".join(t), s) for i, (t, s) in enumerate(entries)]
    shards = [[], [], []]
    for e in entries:
        shards[rng.randrange(3)].append(e)
    whole, parts = canonical_map.Matcher(entries), [canonical_map.Matcher(s) for s in shards]
    for value in map(" ".join, values):
        assert merged(parts, value) == whole.match([value])[0]


def test_sharded_mapping_of_the_test_table(spark):
    df, entries = table(spark, "/root/testdata/sf0.01", "merged_dataset"), table(spark, "/root/testdata/sf0.01", "topic_reference")
    assert rows(canonical_map.map_to_reference(df, entries, max_broadcast=20)) == rows(canonical_map.map_to_reference(df, entries))


def test_long_entries_use_the_plain_programme():
    tree = canonical_map.BKTree([("a" * 64, 1), ("b" * 70, 2)])
    assert tree.within(["a" * 63 + "x", "b" * 69], lambda n: 2) == [[(1, 1)], [(1, 2)]]
