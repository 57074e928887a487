"""Registered queries over the whole master table, against brute force on small fixtures."""

import random
from collections import defaultdict

import pytest

from loomline.plans import registry
from tests.test_reference import brute_cosine


@pytest.fixture(scope="module")
def master(spark, tmp_path_factory):
    """(directory, texts): near copies of random questions under other ids and labels."""
    rng = random.Random(5)
    words = ["tree", "forest", "gradient", "boosting", "kernel", "matrix", "vector", "loss", "pivot", "cluster", "token", "regression"]
    texts = list(dict.fromkeys(" ".join(rng.choices(words, k=8)) for _ in range(120)))
    texts += [t + "s" for t in texts]
    data = [(i, t, "a" * 40, rng.choice("AB"), rng.choice("XY")) for i, t in enumerate(texts)]
    directory = str(tmp_path_factory.mktemp("master"))
    spark.createDataFrame(data, "record_id bigint, question string, answer string, category string, level string").write.parquet(f"{directory}/merged_dataset.parquet")
    return directory, texts


@pytest.fixture(scope="module")
def near(master):
    found = brute_cosine(master[1], 0.9)
    assert len(found) > 50
    return found


def components(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("name", ["group_stratified_split", "group_split_v2", "group_split_v3"])
def test_near_copies_stay_in_one_split(spark, master, near, name):
    split = {r["rid"]: r["split"] for r in registry.QUERIES[name](spark, master[0]).collect()}
    assert len(split) == len(master[1])
    assert [p for p in near if split[p[0]] != split[p[1]]] == []


def test_group_sizes_count_near_copies(spark, master, near):
    sizes = defaultdict(int)
    for group in components(len(master[1]), near).values():
        sizes[group] += 1
    for name in ("near_group_profile", "near_numbered_groups"):
        assert {r["group_id"]: r["size"] for r in registry.QUERIES[name](spark, master[0]).collect()} == sizes
    assert sum(r["groups"] for r in registry.QUERIES["near_group_dominant"](spark, master[0]).collect()) == len(sizes)


def test_near_copies_of_the_master_table_are_found(spark, master, near):
    found = {(r["a"], r["b"]) for r in registry.QUERIES["merged_near_pairs_090"](spark, master[0]).collect()}
    assert found == near
    groups = {r["rid"]: r["group_id"] for r in registry.QUERIES["merged_near_dup_groups"](spark, master[0]).collect()}
    assert groups == components(len(master[1]), near)
    assert {r["rid"] for r in registry.QUERIES["merged_tfidf_weights"](spark, master[0]).collect()} == set(range(len(master[1])))


def test_near_group_split_covers_the_master_table(spark, master):
    assert {r["rid"] for r in registry.QUERIES["near_group_split"](spark, master[0]).collect()} == set(range(len(master[1])))
