"""The cosine join in blocks: its pairs, and what it writes."""

import random
from pathlib import Path

import pytest

from loomline.operators import groups, near_blocks, similarity
from loomline.session import ensure_checkpoint_dir
from tests.test_reference import brute_cosine


def made_texts(n, rng):
    """Questions of two templates with made-up words."""
    word = lambda: "".join(rng.choice("bdfgklmnprstvz") + rng.choice("aeiou") for _ in range(3)) + rng.choice("skrtn")
    pool = [word() for _ in range(300)]
    forms = ["after joining {} and {} i keep 20 sparse records, why does {} stall once {} starts caching", "how can {} encode the values without touching the test rows of {} under the limits of {} and {}?"]
    return [rng.choice(forms).format(*rng.sample(pool, 4)) for _ in range(n)]


def written(spark):
    path = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    return sum(p.stat().st_size for p in path.rglob("*") if p.is_file())


@pytest.mark.parametrize("small_block", [20, 100_000])
def test_blocks_find_the_pairs_of_brute_force(spark, monkeypatch, small_block):
    monkeypatch.setattr(near_blocks, "SMALL_BLOCK", small_block)
    rng = random.Random(11)
    texts = made_texts(150, rng)
    texts += [t + "?" for t in texts[:20]] + [t.replace("sparse", "spärse") for t in texts[20:60]] + [" ".join(reversed(t.split())) for t in texts[60:80]]
    texts += ["ab", "abc", "aaaaaaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "naïve 😀 naïve 😀", "naïve 😀 naïve 😀!"]
    texts = list(dict.fromkeys(texts))
    df = spark.createDataFrame(list(enumerate(texts)), "record_id bigint, question string")
    for threshold in (0.9, 0.6):
        found = [(r["a"], r["b"]) for r in similarity.near_pairs(df, threshold, least=1).collect()]
        assert len(found) == len(set(found)) and set(found) == brute_cosine(texts, threshold)


def test_tables_without_pairs_or_rows(spark):
    df = spark.createDataFrame([(1, "a single question of some length"), (2, "quite other words"), (3, None)], "record_id bigint, question string")
    assert similarity.near_pairs(df, 0.9).collect() == [] == similarity.near_pairs(df.filter("false"), 0.9).collect()
    assert similarity.cross_pairs(df, df.filter("false"), 0.9).collect() == []
    assert [tuple(r)[:2] for r in similarity.cross_pairs(df, df.filter("record_id = 1"), 0.9).collect()] == [(1, 1)]


def test_join_writes_in_proportion_to_the_texts(spark):
    """Postings took 4.5 kB a text here; the blocks take 0.3."""
    n = 3_000
    df = spark.createDataFrame(list(enumerate(made_texts(n, random.Random(2)))), "record_id bigint, question string").repartition(2).cache()
    df.count()
    before = written(spark)
    groups.duplicate_groups(df).count()
    assert written(spark) - before < 1_500 * n
