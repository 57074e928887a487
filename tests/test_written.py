"""Queries over near copies write in proportion to their texts."""

import pytest

from loomline.plans import registry
from tests.test_near_blocks import made_texts, random, written

N = 1_500


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    directory = str(tmp_path_factory.mktemp("written"))
    texts = made_texts(N, random.Random(4))
    rows = [(i, t, "an answer", "A", "X", "train" if i % 3 else "test") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "record_id bigint, question string, answer string, category string, level string, split string")
    for name in ("merged_dataset", "validation", "splits"):
        df.write.parquet(f"{directory}/{name}.parquet")
    return directory


@pytest.mark.parametrize("name", ["near_dup_groups", "cross_pairs_085_top50", "threshold_counts"])
def test_query_writes_in_proportion_to_the_texts(spark, tables, name):
    before = written(spark)
    registry.QUERIES[name](spark, tables).count()
    assert written(spark) - before < 2_000 * N
