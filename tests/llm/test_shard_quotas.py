"""Quotas of shards add up, so that rare labels reach every split (problem 3)."""

from collections import Counter

import numpy as np
import pytest

from loomline.llm import linked_split

TARGETS = [("train", 0.9), ("validation", 0.05), ("test", 0.05)]


def test_quotas_add_up_both_ways():
    rng = np.random.default_rng(1)
    for _ in range(200):
        counts = rng.integers(0, 30, rng.integers(1, 12))
        quotas = linked_split.apportion(np.array([counts.sum()]), np.array([[0.9], [0.05], [0.05]]))[:, 0]
        dealt = linked_split.spread(quotas, counts)
        assert quotas.sum() == counts.sum() and (dealt >= 0).all()
        assert (dealt.sum(axis=0) == quotas).all() and (dealt.sum(axis=1) == counts).all()


@pytest.mark.parametrize("labels", [1000, 2])
def test_rare_labels_reach_every_split(spark, monkeypatch, labels):
    monkeypatch.setattr(linked_split, "SHARD", 100)
    # with two labels of their own, the rare ones are pooled
    data = [(i, "rare" if i % 20 == 0 else "seldom" if i % 40 == 1 else "ab"[i % 2]) for i in range(400)]
    records = spark.createDataFrame(data, "record_id bigint, category string")
    groups = records.selectExpr("record_id", "record_id as group_id", "1L as size")
    got = Counter((r["label"], r["split"]) for r in linked_split.stratified_group_split(groups, records, TARGETS, max_labels=labels).collect())
    assert sum(got.values()) == 400
    if labels > 2:
        assert [got["rare", s] for s, _ in TARGETS] == [18, 1, 1]
    else:
        assert [got["rare", s] + got["seldom", s] for s, _ in TARGETS] in ([27, 2, 1], [27, 1, 2])
