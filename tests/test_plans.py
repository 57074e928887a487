"""Plans stay inside the JVM, read only what they need and join without nested loops."""

import pytest

from loomline.plans import registry

#: Columns that each query needs of its table.
READS = {
    "clean_dedup": {"doc_id", "text", "lang"},
    "drop_reasons": {"record_id", "question", "answer"},
    "dup_stats": {"question", "source"},
    "dist_category": {"category"},
    "length_profile": {"question", "answer", "topic", "category", "level"},
    "exact_overlap_rows": {"record_id", "question", "split"},
    "stratum_counts": {"category", "level"},
    "json_field_freq": {"props"},
    "token_length_stats": {"record_id", "question", "answer"},
}
#: Order-dependent folds, injected models and batch functions run in Python by design.
PYTHON = {"group_stratified_split", "group_split_v2", "group_split_v3", "group_split_invariants", "near_group_split", "generation_compare"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in registry.QUERIES if not n.startswith("p") or n in ("prepared_records", "pad_batches", "problem_samples")))
def test_plan(spark, data, name):
    df = registry.QUERIES[name](spark, data)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "InPandas" not in plan and "InArrow" not in plan and "EvalPython" not in plan
    if name in READS:
        read = set()
        for part in plan.split("ReadSchema: struct<")[1:]:
            read |= {field.split(":")[0] for field in part.split(">")[0].split(",")}
        assert read and read <= READS[name]


def test_filters_reach_the_scan(spark, data):
    assert "EqualTo(split,train)" in plan_of(registry.QUERIES["exact_overlap_rows"](spark, data))
