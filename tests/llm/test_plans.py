"""Plans of the training-data queries: narrow scans, no nested loops."""

import pytest

from loomline.llm import queries

#: Columns that the headline queries need of their tables.
READS = {
    "p1_token_budget": {"record_id", "question", "answer", "lang", "source", "category"},
    "p8_found": {"doc_id", "text"},
    "p8_leaked_items": {"doc_id", "text"},
    "p7_found": {"record_id", "topic"},
    "p4_found": {"record_id", "question", "split"},
    "p10_found": {"doc_id", "text"},
    "p10_profile": {"doc_id", "text", "lang", "source", "kind"},
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_plan(spark, data, name):
    plan = queries.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan and "EvalPython" not in plan
    if name in READS:
        read = set()
        for part in plan.split("ReadSchema: struct<")[1:]:
            read |= {field.split(":")[0] for field in part.split(">")[0].split(",")}
        assert read and read <= READS[name]
