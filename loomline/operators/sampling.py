"""Quota sampling and stratified splits with reproducible order.

Order within a group is that of ``md5(seed | row id)``: a permutation that any
engine can repeat and that needs no shared random state. Ranks are computed in
two levels (rows per hash bucket, then inside a bucket), so a group that holds a
third of all rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import or_default
from loomline.session import durable

SEED = 42
#: Rows wanted of each topic; they sum to 990, the rest is filled up.
QUOTAS = {"Algorithms": 180, "NumPy": 160, "Debugging": 180, "Web/API": 140, "Pandas": 140, "Machine Learning": 100, "File Handling": 50, "Python Basics": 20, "Functions": 10, "OOP": 10}


def shuffle_key(id_column: str | Column, seed: int = SEED) -> Column:
    column = F.col(id_column) if isinstance(id_column, str) else id_column
    return F.md5(F.concat_ws("|", F.lit(str(seed)), column.cast("string")))


def ranked(df: DataFrame, group: list[str], order: str = "order_key", tie: str = "rid") -> DataFrame:
    """``df`` with the exact rank (from 1) and size of each row's group.

    ``order`` holds hex digits. Every (group, first three digits) is ranked by
    itself; the ranks are shifted by the counts of the buckets before.
    """
    bucketed = df.withColumn("_bucket", F.substring(order, 1, 3))
    counts = bucketed.groupBy(*group, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(*group)).alias("group_size"))
    inside = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(order, tie))
    return bucketed.withColumn("_inside", inside).join(counts, [*group, "_bucket"]).withColumn("rank", F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def quota_sample(df: DataFrame, topic: Column, id_column: str, quotas: dict[str, int] | None = None, size: int = 1000, seed: int = SEED) -> DataFrame:
    """(rid, topic): each topic's quota, filled up to ``size`` from the rows left over."""
    quotas = QUOTAS if quotas is None else quotas
    rows = df.select(F.col(id_column).alias("rid"), topic.alias("topic")).withColumn("order_key", shuffle_key("rid", seed))
    # ids, topics and keys only; the classifier runs once
    ranks = ranked(durable(rows), ["topic"])
    quota = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in quotas.items() for x in kv)), F.col("topic")), F.lit(0))
    # quota rows first, then the shuffled rest: one top-k over both
    first = (F.col("rank") <= quota).cast("int")
    return ranks.orderBy((1 - first), "order_key", "rid").limit(size).select("rid", "topic")


def stratified_split(df: DataFrame, id_column: str = "record_id", category: str = "category", level: str = "level", share: float = 0.05, seed: int = SEED) -> DataFrame:
    """(rid, category, level, split): 90/5/5 within each (category, level).

    Up to three rows: all train. Else validation and test get the rounded share
    (half to even), one at least from 20 rows on; train comes first in order.
    """
    rows = df.select(F.col(id_column).alias("rid"), or_default(category, "Other").alias("category"), or_default(level, "Unknown").alias("level")).withColumn("order_key", shuffle_key("rid", seed))
    ranks = ranked(rows, ["category", "level"])
    n = F.col("group_size")
    part = F.bround(n * F.lit(share)).cast("bigint")
    part = F.when(n <= 3, 0).when((n >= 20) & (part < 1), 1).otherwise(part)
    part = F.when(2 * part >= n, F.greatest(F.lit(0), F.floor((n - 1) / 2))).otherwise(part)
    train = n - 2 * part
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + part, "validation").otherwise("test")
    return ranks.select("rid", "category", "level", split.alias("split"))


def check_ratios(ratios: dict[str, float], tolerance: float = 1e-6) -> dict[str, float]:
    """The ratios, if none is negative and they sum to one; else an error."""
    if any(r < 0 for r in ratios.values()) or abs(sum(ratios.values()) - 1) > tolerance:
        raise ValueError(f"split ratios must sum to 1: {ratios}")
    return ratios


def split_targets(total: Column) -> tuple[Column, Column, Column]:
    """Rows wanted in train, validation and test: 90 %, 5 % (half to even), the rest."""
    train, validation = F.bround(total * 0.9).cast("bigint"), F.bround(total * 0.05).cast("bigint")
    return train, validation, total - train - validation


def split_invariants(original: DataFrame, assigned: DataFrame, id_column: str, group: Column | None = None) -> DataFrame:
    """One row: whether counts are kept, ids are unique and groups undivided."""
    rows = assigned.select(F.col("rid"), F.col("split"), (group if group is not None else F.col("rid")).alias("group_id"))
    # one pass of pre-aggregated distinct counts; no group is collected
    ids = rows.groupBy("rid").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("assigned"), F.count_if(F.col("n") > 1).alias("assigned_twice"))
    split_groups = rows.groupBy("group_id").agg(F.count_distinct("split").alias("n")).agg(F.count_if(F.col("n") > 1).alias("divided_groups"))
    total = original.agg(F.count(F.col(id_column)).alias("total"))
    # three one-row tables, put side by side by scalar subqueries
    row = total.select("total", *(ids.select(c).scalar().alias(c) for c in ("assigned", "assigned_twice")), split_groups.scalar().alias("divided_groups"))
    return row.withColumn("holds", (F.col("total") == F.col("assigned")) & (F.col("assigned_twice") == 0) & (F.col("divided_groups") == 0))
