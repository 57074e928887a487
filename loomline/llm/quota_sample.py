"""Sample whose category shares match targets (problem 5).

Hierarchical top-down allocation over the tree category > topic: every stratum
is due ``target_share`` of the sample (largest remainders, at least
``min_rows``, at most what it has); quota that a stratum cannot meet passes to
its siblings (same category) in proportion to their targets, and what a
category cannot meet passes to the cousins (strata of the other categories).
Rows are drawn by their rank in a keyed permutation (md5 of seed and row id).
Ranks are exact and distributed: rows are counted per hash bucket, whole
buckets below the cut are taken, and only the one bucket that holds the cut is
ranked inside, so a stratum that holds a third of all rows is no hot task.

Defined results: labels are compared without case and outer blanks; repeated
rows count and may be drawn; rows outside the targets are never drawn; a
stratum without rows (or with a null label) is reported with none; a stratum
listed twice is one; empty pools give an empty sample; a null or negative target
counts as 0; other columns are not read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import durable

BUCKET_DIGITS = 3  # 4096 buckets by the leading hex digits of the permutation hash


def label_key(column: str | Column) -> Column:
    """Label without case and outer blanks (all white space, not spaces alone)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(column.cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def stratum_counts(pool: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with the rows each stratum has; targets are a fixed small table."""
    have = pool.select(label_key("category").alias("_c"), label_key("topic").alias("_t")).groupBy("_c", "_t").agg(F.count("*").alias("available"))
    keyed = targets.select("category", "topic", "target_share", "min_rows", label_key("category").alias("_c"), label_key("topic").alias("_t"))
    return keyed.join(have, ["_c", "_t"], "left").select("_c", "_t", "category", "topic", "target_share", "min_rows", F.coalesce("available", F.lit(0)).alias("available"))


def _spread(quota: float, weights: dict, room: dict) -> dict:
    """Split a quota by weight within each member's room; what is left over stays out."""
    given = {k: 0.0 for k in room}
    open_ = {k for k in room if room[k] > 0 and weights[k] > 0}
    while quota > 1e-9 and open_:
        whole = sum(weights[k] for k in open_)
        step = {k: min(room[k] - given[k], quota * weights[k] / whole) for k in open_}
        for k, x in step.items():
            given[k] += x
        quota -= sum(step.values())
        full = {k for k in open_ if room[k] - given[k] <= 1e-9}
        if not full:
            break
        open_ -= full
    return given


def allocate(strata: list[dict], size: int) -> dict[tuple, int]:
    """Rows to draw of each stratum. strata: _c, _t, target_share, min_rows, available."""
    share = {(s["_c"], s["_t"]): max(0.0, s["target_share"] or 0.0) for s in strata}
    have = {(s["_c"], s["_t"]): s["available"] for s in strata}
    least = {(s["_c"], s["_t"]): min(s["available"], max(0, s["min_rows"] or 0)) for s in strata}
    take = {k: min(have[k], max(least[k], size * share[k])) for k in share}
    missing = sum(max(0.0, size * share[k] - have[k]) for k in share)
    for parent in sorted({k[0] for k in share}, key=str):
        # siblings first
        own = [k for k in share if k[0] == parent]
        lost = sum(max(0.0, size * share[k] - have[k]) for k in own)
        more = _spread(lost, {k: share[k] for k in own}, {k: have[k] - take[k] for k in own})
        for k, x in more.items():
            take[k] += x
        missing -= sum(more.values())
    # then cousins
    for k, x in _spread(missing, share, {k: have[k] - take[k] for k in share}).items():
        take[k] += x
    # minimum rows may have pushed the sum over the size: give back above the minimum
    over = sum(take.values()) - size
    if over > 1e-9:
        for k, x in _spread(over, {k: max(take[k] - least[k], 0.0) for k in take}, {k: take[k] - least[k] for k in take}).items():
            take[k] -= x
    whole = {k: math.floor(x + 1e-9) for k, x in take.items()}
    spare = min(size, round(sum(take.values()))) - sum(whole.values())
    for k in sorted(take, key=lambda k: (whole[k] - take[k], str(k))):
        if spare > 0 and whole[k] < have[k]:
            whole[k] += 1
            spare -= 1
    return whole


def _drawn(keyed: DataFrame, quota: DataFrame) -> DataFrame:
    """Rows of ``keyed`` (_c, _t, _p permutation hash) whose rank is within the quota."""
    bucket = F.substring("_p", 1, BUCKET_DIGITS)
    keyed = keyed.withColumn("_b", bucket)
    sizes = keyed.groupBy("_c", "_t", "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_c", "_t").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cuts = sizes.join(quota, ["_c", "_t"]).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    # at most 4096 rows for each of the targets; a hot stratum is spread over its buckets
    cuts = cuts.withColumn("_open", F.col("quota") - F.col("_before")).filter("_open > 0").select("_c", "_t", "_b", "_n", "_open")
    kept = keyed.join(cuts, ["_c", "_t", "_b"])
    whole = kept.filter("_n <= _open")
    rank = F.row_number().over(Window.partitionBy("_c", "_t", "_b").orderBy("_p", "_id"))
    edge = kept.filter("_n > _open").withColumn("_rank", rank).filter("_rank <= _open").drop("_rank")
    return whole.unionByName(edge)


_PLAN = "_c string, _t string, category string, topic string, target_share double, min_rows int, available bigint, quota bigint, due double"


def _planned(fraction: float):
    def run(targets: pd.DataFrame) -> pd.DataFrame:
        """Quotas of all strata; the table has as many rows as the list of targets."""
        merged: dict[tuple, dict] = {}
        rows = [{k: None if pd.isna(x) else x for k, x in r.items()} for r in targets.to_dict("records")]
        for s in sorted(rows, key=lambda r: (r["category"] is not None, r["category"], r["topic"] is not None, r["topic"])):
            # a stratum listed twice: its shares add up, its greater minimum holds
            known = merged.setdefault((s["_c"], s["_t"]), s | {"target_share": 0.0, "min_rows": 0})
            known["target_share"] += max(0.0, s["target_share"] or 0.0)
            known["min_rows"] = max(known["min_rows"], int(s["min_rows"] or 0))
        total = int(rows[0]["total"])
        quotas = allocate(list(merged.values()), math.floor(total * fraction + 1e-9))
        out = [(*k, s["category"], s["topic"], s["target_share"], s["min_rows"], int(s["available"]), quotas[k], s["target_share"] * (total * fraction)) for k, s in merged.items()]
        return pd.DataFrame(out, columns=[c.split()[0] for c in _PLAN.split(", ")])

    return run


def quota_sample(pool: DataFrame, targets: DataFrame, fraction: float = 0.2, seed: int = 42, id_column: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """(sample with id, category, topic as in the targets; report per stratum).

    The report counts the rows drawn; ``short`` marks strata with fewer rows
    than their share of the sample.
    """
    counts = stratum_counts(pool, targets).withColumn("total", pool.agg(F.count("*")).scalar())
    plan = durable(counts.groupBy("total").applyInPandas(_planned(fraction), _PLAN))
    keyed = pool.select(F.col(id_column).alias("_id"), label_key("category").alias("_c"), label_key("topic").alias("_t")).withColumn("_p", F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_id").cast("string"))))
    drawn = _drawn(keyed.join(plan.select("_c", "_t"), ["_c", "_t"], "left_semi"), plan.select("_c", "_t", "quota"))
    sample = drawn.join(plan.select("_c", "_t", "category", "topic"), ["_c", "_t"]).select(F.col("_id").alias(id_column), "category", "topic")
    got = drawn.groupBy("_c", "_t").agg(F.count("*").alias("drawn"))
    rows = durable(plan.join(got, ["_c", "_t"], "left").select("category", "topic", "target_share", "min_rows", "available", F.coalesce("drawn", F.lit(0)).alias("drawn"), (F.col("available") < F.col("due")).alias("short")))
    reached = rows.agg(F.greatest(F.sum("drawn"), F.lit(1))).scalar()
    report = rows.select("category", "topic", "target_share", "min_rows", "available", "drawn", F.round(F.col("drawn") / reached, 6).alias("share"), "short")
    return sample, report
