"""Exact overlaps between splits and anti-selection, as equi-joins on question keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import key_with_marks, key_without_marks


def keyed(df: DataFrame, id_column: str = "record_id", question: str = "question") -> DataFrame:
    """(rid, key) of rows with a non-empty N3 key."""
    return df.select(F.col(id_column).alias("rid"), key_with_marks(question).alias("key")).filter("key <> ''")


def overlap_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id, left_copies, right_copies, pairs) per shared key.

    The ids are the first of each side; ``pairs`` is how many pairs of rows the
    class stands for. Copies are not expanded: one hot key on both sides would
    make a square of them.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        return keyed(df).groupBy("key").agg(F.min("rid").alias(f"{name}_id"), F.count("*").alias(f"{name}_copies"))

    classes = side(left, "left").join(side(right, "right"), "key")
    return classes.select("left_id", "right_id", "left_copies", "right_copies", (F.col("left_copies") * F.col("right_copies")).alias("pairs"))


def overlap_rows(left: DataFrame, right: DataFrame) -> DataFrame:
    """(right_id, left_copies, first_left_id) of every right row whose key the left side has."""
    have = keyed(left).groupBy("key").agg(F.count("*").alias("left_copies"), F.min("rid").alias("first_left_id"))
    return keyed(right).join(have, "key").select(F.col("rid").alias("right_id"), "left_copies", "first_left_id")


def shared_keys(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key) that both sides have."""
    return keyed(left).select("key").intersect(keyed(right).select("key"))


def overlap_summary(parts: dict[str, DataFrame]) -> DataFrame:
    """(left_part, right_part, keys): shared keys of every pair of parts, from one aggregation."""
    rows = None
    for name, df in parts.items():
        part = keyed(df).select("key", F.lit(name).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    # at most one entry per part in each set
    held = rows.groupBy("key").agg(F.collect_set("part").alias("parts")).filter(F.size("parts") > 1)
    pairs = [(a, b) for i, a in enumerate(parts) for b in list(parts)[i + 1 :]]
    found = held.select(F.explode(F.filter(F.array(*(F.struct(F.lit(a).alias("left_part"), F.lit(b).alias("right_part")) for a, b in pairs)), lambda p: F.array_contains(F.col("parts"), p["left_part"]) & F.array_contains(F.col("parts"), p["right_part"]))).alias("pair"))
    counts = found.groupBy("pair").agg(F.count("*").alias("keys")).select("pair.left_part", "pair.right_part", "keys")
    every = rows.sparkSession.createDataFrame(pairs, "left_part string, right_part string")
    return every.join(counts, ["left_part", "right_part"], "left").select("left_part", "right_part", F.coalesce("keys", F.lit(0)).alias("keys"))


def not_selected(df: DataFrame, selected: DataFrame, id_column: str, question: str = "question") -> DataFrame:
    """(rid) of rows whose N1 key no selected row has."""
    rows = df.select(F.col(id_column).alias("rid"), key_without_marks(question).alias("key"))
    return rows.join(selected.select(key_without_marks(question).alias("key")).distinct(), "key", "left_anti").select("rid")
