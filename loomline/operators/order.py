"""Global row numbers without a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import durable


def row_numbers(df: DataFrame, id_column: str, order: list[Column]) -> DataFrame:
    """(id, number): positions from 1 in the given order, which must be total.

    Rows are range-partitioned and written once (range borders come from a
    sample and must not differ between two readings); each partition is numbered
    by itself and shifted by the counts of those before it.
    """
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.select(F.col(id_column).alias("id"), *(c.alias(n) for c, n in zip(order, names)))
    placed = durable(keyed.repartitionByRange(*names).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    # one row per partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = placed.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*names)))
    return inside.join(F.broadcast(before), "_part").select(F.col("id").alias(id_column), (F.col("_before") + F.col("_at")).alias("number"))
