"""Session helpers shared by all operators: table access and durable checkpoints."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (one file or a folder of parts)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of checkpoints: the one the cluster names in ``spark.checkpoint.dir``.

    Only a local session (tests, a laptop) may leave that setting out; it gets a
    folder below the SQL warehouse. On a cluster a missing setting is an error,
    because no other folder is known to be shared.
    """
    context = spark.sparkContext
    set_already = context._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    named = context.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse")
        named = os.path.join(warehouse, "_checkpoints")
    context.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{ensure_checkpoint_dir(spark)}/scratch-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage.

    The files survive the loss of any executor. Used only for tables that are
    read more than once and are narrow (ids, hashes, small counts).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
