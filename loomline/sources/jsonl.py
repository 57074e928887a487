"""JSONL scans and sinks: tolerant with counters, strict with line numbers, guarded writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.functions.text import WHITE

BOM = "﻿"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path (of any Hadoop file system, globs allowed) has files."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    return found is not None and len(found) > 0


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): every line with its number in its file, from 1.

    Lines are counted per file block, so numbering needs no single task; only
    the number of lines per block (a handful per file) is shuffled.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    blocks = raw.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = raw.join(blocks, ["file", "block"]).withColumn("line", F.col("before") + F.col("at") - F.col("first") + 1)
    text = F.when((F.col("line") == 1) & F.startswith("value", F.lit(BOM)), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    return numbered.select("file", "line", text.alias("text"))


def _trimmed(column: str) -> Column:
    return F.regexp_replace(F.col(column), rf"^{WHITE}|{WHITE}$", "")


def judged(rows: DataFrame, schema: StructType | str) -> DataFrame:
    """Adds ``state`` (blank, invalid, valid) and ``record``; only JSON objects are valid."""
    parsed = F.from_json("text", schema, {"mode": "PERMISSIVE"})
    whole = F.try_parse_json("text")
    is_object = F.coalesce(F.startswith(F.schema_of_variant(whole), F.lit("OBJECT")), F.lit(False))
    state = F.when(_trimmed("text") == "", "blank").when(is_object, "valid").otherwise("invalid")
    return rows.withColumn("state", state).withColumn("record", F.when(F.col("state") == "valid", parsed))


def read_lenient(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of all valid lines, with ``source_file`` and ``source_line``; others are dropped."""
    good = judged(lines(spark, path), schema).filter("state = 'valid'")
    return good.select(F.col("file").alias("source_file"), F.col("line").alias("source_line"), "record.*")


def line_counts(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """(file, total, blank, invalid, valid): what a tolerant scan keeps and drops."""
    rows = judged(lines(spark, path), schema)
    return rows.groupBy("file").agg(F.count("*").alias("total"), *(F.count_if(F.col("state") == s).alias(s) for s in ("blank", "invalid", "valid")))


def read_strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Records of all lines; a missing path, bad JSON or a non-object fails with file and line."""
    if not path_exists(spark, path):
        raise FileNotFoundError(path)
    rows = judged(lines(spark, path), schema).filter("state <> 'blank'")
    message = F.concat(F.lit("bad record in "), F.col("file"), F.lit(" line "), F.col("line").cast("string"))
    checked = F.when(F.col("state") == "invalid", F.raise_error(message).cast("boolean")).otherwise(F.lit(True))
    return rows.filter(checked).select(F.col("file").alias("source_file"), F.col("line").alias("source_line"), "record.*")


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``read_lenient``, but a missing path gives an empty table."""
    if path_exists(spark, path):
        return read_lenient(spark, path, schema)
    return spark.createDataFrame([], f"source_file string, source_line bigint, {schema}")


def read_exactly(spark: SparkSession, path: str, schema: StructType | str, rows: int) -> DataFrame:
    """Strict scan of a file that must hold exactly so many records."""
    df = read_strict(spark, path, schema)
    found = df.count()
    if found != rows:
        raise ValueError(f"{path} holds {found} records, not {rows}")
    return df


def read_union(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Tolerant scan of several files as one table; ``source`` is the file name, ``file`` its position."""
    union = None
    for position, path in enumerate(paths):
        part = read_or_empty(spark, path, schema).withColumn("file", F.lit(position)).withColumn("source", F.element_at(F.split("source_file", "/"), -1))
        union = part if union is None else union.unionByName(part)
    return union


def write_jsonl(df: DataFrame, path: str, partition: str | None = None, overwrite: bool = False) -> None:
    """One JSON object per line, UTF-8; nulls kept. Existing output is an error unless allowed."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false")
    (writer.partitionBy(partition) if partition else writer).json(path)


def write_report(spark: SparkSession, path: str, df: DataFrame, overwrite: bool = False) -> None:
    """A one-row table as one nested JSON document."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first n rows by an order column (a top-k report)."""
    return df.orderBy(order).limit(n)
