"""First-wins deduplication, drop reasons and duplicate statistics.

The winner is the smallest row id of a key, found by a hash aggregation
(partial sums before the shuffle) instead of a window: a key shared by a third
of all rows then costs one row per map task, not one giant window partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import clean_text, key_marks_to_blanks, key_without_marks

LEAST_ANSWER = 30


def first_wins(df: DataFrame, key: Column, order: str | Column, drop_empty: bool = True) -> DataFrame:
    """(key, rid): the first row of every key."""
    keyed = df.select(key.alias("key"), (F.col(order) if isinstance(order, str) else order).alias("rid"))
    return (keyed.filter("key <> ''") if drop_empty else keyed).groupBy("key").agg(F.min("rid").alias("rid"))


def drop_reason(question: str, answer: str, least: int = LEAST_ANSWER) -> Column:
    """First reason to drop a row, null if it stays (duplicates are judged later)."""
    q, a = clean_text(question), clean_text(answer)
    return F.when(q == "", "missing question").when(a == "", "missing answer").when(F.length(a) < least, "short answer")


def drop_reasons(df: DataFrame, id_column: str = "record_id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(reason, records), each row in the first bucket that fits."""
    rows = df.select(F.col(id_column).alias("rid"), drop_reason(question, answer).alias("reason"), key_without_marks(question).alias("key"))
    dropped = rows.filter("reason is not null").groupBy("reason").agg(F.count("*").alias("records"))
    left = rows.filter("reason is null")
    # an empty key is a key like any other: its first row stays
    kept = left.agg(F.count("*").alias("n"), F.count_distinct(F.md5("key")).alias("kept"))
    ends = kept.select(F.explode(F.array(F.struct(F.lit("kept").alias("reason"), F.col("kept").alias("records")), F.struct(F.lit("duplicate").alias("reason"), (F.col("n") - F.col("kept")).alias("records")))).alias("x")).select("x.*")
    return dropped.unionByName(ends).filter("records > 0")


def deduplicated(df: DataFrame, id_column: str = "record_id", question: str = "question", answer: str = "answer") -> DataFrame:
    """(rid, key) of kept rows: filters first, then the first row of every N1 key, the empty one included."""
    kept = df.filter(drop_reason(question, answer).isNull())
    return first_wins(kept, key_without_marks(question), id_column, drop_empty=False).select("rid", "key")


def merged_first_wins(frames: list[DataFrame], id_column: str = "record_id", question: str = "question") -> DataFrame:
    """(file, rid, key): first row per N2 key over frames in their order; empty keys dropped."""
    union = None
    for position, df in enumerate(frames):
        part = df.select(F.struct(F.lit(position).alias("file"), F.col(id_column).alias("rid")).alias("place"), question)
        union = part if union is None else union.unionByName(part)
    winners = first_wins(union, key_marks_to_blanks(question), "place")
    return winners.select("rid.file", "rid.rid", "key")


def duplicate_stats(df: DataFrame, key: Column, source: str = "source") -> DataFrame:
    """One row: distinct keys, keys met again, surplus rows, keys met in several sources."""
    keyed = df.select(key.alias("key"), F.coalesce(source, F.lit("")).alias("source")).filter("key <> ''")
    groups = keyed.groupBy("key", "source").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("sources"))
    return groups.agg(F.count("*").alias("unique_keys"), F.count_if(F.col("n") > 1).alias("repeated_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("surplus_rows"), F.count_if(F.col("sources") > 1).alias("keys_in_sources"))


def top_duplicates(df: DataFrame, key: Column, n: int = 20) -> DataFrame:
    """(key, copies) of the keys met most often (a top-k report)."""
    return df.select(key.alias("key")).filter("key <> ''").groupBy("key").agg(F.count("*").alias("copies")).filter("copies > 1").orderBy(F.desc("copies"), "key").limit(n)


def exact_groups(df: DataFrame, key: Column, id_column: str = "record_id") -> DataFrame:
    """(rid, group_id, size) of all rows whose key another row has.

    One row per member instead of lists: a key shared by a third of all rows
    would make one list of them.
    """
    keyed = df.select(key.alias("key"), F.col(id_column).alias("rid")).filter("key <> ''").select(F.md5("key").alias("key"), "rid")
    groups = keyed.groupBy("key").agg(F.min("rid").alias("group_id"), F.count("*").alias("size")).filter("size > 1")
    return keyed.join(groups, "key").select("rid", "group_id", "size")
