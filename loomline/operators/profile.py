"""Distributions, file and quality profiles in single-pass aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions.text import clean_text, distinct_tokens, key_marks_to_blanks

#: Answers that stand for no answer.
PLACEHOLDER_ANSWERS = ("i don't know", "dont know", "no answer", "not available", "n/a", "none", "null", "undefined")


def distribution(df: DataFrame, value: Column, blank_counts: bool = True) -> DataFrame:
    """(value, records, percent): percent of all rows, blanks listed or not."""
    counts = df.select(value.alias("value")).groupBy("value").agg(F.count("*").alias("records"))
    total = counts.agg(F.sum("records").alias("total")).scalar()
    listed = counts if blank_counts else counts.filter("value <> ''")
    return listed.select("value", "records", F.round(100 * F.col("records") / total, 4).alias("percent"))


def distribution_within(df: DataFrame, part: str, value: Column) -> DataFrame:
    """(part, value, records, percent): percent of the part."""
    counts = df.select(F.col(part).alias("part"), value.alias("value")).groupBy("part", "value").agg(F.count("*").alias("records"))
    totals = counts.groupBy("part").agg(F.sum("records").alias("total"))
    return counts.join(totals, "part").select("part", "value", "records", F.round(100 * F.col("records") / F.col("total"), 4).alias("percent"))


def suspicious(answer: str) -> Column:
    """Long but of at most three distinct words, or a placeholder."""
    text = clean_text(answer)
    return ((F.length(text) > 50) & (distinct_tokens(answer) <= 3)) | F.lower(text).isin(*PLACEHOLDER_ANSWERS)


def length_profile(df: DataFrame) -> DataFrame:
    """One row of length buckets and missing metadata of (question, answer, topic, category, level)."""
    q, a = F.length(clean_text("question")), F.length(clean_text("answer"))
    missing = [F.count_if(clean_text(c) == "").alias(f"missing_{c}") for c in ("topic", "category", "level")]
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(q == 0).alias("empty_questions"),
        F.count_if((q > 0) & (q < 10)).alias("short_questions"),
        F.count_if(a == 0).alias("empty_answers"),
        F.count_if((a > 0) & (a < 30)).alias("very_short_answers"),
        F.count_if((a >= 30) & (a < 100)).alias("short_answers"),
        F.count_if((a > 3000) & (a <= 10000)).alias("long_answers"),
        F.count_if(a > 10000).alias("very_long_answers"),
        *missing,
    )


def length_stats(df: DataFrame, column: str) -> DataFrame:
    """One row: average, least and greatest length; 0 on empty input."""
    n = F.length(clean_text(column))
    zero = F.lit(0)
    return df.agg(F.round(F.coalesce(F.avg(n), zero.cast("double")), 4).alias("mean_length"), F.coalesce(F.min(n), zero).alias("min_length"), F.coalesce(F.max(n), zero).alias("max_length"))


def quality_verdict(df: DataFrame) -> DataFrame:
    """One row: issues, total and the verdict at 0, 5 and 10 percent."""
    q, a = clean_text("question"), clean_text("answer")
    key = key_marks_to_blanks("question")
    # count distinct pre-aggregates on the key, so hot questions do no harm
    row = df.agg(
        F.count("*").alias("total"),
        F.count_if(q == "").alias("empty_questions"),
        F.count_if(a == "").alias("empty_answers"),
        F.count_if((a != "") & (F.length(a) < 30)).alias("very_short_answers"),
        F.count_if(suspicious("answer")).alias("suspicious_records"),
        (F.count_if(key != "") - F.count_distinct(F.nullif(key, F.lit("")))).alias("duplicate_records"),
    )
    issues = sum((F.col(c) for c in ("empty_questions", "empty_answers", "very_short_answers", "suspicious_records", "duplicate_records")), F.lit(0))
    verdict = F.when(F.col("issues") == 0, "very clean").when(F.col("issues") < F.col("total") * 0.05, "good").when(F.col("issues") < F.col("total") * 0.10, "some cleaning").otherwise("more cleaning")
    return row.withColumn("issues", issues.cast("bigint")).withColumn("verdict", verdict)


def json_field_frequency(df: DataFrame, column: str) -> DataFrame:
    """(field, records): how many JSON objects have each field; other values count nothing."""
    return df.select(F.explode(F.json_object_keys(column)).alias("field")).groupBy("field").agg(F.count("*").alias("records"))


def file_profile(df: DataFrame, key: Column) -> DataFrame:
    """One row: rows, empty questions and answers, repeated questions, average lengths."""
    q, a = clean_text("question"), clean_text("answer")
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(q == "").alias("empty_questions"),
        F.count_if(a == "").alias("empty_answers"),
        (F.count_if(key != "") - F.count_distinct(F.nullif(key, F.lit("")))).alias("repeated_questions"),
        F.round(F.coalesce(F.avg(F.length(q)), F.lit(0.0)), 4).alias("mean_question"),
        F.round(F.coalesce(F.avg(F.length(a)), F.lit(0.0)), 4).alias("mean_answer"),
    )


def problem_samples(df: DataFrame, n: int = 20, id_column: str = "record_id") -> DataFrame:
    """(rid, problem) of the first n problems in row order (a top-k report)."""
    a = clean_text("answer")
    problems = F.array(F.when((a != "") & (F.length(a) < 30), F.lit("very short answer")), F.when(suspicious("answer"), F.lit("suspicious answer")))
    listed = df.select(F.col(id_column).alias("rid"), F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))
    return listed.orderBy("rid", "problem").limit(n)
