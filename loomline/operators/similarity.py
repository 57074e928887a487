"""Cosine similarity of texts over character n-gram TF-IDF.

Rows are first collapsed to distinct texts (class representative and number of
copies); document frequencies count copies, so weights are those of all rows.
Copies then never meet each other in the join (``near_blocks``), and the result
is pairs between representatives with the copies of both; membership comes from
the exact groups and from ``text_membership``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions.text import key_with_marks
from loomline.operators.near_blocks import EPSILON, GRAMS, MIN_DF, block_pairs


def text_classes(df: DataFrame, id_column: str = "record_id", question: str = "question", least: int = 20) -> DataFrame:
    """(rid, text, copies) of the distinct N3 texts of at least ``least`` characters."""
    # exploded, so that the filter is not pushed below and the key not made again for it
    keyed = df.select(F.col(id_column).alias("rid"), F.explode(F.array(key_with_marks(question))).alias("text")).filter((F.length("text") >= least) & (F.col("text") != ""))
    return keyed.groupBy("text").agg(F.min("rid").alias("rid"), F.count("*").alias("copies")).select("rid", "text", "copies")


def gram_counts(classes: DataFrame) -> DataFrame:
    """(rid, copies, gram, tf) with grams as 64-bit hashes."""
    def of_size(n: int):
        hashed = F.transform(F.sequence(F.lit(1), F.length("text") - (n - 1)), lambda i: F.xxhash64(F.substring(F.col("text"), i, F.lit(n))))
        return F.when(F.length("text") >= n, hashed).otherwise(F.array().cast("array<bigint>"))

    per_size = [of_size(n) for n in GRAMS]
    # a text becomes hundreds of rows: spread them before, by number, which is not coalesced by size
    classes = classes.repartition(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "rid")
    return classes.select("rid", "copies", F.explode(F.concat(*per_size)).alias("gram")).groupBy("rid", "copies", "gram").agg(F.count("*").alias("tf"))


def tfidf_postings(classes: DataFrame) -> DataFrame:
    """(rid, gram, df, w): unit-norm weights; grams of one document are left out."""
    counts = gram_counts(classes)
    total = classes.agg(F.sum("copies").alias("rows")).scalar()
    df = counts.groupBy("gram").agg(F.sum("copies").alias("df")).filter(F.col("df") >= MIN_DF)
    # hash join: the millions of postings need no sort
    weighted = counts.join(df.hint("shuffle_hash"), "gram").withColumn("raw", F.col("tf") * (F.log((1 + total) / (1 + F.col("df"))) + 1))
    # a text's own grams only: bounded by the text
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("rid")))
    return weighted.select("rid", "gram", "df", (F.col("raw") / norm).alias("w"))


def _side(df: DataFrame, least: int, id_column: str = "record_id") -> tuple[DataFrame, int, int]:
    """(classes, rows, characters) of a table."""
    return text_classes(df, id_column, least=least), *df.agg(F.count("*"), F.coalesce(F.sum(F.length("question")), F.lit(0))).first()


def near_pairs(df: DataFrame, threshold: float = 0.9, least: int = 20) -> DataFrame:
    """(a, b, similarity) between representatives of distinct texts, a < b."""
    pairs = block_pairs([_side(df, least)], threshold)
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def cross_pairs(left: DataFrame, right: DataFrame, threshold: float, least: int = 1, id_column: str = "record_id") -> DataFrame:
    """(a, b, similarity, a_copies, b_copies) between representatives of two tables, weights fitted on their union."""
    return block_pairs([_side(left, least, id_column), _side(right, least, id_column)], threshold)


def row_pairs(at_least: float) -> Column:
    """Number of pairs of rows in pairs of texts of at least this similarity: products of the copies."""
    return F.coalesce(F.sum(F.when(F.col("similarity") >= at_least - EPSILON, F.col("a_copies") * F.col("b_copies"))), F.lit(0))


def nearest(pairs: DataFrame, k: int = 5) -> DataFrame:
    """The k most similar partners of every ``b``; ties go to the smaller id."""
    rank = F.row_number().over(Window.partitionBy("b").orderBy(F.desc(F.round("similarity", 9)), "a"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


def threshold_counts(pairs: DataFrame, thresholds: tuple[float, ...] = (0.98, 0.95, 0.90)) -> DataFrame:
    """(threshold, texts, pairs): cumulative counts of pairs of texts and of rows."""
    row = pairs.agg(*(F.count_if(F.col("similarity") >= t - EPSILON).alias(f"t{i}") for i, t in enumerate(thresholds)), *(row_pairs(t).alias(f"p{i}") for i, t in enumerate(thresholds)))
    return row.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("texts"), F.col(f"p{i}").alias("pairs")) for i, t in enumerate(thresholds)))).alias("x")).select("x.*")
