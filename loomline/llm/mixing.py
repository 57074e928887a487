"""Mixing sources to target weights (problem 9).

Per source: complete epochs first, then a fractional selection by
Efraimidis-Spirakis sampling. Every document draws an exponential key
``-ln(u) / weight`` (u from a hash of seed and id, weight from its quality);
documents are taken in key order until their tokens fill what the epochs left
open. Keys are binned by their logarithm: whatever the weights, a bin holds at
most 1 / (e * ``BINS_PER_UNIT``) of a source (the greatest density of the
logarithm of an exponential variable is 1 / e, and weights only shift it).
Token sums per source and bin give the bin in which the budget ends, and only
that bin is ranked, so neither a source that holds a third of all documents nor
one of poor documents is a hot task.

The mix is due as many tokens as all documents have. What a source cannot give
stays empty; the report says how much of the wanted size was reached.

Defined results: null sources and sources without weight are never drawn; a
null or negative target counts as 0; null or empty texts have 0 tokens and are
not repeated; equal keys are ordered by id; a source listed twice is one with
the sum of its shares; repeated documents are drawn each; empty tables give an
empty mix; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.llm.tokens import TOKENIZER, token_counts
from loomline.session import durable

#: Bins per unit of the logarithm of a key.
BINS_PER_UNIT = 1024


def document_tokens(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens, quality): quality in (0, 1] by length and share of letters."""
    letters = F.length(F.regexp_replace(F.col("text").cast("string"), r"[^\p{L}]+", ""))
    length = F.length(F.col("text").cast("string"))
    quality = F.when(length > 0, F.greatest(F.lit(0.05), letters / length * F.least(F.lit(1.0), length / 500))).otherwise(0.05)
    with_quality = documents.select("doc_id", "text", "source", F.round(quality, 6).cast("string").alias("quality"))
    counted = token_counts(with_quality, "doc_id", ["text"], None, ["source", "quality"], path)
    return counted.select("doc_id", "source", F.col("text_tokens").alias("tokens"), F.col("quality").cast("double").alias("quality"))


def source_budgets(counted: DataFrame, weights: DataFrame) -> DataFrame:
    """Per weighted source: tokens it has, tokens due, epochs and what they leave open.

    The mix is due as many tokens as all documents together have.
    """
    # one row per source; read twice
    have = durable(counted.groupBy("source").agg(F.sum("tokens").alias("tokens")))
    total = have.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).scalar()
    share, repeats = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))
    wanted = weights.filter("source is not null").groupBy("source").agg(F.sum(share).alias("target_share"), F.max(repeats).alias("max_repeats"))
    return (
        wanted.join(have, "source", "left")
        .select("source", "target_share", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.col("target_share") * total).alias("due"))
        .withColumn("epochs", F.when(F.col("tokens") > 0, F.least(F.col("max_repeats"), F.floor(F.col("due") / F.col("tokens")))).otherwise(0).cast("int"))
        .withColumn("open", F.when(F.col("epochs") < F.col("max_repeats"), F.col("due") - F.col("epochs") * F.col("tokens")).otherwise(0.0))
    )


def mix_sources(counted: DataFrame, weights: DataFrame, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(mix, report).

    mix: (doc_id, source, tokens, repeats), how often each document is used, at
    least once. report: a row per weighted source with the share and size that
    were wanted and reached, and ``short`` where a source was used up before it.
    """
    # ids, counts and weights: the texts are tokenised once
    counted = durable(counted)
    budgets = durable(source_budgets(counted, weights))
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    keyed = counted.join(budgets.select("source", "epochs", "open"), "source").filter("tokens > 0").withColumn("key", -F.log(u) / F.col("quality"))
    keyed = keyed.withColumn("bin", F.floor(F.log("key") * BINS_PER_UNIT).cast("int"))
    sums = keyed.groupBy("source", "bin").agg(F.sum("tokens").alias("bin_tokens"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    # a row per source and bin: some thousands for each weighted source, whatever it holds
    sums = sums.withColumn("before", F.coalesce(F.sum("bin_tokens").over(before), F.lit(0)))
    placed = keyed.join(sums, ["source", "bin"])
    whole = placed.filter(F.col("before") + F.col("bin_tokens") <= F.col("open")).withColumn("extra", F.lit(1))
    beyond = placed.filter(F.col("before") >= F.col("open")).withColumn("extra", F.lit(0))
    edge = placed.filter((F.col("before") < F.col("open")) & (F.col("before") + F.col("bin_tokens") > F.col("open")))
    running = F.sum("tokens").over(Window.partitionBy("source", "bin").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    # a document is drawn if more than half of it still fits
    edge = edge.withColumn("extra", (F.col("before") + running - F.col("tokens") / 2 <= F.col("open")).cast("int"))
    chosen = whole.unionByName(beyond).unionByName(edge)
    mix = chosen.select("doc_id", "source", "tokens", (F.col("epochs") + F.col("extra")).alias("repeats")).filter("repeats > 0")
    return mix, mix_report(mix, budgets)


def mix_report(mix: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per weighted source: target_share, share, documents, tokens wanted, drawn and missing, most_repeats, short.

    ``share`` is that of the mix as it came out, ``share_of_wanted`` that of the
    size wanted: they differ by what short sources left empty.
    """
    used = mix.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("drawn"), F.max("repeats").alias("most_repeats"))
    rows = budgets.join(used, "source", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    # a row per weighted source
    rows = durable(rows)
    reached, wanted = rows.agg(F.sum("drawn")).scalar(), rows.agg(F.sum("due")).scalar()
    # used up: every document as often as allowed
    short = (F.col("drawn") < F.col("due")) & (F.col("drawn") == F.col("tokens") * F.col("max_repeats"))
    return rows.select(
        "source", "target_share", F.round(F.col("drawn") / reached, 6).alias("share"), F.round(F.col("drawn") / wanted, 6).alias("share_of_wanted"), F.coalesce("documents", F.lit(0)).alias("documents"),
        F.round("due").cast("bigint").alias("wanted"), F.col("drawn").alias("tokens"), F.when(short, F.round(F.col("due") - F.col("drawn"))).otherwise(0).cast("bigint").alias("missing"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), short.alias("short"),
    )
