"""Chat rendering, token arrays, label masks, padding and token statistics.

Everything is array expressions; the tokenizer is a column expression (or any
function from text to an array of ids) that the caller injects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators.order import row_numbers

MAX_LENGTH = 512
IGNORED = -100


def chat_messages(question: str, answer: str | None = None) -> Column:
    """Array of (role, content) of one exchange."""
    messages = [F.struct(F.lit("user").alias("role"), F.coalesce(question, F.lit("")).alias("content"))]
    if answer is not None:
        messages.append(F.struct(F.lit("assistant").alias("role"), F.coalesce(answer, F.lit("")).alias("content")))
    return F.array(*messages)


def render_chat(messages: Column, prompt: bool = False, start: str = "<|", end: str = "|>") -> Column:
    """Text of a conversation; with ``prompt`` it ends where the assistant begins."""
    parts = F.array_join(F.transform(messages, lambda m: F.concat(F.lit(start), m["role"], F.lit(end + " "), m["content"], F.lit(" " + start + "end" + end + " "))), "")
    return F.concat(parts, F.lit(f"{start}assistant{end} ")) if prompt else parts


def blank_tokenizer(text: Column) -> Column:
    """Stand-in tokenizer: blank-separated words, ids from the first six digits of their md5."""
    return F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int"))


def tokenized(df: DataFrame, id_column: str = "record_id", question: str = "question", answer: str = "answer", tokenizer: Callable[[Column], Column] = blank_tokenizer, max_length: int = MAX_LENGTH) -> DataFrame:
    """(rid, input_ids, attention_mask, labels, truncated); labels hide the prompt."""
    full = tokenizer(render_chat(chat_messages(question, answer)))
    start = F.size(tokenizer(render_chat(chat_messages(question), prompt=True)))
    rows = df.select(F.col(id_column).alias("rid"), F.slice(full, 1, max_length).alias("input_ids"), start.alias("start"))
    labels = F.transform("input_ids", lambda x, i: F.when(i < F.col("start"), F.lit(IGNORED)).otherwise(x))
    return rows.select("rid", "input_ids", F.array_repeat(F.lit(1), F.size("input_ids")).alias("attention_mask"), labels.alias("labels"), (F.size("input_ids") >= max_length).alias("truncated"))


def unmasked(examples: DataFrame) -> DataFrame:
    """The same examples with the ids themselves as labels: nothing is hidden."""
    return examples.withColumn("labels", F.col("input_ids"))


def contract_violations(examples: DataFrame) -> DataFrame:
    """(rid, problem): empty arrays or arrays of different lengths."""
    n, m, k = F.size("input_ids"), F.size("attention_mask"), F.size("labels")
    problem = F.when(F.coalesce(n, F.lit(0)) <= 0, "empty").when((n != m) | (n != k), "lengths differ")
    return examples.select("rid", problem.alias("problem")).filter("problem is not null")


def batched(examples: DataFrame, batch_size: int = 4) -> DataFrame:
    """Adds ``batch_id``: consecutive row ids, ``batch_size`` at a time. Row ids are unique."""
    numbers = row_numbers(examples, "rid", [F.col("rid")])
    return examples.join(numbers, "rid").withColumn("batch_id", F.floor((F.col("number") - 1) / batch_size)).drop("number")


def padded(batches: DataFrame, pad_id: int = 0) -> DataFrame:
    """Arrays filled up to the longest of their batch: ids, 0 and the ignored label."""
    longest = F.max(F.size("input_ids")).over(Window.partitionBy("batch_id"))
    rows = batches.withColumn("_fill", longest - F.size("input_ids"))
    fill = lambda column, value: F.concat(column, F.array_repeat(F.lit(value), F.col("_fill")))
    return rows.select("rid", "batch_id", fill("input_ids", pad_id).alias("input_ids"), fill("attention_mask", 0).alias("attention_mask"), fill("labels", IGNORED).alias("labels"))


def batch_inspection(padded_batches: DataFrame) -> DataFrame:
    """(batch_id, real, padding, ignored, trainable) positions."""
    size = F.size("input_ids")
    real = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    trainable = F.size(F.filter("labels", lambda x: x != IGNORED))
    return padded_batches.groupBy("batch_id").agg(F.sum(real).alias("real"), F.sum(size - real).alias("padding"), F.sum(size - trainable).alias("ignored"), F.sum(trainable).alias("trainable"))


def positions(examples: DataFrame) -> DataFrame:
    """(rid, position, token_id, label): one row per position."""
    return examples.select("rid", F.posexplode(F.arrays_zip("input_ids", "labels")).alias("position", "pair")).select("rid", "position", F.col("pair.input_ids").alias("token_id"), F.col("pair.labels").alias("label"))


def token_length_stats(lengths: DataFrame, column: str = "n") -> DataFrame:
    """One row: n, least, greatest, mean, median and nearest-rank percentiles ``sorted[int(p * n) - 1]``.

    Works on counts per length, which are as many as there are different lengths.
    """
    counts = lengths.groupBy(column).agg(F.count("*").alias("c"))
    up_to = counts.withColumn("cum", F.sum("c").over(Window.orderBy(column)))
    total = counts.agg(F.sum("c").alias("total")).scalar()
    at = lambda position: F.min(F.when(F.col("cum") >= position, F.col(column)))
    total_col = F.col("total")
    place = lambda p: F.when(F.floor(total_col * p) < 1, total_col).otherwise(F.floor(total_col * p))
    return (
        up_to.withColumn("total", total)
        .groupBy("total")
        .agg(
            F.min(column).alias("least"),
            F.max(column).alias("greatest"),
            F.round(F.sum(F.col(column) * F.col("c")) / F.first("total"), 4).alias("mean"),
            ((at(F.floor((total_col + 1) / 2)) + at(F.floor((total_col + 2) / 2))) / 2.0).alias("median"),
            *(at(place(p)).alias(f"p{int(p * 100)}") for p in (0.90, 0.95, 0.99)),
        )
        .withColumnRenamed("total", "n")
    )


def truncation_sweep(lengths: DataFrame, column: str = "n", limits: tuple[int, ...] = (256, 384, 512, 1024)) -> DataFrame:
    """(max_length, truncated, percent): rows longer than each limit."""
    row = lengths.agg(F.count("*").alias("total"), *(F.count_if(F.col(column) > x).alias(f"over_{x}") for x in limits))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("max_length"), F.col(f"over_{x}").alias("truncated")) for x in limits)))
    return row.select("total", each.alias("x")).select("x.max_length", "x.truncated", F.round(100 * F.col("x.truncated") / F.greatest(F.col("total"), F.lit(1)), 4).alias("percent"))


def longest_under(lengths: DataFrame, cap: int, column: str = "n") -> DataFrame:
    """The longest row within the cap; ties go to the first (a top-1 report)."""
    return lengths.filter(F.col(column) <= cap).orderBy(F.desc(column), "rid").limit(1)


def weighted_loss(losses: DataFrame) -> DataFrame:
    """One row of (loss, tokens): token-weighted mean, plain mean, perplexity; empty rows skipped."""
    some = losses.filter("tokens > 0")
    means = some.agg((F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")).alias("weighted"), F.avg("loss").alias("plain"), F.sum("tokens").alias("tokens"))
    return means.select(F.round("weighted", 6).alias("weighted_loss"), F.round("plain", 6).alias("mean_loss"), "tokens", F.when(F.col("weighted") < 50, F.round(F.exp("weighted"), 4)).alias("perplexity"))


def run_counters(examples: DataFrame) -> DataFrame:
    """One row: examples, truncated ones, tokens, trained tokens, examples without any."""
    n, trained = F.size("input_ids"), F.size(F.filter("labels", lambda x: x != IGNORED))
    return examples.agg(F.count("*").alias("examples"), F.count_if(F.col("truncated")).alias("truncated"), F.coalesce(F.sum(n), F.lit(0)).alias("tokens"), F.coalesce(F.sum(trained), F.lit(0)).alias("trained"), F.count_if(trained == 0).alias("untrained"))


def trained_positions(labels: str = "labels") -> Column:
    """Labels that count after the shift by one."""
    return F.size(F.filter(F.slice(labels, 2, 1 << 30), lambda x: x != IGNORED))


def schedule(examples: Column, accumulation: int = 8, epochs: int = 2, warm_up: float = 0.03) -> Column:
    """(updates per epoch, updates, warm-up updates)."""
    per_epoch = F.ceil(examples / accumulation)
    return F.struct(per_epoch.alias("updates_per_epoch"), (per_epoch * epochs).alias("updates"), F.floor(per_epoch * epochs * F.lit(warm_up)).alias("warm_up_updates"))


def generated(df: DataFrame, model: Callable[[], Callable[[list[str]], list[str]]], prompt: str, output: str = "generated") -> DataFrame:
    """Adds a model's text per row. ``model`` is called once per task and returns a batch function."""
    from pyspark.sql.types import StringType, StructField, StructType

    schema = StructType([*df.schema.fields, StructField(output, StringType())])

    def run(batches):
        answer = model()
        for pdf in batches:
            yield pdf.assign(**{output: answer(pdf[prompt].fillna("").tolist())})

    return df.mapInPandas(run, schema)
