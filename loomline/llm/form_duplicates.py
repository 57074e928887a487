"""Duplicates hidden by formatting differences (problem 6).

1. Every text is canonicalised once; ids and 128-bit digests of the keys are
   kept (``durable``), texts are not read again.
2. Bloom filters of keys seen once and seen again are built per partition and
   merged (``bloom``). The filter is sharded by the hash of the key: a shard is
   at most ``bloom.MAX_LOG_BITS`` large and there are as many shards as the rows
   need at ``BITS_PER_ROW``, so the share of false repeats is the same at every
   size. Shards are built, used and dropped one after the other, each over its
   own keys; no worker holds more than one.
3. Rows whose key is not in the "repeated" filter are singletons and never
   shuffled. Only possible repeats go through an exact grouping on the digest
   (pre-aggregated map-side, so a key that holds a third of all rows is no hot
   task).

Defined results: null, empty or mark-only texts have no key and are left out;
an empty table gives an empty result; ties have one outcome because the group
id is the smallest record id; other columns of the input are never touched, so
clashing names do no harm; texts of any length are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import bloom
from loomline.llm.keys import form_key, key_digest
from loomline.session import durable

#: Two positions a key: with 12 bits, 2.4 % of the distinct keys are taken for possible repeats.
BITS_PER_ROW = 12


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [form_key(text) for text in batch.column(1).to_pylist()]
        digests = [key_digest(k) if k else None for k in keys]
        codes = [int.from_bytes(d[:8], "little", signed=True) if d else None for d in digests]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(codes, pa.int64())], names=["record_id", "key", "code"])


def _marked(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            maybe = bloom.contains(bits, batch.column(2).to_numpy(zero_copy_only=False)) if len(batch) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maybe)], names=["record_id", "key", "maybe"])

    return run


def _with_marks(df: DataFrame, id_column: str, text_column: str, repeats_only: bool, max_log_bits: int) -> DataFrame:
    """(record_id, key, maybe): whether the key may be a repeat."""
    context = df.sparkSession.sparkContext
    pairs = df.select(F.col(id_column).cast("bigint").alias("record_id"), F.col(text_column).cast("string").alias("text"))
    # ids and digests, no texts
    keyed = durable(pairs.mapInArrow(_keyed, "record_id bigint, key binary, code bigint").filter("key is not null"))
    rows = keyed.count()
    shards = max(1, -(-rows * BITS_PER_ROW // (1 << max_log_bits)))
    result = None
    for shard in range(shards):
        own = keyed if shards == 1 else keyed.filter(F.pmod(F.xxhash64("key"), F.lit(shards)) == shard)
        bits = bloom.merged_filter(own, "code", min(max_log_bits, bloom.log_bits_for(-(-rows // shards), BITS_PER_ROW)), "repeated")
        shared = context.broadcast(bits)
        part = own.mapInArrow(_marked(shared), "record_id bigint, key binary, maybe boolean")
        if repeats_only:
            part = part.filter("maybe")
        if repeats_only or shards > 1:
            part = durable(part)
            shared.unpersist()
        result = part if result is None else result.unionByName(part)
    return result


def form_groups(df: DataFrame, id_column: str = "record_id", text_column: str = "question", max_log_bits: int = bloom.MAX_LOG_BITS) -> DataFrame:
    """(record_id, group_id) of every row whose text another row has in other form."""
    repeats = _with_marks(df, id_column, text_column, True, max_log_bits).select("record_id", "key")
    groups = repeats.groupBy("key").agg(F.min("record_id").alias("group_id"), F.count("*").alias("copies")).filter("copies > 1")
    return repeats.join(groups, "key").select("record_id", "group_id")


def collapse_forms(df: DataFrame, id_column: str = "record_id", text_column: str = "question", max_log_bits: int = bloom.MAX_LOG_BITS) -> DataFrame:
    """One row per distinct text: (record_id of the first copy, copies)."""
    marked = _with_marks(df, id_column, text_column, False, max_log_bits)
    repeats = marked.filter("maybe").groupBy("key").agg(F.min("record_id").alias("record_id"), F.count("*").alias("copies")).drop("key")
    singles = marked.filter("not maybe").select("record_id", F.lit(1).cast("bigint").alias("copies"))
    return singles.unionByName(repeats)
