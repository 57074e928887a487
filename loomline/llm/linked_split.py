"""Splits that keep related records together (problem 3).

Groups: records are linked by an equal canonical question or by naming the same
entity. Records are first reduced to distinct questions, questions to the
smallest entity they name, so the iterative part (``components``) runs only
over entity-entity links of questions that name several.

Placement: grouped iterative stratification. Label vectors (records per
category) are summed per component. Components that hold more than a
thousandth of all records (at most a thousand of them) are placed first, against
the global targets; the others are hashed into shards of about ``SHARD``
components, each placed by one task against integer quotas that add up to what
is still open of every label: the rarest outstanding label first, into the split
that needs it most.

Defined results: a record without key and without entity is its own group; rows
without an id are left out; repeated rows of one id are one record of the split
(with its smallest label) and are each listed by ``record_groups``; a null or
blank category counts as one label of its own; of more than ``max_labels``
labels (a parameter) the most frequent are balanced one by one and the others
together as one; empty tables give empty results;
equal needs are broken by the order of the targets; other columns are never
read. Targets are normalised to sum to one (all zero: equal shares); no target
at all is an error. Texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import bloom
from loomline.llm.keys import form_key, key_digest, word_code, words
from loomline.operators.components import connected_components
from loomline.session import durable

SHARD = 20_000
BIG_SHARE = 1000
#: Most labels that are balanced one by one (the driver holds a count of each).
MAX_LABELS = 10_000
POOLED = "(other labels)"
_CODE = re.compile(r"cs(\d{7})")
_SEVEN = re.compile(r"\d{7}")


def _entity_tokens(code_and_name: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in code_and_name:
        ids, tokens = [], []
        for entity, code, name in zip(*(c.to_pylist() for c in batch.columns)):
            found = set(words(name)[:1]) | set(_SEVEN.findall(code or ""))
            ids += [entity] * len(found)
            tokens += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.string()), pa.array([word_code(t) for t in tokens], pa.int64())], names=["entity", "token", "code"])


def entity_tokens(entities: DataFrame, id_column: str = "case_id", code_column: str = "case_code", name_column: str = "name") -> DataFrame:
    """(entity, token, code): the words by which each entity may be named."""
    return entities.select(F.col(id_column).cast("bigint"), F.col(code_column).cast("string"), F.col(name_column).cast("string")).mapInArrow(_entity_tokens, "entity bigint, token string, code bigint")


def _without_invisible(text: str) -> str:
    return "".join(c for c in text if unicodedata.category(c) != "Cf")


def name_candidates(text: str | None) -> set[str]:
    """Words of a text that could name an entity; ``cs0000012`` also gives its digits."""
    if text is None:
        return set()
    found = set(words(text))
    if not text.isascii():
        found.update(words(_without_invisible(text)))
    if "cs" in text or "CS" in text or "Cs" in text or "cS" in text:
        found.update(m[1] for m in map(_CODE.fullmatch, list(found)) if m)
    return found


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = shared.value, {}
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [name_candidates(t) for t in texts]
            new = list(set().union(*found) - known.keys()) if found else []
            if len(known) > 1_000_000:
                known.clear()
                new = list(set().union(*found))
            if new:
                known.update(zip(new, bloom.contains(bits, np.array([word_code(w) for w in new], np.int64)).tolist()))
            keys = [form_key(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([key_digest(k) if k else None for k in keys], pa.binary()),
                    pa.array([[w for w in f if known[w]] or None for f in found], pa.list_(pa.string())),
                ],
                names=["record_id", "key", "tokens"],
            )

    return run


def record_groups(records: DataFrame, entities: DataFrame, id_column: str = "record_id", text_column: str = "question") -> DataFrame:
    """(record_id, group_id, size) of every record; group_id is the smallest id of its group."""
    tokens = durable(entity_tokens(entities).filter("entity is not null"))
    bits = bloom.merged_filter(tokens, "code", bloom.log_bits_for(tokens.count()), "seen")
    shared = records.sparkSession.sparkContext.broadcast(bits)
    rows = records.select(F.col(id_column).cast("bigint").alias("record_id"), F.col(text_column).cast("string").alias("text")).filter("record_id is not null")
    # id, digest and the few words that may be names: a small part of the input
    marked = durable(rows.mapInArrow(_scan(shared), "record_id bigint, key binary, tokens array<string>"))

    texts = (
        marked.filter("key is not null")
        .groupBy("key")
        .agg(F.min("record_id").alias("first_id"), F.count("*").alias("n"), F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("tokens"))
    )
    texts = durable(texts)
    named = texts.select("first_id", F.explode("tokens").alias("token")).join(tokens.select("token", "entity"), "token").select("first_id", "entity").distinct()
    # as many entities as one text names: bounded by the text
    named = durable(named.groupBy("first_id").agg(F.min("entity").alias("anchor"), F.collect_set("entity").alias("all")))
    links = named.filter(F.size("all") > 1).select("anchor", F.explode("all").alias("entity")).filter("anchor <> entity").distinct()
    parts = connected_components(links, "anchor", "entity").withColumnRenamed("node", "anchor")
    anchored = named.select("first_id", "anchor").join(parts, "anchor", "left").select("first_id", F.coalesce("component", "anchor").alias("anchor"))
    texts = durable(texts.select("key", "first_id", "n").join(anchored, "first_id", "left"))

    whole = texts.filter("anchor is not null").groupBy("anchor").agg(F.min("first_id").alias("group_id"), F.sum("n").alias("size"))
    by_key = texts.filter("anchor is not null").join(whole, "anchor").select("key", "group_id", "size").unionByName(texts.filter("anchor is null").select("key", F.col("first_id").alias("group_id"), F.col("n").alias("size")))
    shared_keys = by_key.filter("size > 1")
    rows = marked.select("record_id", "key")
    joined = rows.filter("key is not null").join(shared_keys, "key", "left").select("record_id", F.coalesce("group_id", "record_id").alias("group_id"), F.coalesce("size", F.lit(1)).alias("size"))
    # records without key stand alone and take no part in the shuffle
    return joined.unionByName(rows.filter("key is null").select("record_id", F.col("record_id").alias("group_id"), F.lit(1).cast("bigint").alias("size")))


def linked_records(records: DataFrame, entities: DataFrame) -> DataFrame:
    """(record_id, group_id) of the records in groups of two or more."""
    return record_groups(records, entities).filter("size > 1").select("record_id", "group_id")


def place(vectors: list[tuple[object, dict[str, int]]], wanted: np.ndarray, labels: list[str]) -> dict[object, int]:
    """Iterative stratification of components onto splits.

    ``wanted[s, l]`` is the number of records of label ``l`` that split ``s``
    still needs; it is reduced in place. Of the labels with components left,
    the one with the fewest records goes first; its components go, larger ones
    first, to the split with the greatest need of that label, then of all
    labels, then to the earlier split.
    """
    index = {label: k for k, label in enumerate(labels)}
    having: dict[int, list[int]] = defaultdict(list)
    left = np.zeros(len(labels))
    sizes = []
    for i, (_, vector) in enumerate(vectors):
        sizes.append(sum(vector.values()))
        for label, n in vector.items():
            having[index[label]].append(i)
            left[index[label]] += n
    need, total, placed = wanted.tolist(), wanted.sum(axis=1).tolist(), {}
    for k in having:
        having[k].sort(key=lambda i: (-sizes[i], str(vectors[i][0])))
    outstanding = set(having)
    while outstanding:
        label = min(outstanding, key=lambda k: (left[k], labels[k]))
        outstanding.remove(label)
        for i in having[label]:
            name, vector = vectors[i]
            if name in placed:
                continue
            split = max(range(len(need)), key=lambda s: (need[s][label], total[s], -s))
            placed[name] = split
            for other, n in vector.items():
                need[split][index[other]] -= n
                left[index[other]] -= n
            total[split] -= sizes[i]
    wanted[:] = need
    return placed


def apportion(counts: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Integer quotas ``[s, l]`` of ``counts[l]`` records by largest remainders.

    Rarest label first; equal remainders go to the split that is furthest below
    its share of all labels so far, then to the earlier one.
    """
    exact = shares * counts
    quotas = np.floor(exact + 1e-9).astype(np.int64)
    behind = np.zeros(len(shares))
    for k in np.argsort(counts, kind="stable"):
        rest = np.round(exact[:, k] - quotas[:, k], 9)
        order = sorted(range(len(shares)), key=lambda s: (-rest[s], -round(behind[s], 9), s))
        for i in range(int(counts[k] - quotas[:, k].sum())):
            quotas[order[i % len(order)], k] += 1
        behind += exact[:, k] - quotas[:, k]
    return quotas


def spread(quotas: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``[shard, split]``: the quotas of one label over shards that hold ``counts`` of it; both sums are exact."""
    total = counts.sum()
    shared = counts[:, None] * quotas[None, :] // max(1, total)
    # less than a record per split and shard is left: dealt in turn, each split evenly over the shards
    left = quotas - shared.sum(axis=0)
    places = np.concatenate([(np.arange(n) + 0.5) / n for n in left if n] or [np.zeros(0)])
    turns = np.repeat(np.arange(len(quotas)), left)[np.argsort(places, kind="stable")]
    np.add.at(shared, (np.repeat(np.arange(len(counts)), counts - shared.sum(axis=1)), turns), 1)
    return shared


def stratified_group_split(groups: DataFrame, records: DataFrame, targets: list[tuple[str, float]], id_column: str = "record_id", label_column: str = "category", max_labels: int = MAX_LABELS) -> DataFrame:
    """(record_id, group_id, label, split) with no group in two splits.

    ``groups`` has (record_id, group_id, size) of every record, as from
    ``record_groups``; ``targets`` has (split, share).
    """
    if not targets:
        raise ValueError("no split to assign to")
    names = [name for name, _ in targets]
    shares = np.array([max(0.0, share or 0.0) for _, share in targets])
    shares = shares / shares.sum() if shares.sum() else np.full(len(names), 1 / len(names))
    labelled = records.select(F.col(id_column).cast("bigint").alias("record_id"), F.coalesce(F.trim(F.col(label_column).cast("string")), F.lit("")).alias("label"))
    # one row per id, whatever is repeated
    labelled = labelled.groupBy("record_id").agg(F.min("label").alias("label"))
    rows = durable(groups.groupBy("record_id").agg(F.min("group_id").alias("group_id")).join(labelled, "record_id"))
    per_label = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(max_labels).toLocalIterator()}
    beyond = rows.count() - sum(per_label.values())
    if beyond:
        # labels beyond the most frequent are balanced as one
        per_label[POOLED] = per_label.get(POOLED, 0) + beyond
    balanced = F.when(F.col("label").isin(list(per_label)), F.col("label")).otherwise(POOLED) if beyond else F.col("label")
    counts = rows.groupBy("group_id", balanced.alias("label")).agg(F.count("*").alias("n"))
    vectors = durable(counts.groupBy("group_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("vector"), F.sum("n").alias("size")))
    labels = sorted(per_label)
    n_rows, n_groups = sum(per_label.values()), vectors.count()
    wanted = np.outer(shares, [per_label[x] for x in labels]) if labels else np.zeros((len(names), 0))

    # fewer than BIG_SHARE groups can hold more than one BIG_SHAREth of the rows
    floor = max(1, n_rows // BIG_SHARE)
    big = [(r["group_id"], r["vector"]) for r in vectors.filter(F.col("size") > floor).toLocalIterator()]
    placed_big = place(big, wanted, labels)
    open_needs = np.maximum(wanted, 0)
    open_share = open_needs / np.maximum(open_needs.sum(axis=0), 1e-9)
    shards = max(1, -(-n_groups // SHARD))

    small = vectors.filter(F.col("size") <= floor).withColumn("shard", F.pmod(F.xxhash64("group_id"), F.lit(shards)))
    held = small.select("shard", F.explode("vector").alias("label", "n")).groupBy("label", "shard").agg(F.sum("n").alias("n"))
    small_counts = {r["label"]: r["n"] for r in held.groupBy("label").agg(F.sum("n").alias("n")).toLocalIterator()}
    quotas = apportion(np.array([small_counts.get(x, 0) for x in labels], np.int64), open_share) if shards > 1 else None

    def deal(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        dealt = spread(quotas[:, labels.index(key[0])], pdf["n"].to_numpy(np.int64))
        return pd.DataFrame({"shard": pdf["shard"].to_numpy(), "label": key[0], "quotas": dealt.tolist()})

    def placed_against(own: list, here: np.ndarray) -> pd.DataFrame:
        placed = place(own, here, labels)
        return pd.DataFrame({"group_id": list(placed), "split": [names[s] for s in placed.values()]})

    def place_all(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = [(int(g), dict(v)) for g, v in zip(pdf["group_id"], pdf["vector"])]
        here = np.array([small_counts.get(x, 0) for x in labels], float)
        return placed_against(own, open_share * here)

    def place_shard(key: tuple, pdf: pd.DataFrame, dealt: pd.DataFrame) -> pd.DataFrame:
        own = [(int(g), dict(v)) for g, v in zip(pdf["group_id"], pdf["vector"])]
        here = np.zeros((len(names), len(labels)))
        for label, own_quotas in zip(dealt["label"], dealt["quotas"]):
            here[:, labels.index(label)] = own_quotas
        return placed_against(own, here)

    if shards > 1:
        # a row per shard and label
        by_label = held.groupBy("label").applyInPandas(deal, "shard bigint, label string, quotas array<bigint>")
        assigned = small.groupBy("shard").cogroup(by_label.groupBy("shard")).applyInPandas(place_shard, "group_id bigint, split string")
    else:
        assigned = small.groupBy("shard").applyInPandas(place_all, "group_id bigint, split string")
    if placed_big:
        assigned = assigned.unionByName(records.sparkSession.createDataFrame([(int(g), names[s]) for g, s in placed_big.items()], "group_id bigint, split string"))
    return rows.join(assigned, "group_id").select("record_id", "group_id", "label", "split")


def split_report(assigned: DataFrame) -> DataFrame:
    """(split, label, records, share): share of each label that each split received."""
    counts = assigned.groupBy("split", "label").agg(F.count("*").alias("records"))
    totals = counts.groupBy("label").agg(F.sum("records").alias("all_records"))
    return counts.join(totals, "label").select("split", "label", "records", F.round(F.col("records") / F.col("all_records"), 6).alias("share"))
