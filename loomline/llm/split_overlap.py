"""Same or near-same records across splits (problem 4).

Aho-Corasick automata over sharded, normalised evaluation passages scan all
training texts.

* Normal form: the distinct words of a question in one global order, that of
  their hashes, so that reordered sentences give the same form. (Hash order also
  mixes frequent with rare words, so questions of one template share few
  neighbours.) In front stand symbols for the form key (letters and digits in
  order), by which exact copies with other word borders are found too.
* Passages: an evaluation question of ``n`` words is cut into pairs of
  neighbouring words. A training question of ``m`` words within the threshold
  differs by at most ``d = (n + m) // 7`` words (threshold 3/4); each differing
  word breaks at most one passage, so at least ``passages - d`` of them occur
  verbatim in its form. That bound prunes the rest; no partner above the
  threshold can be lost.
* Equal evaluation questions are one class, equal training questions one text.
* Routing: if every automaton scanned every training text, the cost would be the
  product of both sides. So only texts are brought together that share a
  signature. Words are ordered by their frequency, rarest first (any one order is
  right; this one makes few meet). Two partners share ``c`` words or more, so the
  ``k`` rarest of these stand among the first ``n - c + k`` words of either: all
  ``k``-subsets of these words are the signatures of a text (``k``: 3, of long
  texts 2 or 1). ``c`` is larger if the partner is the longer one, so there are
  signatures for longer and for shorter partners. The form key is one more. No
  partner is lost. Signatures of the evaluation side go into Bloom filters, merged
  and sharded by signature; those of training texts that no filter holds are
  dropped where they are made. A filter of the rest cuts down the evaluation side,
  and the two rests are joined, without words: a pair goes on if 64-bit maps of
  its words differ in no more bits than partners differ in words.
* The automaton of up to ``EVAL_SHARD`` classes that have met a training text
  is built by the task that scans these texts, and dropped with it.
* The intervals of an evaluation question that matched are merged into its
  coverage; an exact check of the word sets follows.

The result are matches of training records with evaluation classes, and the
membership of the classes; ``expanded_pairs`` makes pairs of records of them,
``overlap_report`` counts without making any.

Defined results: null, empty and mark-only questions match nothing; repeated
rows each take part; empty tables give an empty result; very long questions are
scanned whole; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm import bloom
from loomline.llm.keys import form_key, key_digest, word_code, words
from loomline.session import durable

#: Shared distinct words / all distinct words, as a fraction.
SHARED, OF = 3, 4
EVAL_SHARD = 40_000
#: (most words of the shorter text, words of a signature).
SIGNED = ((40, 3), (100, 2), (1 << 62, 1))
#: Bits of a filter a signature, and most bits of a filter.
BITS_PER_SIGNATURE, FILTER_BITS = 12, 1 << bloom.MAX_LOG_BITS
#: Words whose frequency orders them; the others stand before these, by their codes.
ORDERED = 100_000
#: Signatures made at once.
AT_ONCE = 1 << 20


class Former:
    """Normal forms of texts; remembers the codes of words."""

    def __init__(self):
        self.codes: dict[str, int] = {}

    def form(self, text: str | None) -> tuple[bytes | None, bytes, list[int]]:
        """(digest of the form key, digest of key and words, sorted codes of the distinct words)."""
        own, key = sorted(set(words(text))), form_key(text)
        if len(self.codes) > 1_000_000:
            self.codes.clear()
        for w in own:
            if w not in self.codes:
                self.codes[w] = word_code(w)
        return key_digest(key) if key else None, xxhash.xxh3_128_digest("\0".join([key, *own]).encode("utf-8", "surrogatepass")), sorted({self.codes[w] for w in own})


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    former = Former()
    for batch in batches:
        forms = [former.form(text) for text in batch.column(1).to_pylist()]
        keys, texts, sets = zip(*forms) if forms else ((), (), ())
        # a text without a word has no class
        texts = [t if s else None for t, s in zip(texts, sets)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(batch.column(i) for i in range(2, batch.num_columns)), pa.array(keys, pa.binary()), pa.array(texts, pa.binary()), pa.array(sets, pa.list_(pa.int64()))],
            names=["eval_id", *(f"kept_{i}" for i in range(batch.num_columns - 2)), "key", "text", "words"],
        )


def passages(n: int) -> list[tuple[int, int]]:
    """Borders of the passages of an ``n``-word form: pairs, or single words where pairs are too few."""
    width = 2 if n // 2 > n * (OF - SHARED) // SHARED else 1
    return [(i, i + width) for i in range(0, n - width + 1, width)]


def passages_needed(sizes: np.ndarray, cut: np.ndarray, m: int) -> np.ndarray:
    """Passages of evaluation questions that a partner of ``m`` words must hold.

    sizes: their words, cut: their passages. Impossible sizes need more than there are.
    """
    need = cut - (sizes + m) * (OF - SHARED) // (OF + SHARED)
    possible = (OF * sizes >= SHARED * m) & (OF * m >= SHARED * sizes)
    return np.where(possible, np.maximum(need, 1), 1 << 30)


def merged_length(intervals: list[tuple[int, int]]) -> int:
    """Words that the intervals cover together."""
    total = reach = 0
    for start, end in sorted(intervals):
        total += max(0, end - max(start, reach))
        reach = max(reach, end)
    return total


class EvaluationShard:
    """Automaton over the passages of evaluation classes."""

    def __init__(self, classes: list[tuple[bytes, bytes | None, list[int]]]):
        """classes: (text digest, key digest, sorted codes of the distinct words)."""
        self.texts, self.keys, self.own = zip(*classes)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        postings: list[list[int]] = []
        # of each class, the numbers of its passages in order
        self.numbers = [[self._number(tuple(c & 0xFFFFFFFF for c in form[a:b]), e, postings) for a, b in passages(len(form))] for e, form in enumerate(self.own)]
        #: Passages from here on are keys of whole texts.
        self.n_parts = len(postings)
        for e, key in enumerate(self.keys):
            if key is not None:
                self._number(self.head(key), e, postings)
        self.automaton.make_automaton()
        self.postings = [np.array(members, np.int32) for members in postings]
        self.sizes, self.cut = np.array([len(form) for form in self.own]), np.array([len(own) for own in self.numbers])
        self.needed: dict[int, np.ndarray] = {}

    def _number(self, passage: tuple, e: int, postings: list[list[int]]) -> int:
        number = self.automaton.get(passage, None)
        if number is None:
            number = len(postings)
            self.automaton.add_word(passage, number)
            postings.append([])
        postings[number].append(e)
        return number

    @staticmethod
    def head(key: bytes | None) -> tuple[int, int, int]:
        value = int.from_bytes(key[:8], "little") if key is not None else 0
        return 0, value & 0xFFFFFFFF, value >> 32

    def scan(self, key: bytes | None, form: list[int]) -> list[tuple[bytes, float, float]]:
        """(evaluation text, coverage, similarity) of all classes that match a training form."""
        hits = [p for _, p in self.automaton.iter((*self.head(key), *(c & 0xFFFFFFFF for c in form)))]
        if not hits:
            return []
        m, candidates = len(form), set()
        if parts := [self.postings[p] for p in hits if p < self.n_parts]:
            met = np.concatenate(parts)
            if 8 * len(met) < len(self.own):
                which, n = np.unique(met, return_counts=True)
                candidates.update(which[n >= passages_needed(self.sizes[which], self.cut[which], m)].tolist())
            else:
                if m not in self.needed:
                    if len(self.needed) > 200:
                        self.needed.clear()
                    self.needed[m] = passages_needed(self.sizes, self.cut, m)
                candidates.update(np.flatnonzero(np.bincount(met, minlength=len(self.own)) >= self.needed[m]).tolist())
        for p in hits:
            if p >= self.n_parts:
                candidates.update(self.postings[p].tolist())
        result, mine, hits = [], frozenset(form), frozenset(hits)
        for e in sorted(candidates):
            own = self.own[e]
            shared = len(mine.intersection(own))
            union = m + len(own) - shared
            same = key is not None and self.keys[e] == key
            if same or OF * shared >= SHARED * union:
                intervals = [border for border, p in zip(passages(len(own)), self.numbers[e]) if p in hits] + [(0, len(own))] * same
                result.append((self.texts[e], merged_length(intervals) / len(own), shared / union))
        return result


def _width(n: int) -> int:
    """Words of a signature where the shorter text has ``n`` words."""
    return min(n, next(k for most, k in SIGNED if n <= most))


def signature_words(n: int, train: bool) -> list[tuple[int, int, int]]:
    """(tag, words of a signature, first words that they come from) of an ``n``-word text.

    Tag 0 is for pairs whose training text is not the shorter one, 1 for the others.
    """
    least, both = -(-n * SHARED // OF), OF + SHARED
    # partners that are shorter (or as long), the shortest of ``least`` words, have ``least`` words in common with it
    most = n if train else n - 1
    widths = {_width(x) for x in (least, most, *(t + i for t, _ in SIGNED for i in (0, 1))) if least <= x <= most}
    outer = [(1 - train, k, n - least + k) for k in sorted(widths)]
    # partners that are longer (or as long)
    longer = n + train
    inner = [(int(train), _width(n), n + _width(n) - -(-SHARED * (n + longer) // both))] if OF * n >= SHARED * longer else []
    return outer + inner


@lru_cache(maxsize=2000)
def _subsets(k: int, of: int) -> np.ndarray:
    return np.array(list(combinations(range(of), k)), np.int32).T


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def signatures(keys: list[bytes | None], flat: np.ndarray, sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray, train: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, signature) of texts, in parts.

    flat, sizes: their forms one after the other and the words of each; codes,
    counts: the ordered words, by code, and their frequencies. Signatures of
    keys are odd, those of words even.
    """
    held = [(i, int.from_bytes(key[:8], "little")) for i, key in enumerate(keys) if key is not None]
    yield np.array([i for i, _ in held], np.int64), _mixed(np.array([key for _, key in held], np.uint64)) | np.uint64(1)
    starts = np.cumsum(sizes) - sizes
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        subsets = [(k + 8 * tag, _subsets(k, of)) for tag, k, of in signature_words(n, train)]
        step = max(1, AT_ONCE // max(n, *(x.shape[1] for _, x in subsets)))
        for start in range(0, len(rows), step):
            part = rows[start : start + step]
            words_ = flat[starts[part][:, None] + np.arange(n)]
            if len(codes):
                at = np.minimum(np.searchsorted(codes, words_), len(codes) - 1)
                often = np.where(codes[at] == words_, counts[at], 0)
                # words are in the order of their codes already
                words_ = np.take_along_axis(words_, np.argsort(often, axis=1, kind="stable"), axis=1)
            words_ = words_.view(np.uint64)
            for seed, subset in subsets:
                value = np.full((len(part), subset.shape[1]), seed, np.uint64)
                for places in subset:
                    value = _mixed(value + words_[:, places])
                yield np.repeat(part, subset.shape[1]), value.ravel() & ~np.uint64(1)


def _columns(batch: pa.RecordBatch) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    lists = batch.column("words")
    return batch.column("key").to_pylist(), lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _of_shard(found: np.ndarray, shard: int, shards: int) -> np.ndarray:
    return (found >> np.uint64(32)) % np.uint64(shards) == shard


def _codes(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two codes under which a filter holds a signature: four bits."""
    return signature, _mixed(signature + np.uint64(1))


def _noted(order, shard: int, shards: int):
    """Codes for the filter of a shard of signatures; with no shard, the count of signatures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                for _, found in signatures(*_columns(batch), *order.value, False):
                    if shard < 0:
                        yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64())], names=["code"])
                    else:
                        own = np.unique(found[_of_shard(found, shard, shards)])
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_codes(own)).view(np.int64))], names=["code"])

    return run


def _again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_codes(own)).view(np.int64))], names=["code"])


MET = "text binary, size int, map bigint, signatures array<bigint>"


def _met(order, shared, shard: int, shards: int, train: bool):
    """Texts with those of their signatures that the filter of a shard holds; without any they are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            if not len(batch):
                continue
            keys, flat, sizes = _columns(batch)
            rows, kept = [], []
            for row, found in signatures(keys, flat, sizes, *order.value, train):
                own = np.flatnonzero(_of_shard(found, shard, shards))
                for which in (0, 1):
                    own = own[bloom.contains(bits, _codes(found[own])[which])]
                rows.append(row[own])
                kept.append(found[own])
            rows, kept = np.concatenate(rows), np.concatenate(kept)
            held, n = np.unique(rows, return_counts=True)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(kept[np.argsort(rows, kind="stable")].view(np.int64)))
            maps = np.bitwise_or.reduceat(np.uint64(1) << (flat.view(np.uint64) & np.uint64(63)), np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays([batch.column("text").take(pa.array(held, pa.int64())), pa.array(sizes[held], pa.int32()), pa.array(maps[held].view(np.int64)), lists], names=["text", "size", "map", "signatures"])

    return run


def _wanted(shared):
    """Rows whose code the filter holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _codes(batch.column("code").to_numpy(zero_copy_only=False).view(np.uint64))
            yield batch.filter(pa.array(bloom.contains(shared.value, codes[0]) & bloom.contains(shared.value, codes[1])))

    return run


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches among (train_text, train_key, train_words, text, key, words), each pair of texts once."""
    for batch in batches:
        if not len(batch):
            continue
        keys, forms, own_keys, own_forms = (batch.column(c).to_pylist() for c in ("train_key", "train_words", "key", "words"))
        meets: dict[bytes, list[int]] = {}
        for i, text in enumerate(batch.column("text").to_pylist()):
            meets.setdefault(text, []).append(i)
        trained = batch.column("train_text").to_pylist()
        found = []
        classes = list(meets)
        for start in range(0, len(classes), EVAL_SHARD):
            own = classes[start : start + EVAL_SHARD]
            shard = EvaluationShard([(t, own_keys[meets[t][0]], own_forms[meets[t][0]]) for t in own])
            partners: dict[bytes, tuple[int, set[bytes]]] = {}
            for t in own:
                for i in meets[t]:
                    partners.setdefault(trained[i], (i, set()))[1].add(t)
            for train_text, (i, wanted) in partners.items():
                # what another batch holds is found there
                found += [(train_text, *match) for match in shard.scan(keys[i], forms[i]) if match[0] in wanted]
        left, right, coverage, similarity = zip(*found) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(coverage, pa.float64()), pa.array(similarity, pa.float64())], names=["train_text", "text", "coverage", "similarity"])


def _filter(codes: DataFrame, n: int):
    """Broadcast filter of ``n`` signatures given by their codes."""
    most = max(bloom.MIN_LOG_BITS, FILTER_BITS.bit_length() - 1)
    return codes.sparkSession.sparkContext.broadcast(bloom.merged_filter(codes, "code", min(most, bloom.log_bits_for(n, BITS_PER_SIGNATURE)), "seen"))


def cross_split_overlaps(train: DataFrame, evaluation: DataFrame, id_column: str = "record_id", text_column: str = "question", kept: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(matches, members) of training records and evaluation classes.

    matches: (train_id, text, coverage, similarity), ``text`` the digest of the
    class. members: (eval_id, text, kept columns as text) of every evaluation
    row; ``text`` is null where there is no word.
    """
    rows = evaluation.select(F.col(id_column).cast("bigint").alias("eval_id"), F.col(text_column).cast("string").alias("question"), *(F.col(c).cast("string").alias(f"kept_{i}") for i, c in enumerate(kept)))
    schema = "eval_id bigint, " + "".join(f"kept_{i} string, " for i in range(len(kept))) + "key binary, text binary, words array<bigint>"
    spark = train.sparkSession
    forms = rows.mapInArrow(_forms, schema)
    members = forms.select("eval_id", "text", *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(kept)))
    # digests and word codes of the evaluation side alone
    classes = durable(forms.filter("text is not null").groupBy("text").agg(F.first("key").alias("key"), F.first("words").alias("words")))
    often = classes.select(F.explode("words").alias("code")).groupBy("code").count().filter("count > 1").orderBy(F.desc("count"), "code").limit(ORDERED)
    ordered = np.array(sorted(tuple(r) for r in often.collect()), np.int64).reshape(-1, 2)
    order = spark.sparkContext.broadcast((ordered[:, 0].copy(), ordered[:, 1].copy()))
    n = classes.mapInArrow(_noted(order, -1, 1), "code bigint").agg(F.sum("code")).first()[0] or 0
    shards = max(1, -(-n * BITS_PER_SIGNATURE // FILTER_BITS))
    questions = train.select(F.col(id_column).cast("bigint").alias("train_id"), F.col(text_column).cast("string").alias("question"))
    # ids, digests and word codes of the training side
    texts = durable(questions.mapInArrow(_forms, "eval_id bigint, key binary, text binary, words array<bigint>").filter("text is not null").withColumnRenamed("eval_id", "train_id"))
    signed = None
    for shard in range(shards):
        shared = _filter(classes.mapInArrow(_noted(order, shard, shards), "code bigint"), -(-n // shards))
        part = durable(texts.select("text", "key", "words").mapInArrow(_met(order, shared, shard, shards, True), MET).dropDuplicates(["text"]).select(F.xxhash64("text").alias("train_code"), F.col("size").alias("train_size"), F.col("map").alias("train_map"), "signatures"))
        shared.unpersist()
        part = part.select("train_code", "train_size", "train_map", F.explode("signatures").alias("signature"))
        signed = part if signed is None else signed.unionByName(part)
    shared = _filter(signed.select(F.col("signature").alias("code")).mapInArrow(_again, "code bigint"), signed.count())
    own = classes.mapInArrow(_met(order, shared, 0, 1, False), MET).select(F.xxhash64("text").alias("code"), "size", "map", F.explode("signatures").alias("signature"))
    words_fit = (OF * F.col("size") >= SHARED * F.col("train_size")) & (OF * F.col("train_size") >= SHARED * F.col("size")) & ((OF + SHARED) * F.bit_count(F.col("map").bitwiseXOR(F.col("train_map"))) <= (OF - SHARED) * (F.col("size") + F.col("train_size")))
    # codes of texts
    meetings = durable(signed.join(own, "signature").filter((F.col("signature").bitwiseAND(1) == 1) | words_fit).select("train_code", "code").distinct())
    shared.unpersist()
    wanted = _filter(meetings.select(F.col("train_code").alias("code")).mapInArrow(_again, "code bigint"), meetings.count())
    texts = texts.withColumn("code", F.xxhash64("text")).mapInArrow(_wanted(wanted), "train_id bigint, key binary, text binary, words array<bigint>, code bigint")
    trained = texts.groupBy(F.col("text").alias("train_text")).agg(F.first("code").alias("train_code"), F.first("key").alias("train_key"), F.first("words").alias("train_words"))
    pairs = meetings.join(trained, "train_code").join(classes.withColumn("code", F.xxhash64("text")), "code")
    found = pairs.select("train_text", "train_key", "train_words", "text", "key", "words").mapInArrow(_scanned, "train_text binary, text binary, coverage double, similarity double")
    return found.join(texts.select("train_id", F.col("text").alias("train_text")), "train_text").select("train_id", "text", "coverage", "similarity"), members


def expanded_pairs(matches: DataFrame, members: DataFrame) -> DataFrame:
    """(train_id, eval_id, coverage, similarity) of all overlapping pairs of records."""
    return matches.join(members.select("eval_id", "text"), "text").select("train_id", "eval_id", "coverage", "similarity")


def overlap_report(matches: DataFrame, members: DataFrame) -> DataFrame:
    """(split, source, records, overlapping, pairs) per evaluation split and source, from members that kept both."""
    per = matches.groupBy("text").agg(F.count("*").alias("n"))
    rows = members.join(per, "text", "left").withColumn("source", F.coalesce("source", F.lit("")))
    return rows.groupBy("split", "source").agg(F.count("*").alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
