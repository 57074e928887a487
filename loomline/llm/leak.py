"""Evaluation texts leaking into training text (problem 8).

Training documents are dealt into shards, as they lie in the partitions of the
scan: a shard ends at about ``SHARD_WORDS`` words. Each shard gets one suffix
array over words. A word that no test item contains cannot be part of a match,
so the array holds the suffixes of runs of known words only. The order is full:
prefix doubling goes on until the longest run is sorted out, and its levels are
kept. Every test suffix is then located by binary search:

* the run of training suffixes that share its first four words gives all places
  of that sequence; a document holds an item if at least half of the item's
  distinct four-word sequences occur in it;
* of the suffixes of such a document the two next to a test suffix in the order
  share the most words with it; the doubling levels give how many. That is the
  longest verbatim match and its place, at any length.

Places of one sequence in one document are merged before they meet the items
that hold it, and documents meet items in chunks of ``CHUNK``, so boilerplate
that stands everywhere costs time but no memory. Documents that hold an item are
removed.

The items are a query set of bounded size: they are broadcast in blocks of at
most ``ITEM_BLOCK`` items; a longer list costs one more pass per block.

Defined results: null or short texts match nothing; items of fewer than four
words have no sequence and match nothing; repeated documents and items are
matched each; empty tables give empty results; documents are read whole; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.keys import words

ITEM_BLOCK = 20_000
GRAM = 4
SHARD_WORDS = 1_000_000
#: Pairs of sequence and item, or of document and test suffix, expanded at a time.
CHUNK = 2_000_000


class TestSuffixes:
    """Word codes of the test items, each ended by a separator (code 0)."""

    __test__ = False

    def __init__(self, items: list[tuple[int, str | None]]):
        self.codes: dict[str, int] = {}
        tokens, owner, left = [], [], []
        self.ids = []
        for ident, text in items:
            own = words(text)
            if len(own) < GRAM:
                continue
            k = len(self.ids)
            self.ids.append(ident)
            tokens += [self.codes.setdefault(w, len(self.codes) + 1) for w in own] + [0]
            owner += [k] * (len(own) + 1)
            left += range(len(own), -1, -1)
        self.tokens, self.owner, self.left = (np.array(x, np.int64) for x in (tokens, owner, left))
        self.ids = np.array(self.ids, np.int64)
        #: Of each item, where its suffixes begin and how many there are.
        self.sizes = np.bincount(self.owner, minlength=len(self.ids)) - 1 if len(self.ids) else np.zeros(0, np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes + 1)[:-1]].astype(np.int64) if len(self.ids) else np.zeros(0, np.int64)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those of the next."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


def chunks(sizes: np.ndarray, most: int = CHUNK) -> Iterator[slice]:
    """Slices whose sizes add up to about ``most``, one element at least."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield slice(start, stop)
        start = stop


class ShardArray:
    """Suffix array of a shard (word codes, 0 for unknown words and text ends), and the test suffixes in its order.

    ``doc`` and ``place`` are the document and the word number of each code.
    """

    def __init__(self, test: TestSuffixes, codes: np.ndarray, doc: np.ndarray, place: np.ndarray):
        border = np.flatnonzero(codes == 0)
        starts, ends = np.r_[0, border + 1], np.r_[border, len(codes)]
        keep = ends - starts >= GRAM
        starts, ends = starts[keep], ends[keep]
        self.test, self.n = test, 0
        if not len(starts) or not len(test.tokens):
            return
        at = spans(starts, ends - starts + 1)
        self.left = np.repeat(ends, ends - starts + 1) - at
        at = np.minimum(at, len(codes) - 1)
        self.doc, self.place = doc[at], place[at]
        self.n = len(at)
        tokens = np.r_[np.where(self.left == 0, 0, codes[at]), test.tokens]
        self.levels = [tokens]
        longest = int(max(self.left.max(), test.left.max()))
        # the rank of every suffix by its first 1, 2, 4, ... words
        while len(self.levels) <= 2 or (1 << (len(self.levels) - 1)) < longest:
            half = 1 << (len(self.levels) - 1)
            ranks = self.levels[-1]
            shifted = np.zeros_like(ranks)
            shifted[:-half] = ranks[half:]
            self.levels.append(np.unique(ranks * (int(ranks.max()) + 1) + shifted, return_inverse=True)[1].astype(np.int64))
            if len(self.levels) > 3 and self.levels[-1].max() == ranks.max():
                break  # no two suffixes were told apart: the order is final
        self.rank = self.levels[-1]

    def holders(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, item) pairs with at least half of the item's distinct sequences."""
        test, gram = self.test, self.levels[2]
        queries = np.flatnonzero(test.left >= GRAM)
        # distinct sequences of each item, ordered by sequence
        of_test = np.unique(np.stack([gram[self.n :][queries], test.owner[queries]], axis=1), axis=0)
        needed = np.bincount(of_test[:, 1], minlength=len(test.ids))
        suffixes = np.flatnonzero(self.left >= GRAM)
        array = suffixes[np.argsort(self.rank[suffixes], kind="stable")]
        # binary search of every test suffix: the run of training suffixes that begin with its sequence
        wanted = np.unique(of_test[:, 0])
        lower, upper = (np.searchsorted(gram[array], wanted, side) for side in ("left", "right"))
        places = array[spans(lower, upper - lower)]
        pairs = np.unique(np.stack([self.doc[places], np.repeat(wanted, upper - lower)], axis=1), axis=0)
        first, last = (np.searchsorted(of_test[:, 0], pairs[:, 1], side) for side in ("left", "right"))
        # whole documents at a time
        docs, start = np.unique(pairs[:, 0], return_index=True)
        hits = np.add.reduceat(last - first, start) if len(docs) else np.zeros(0, np.int64)
        bounds = np.r_[start, len(pairs)]
        found = [np.zeros((0, 2), np.int64)]
        for part in chunks(hits):
            own = slice(bounds[part.start], bounds[part.stop])
            size = last[own] - first[own]
            cell = np.repeat(pairs[own, 0], size) * len(test.ids) + of_test[spans(first[own], size), 1]
            cells, n = np.unique(cell, return_counts=True)
            cells = cells[2 * n >= needed[cells % len(test.ids)]]
            found.append(np.stack([cells // len(test.ids), cells % len(test.ids)], axis=1))
        return tuple(np.concatenate(found).T)

    def common(self, a: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Words that the training suffixes ``a`` and the test suffixes ``query`` share."""
        length, end = np.zeros(len(a), np.int64), len(self.rank) - 1
        # suffixes of one final rank are equal to their ends
        length[self.rank[a] == self.rank[self.n + query]] = end
        for level in range(len(self.levels) - 2, -1, -1):
            x, y = np.minimum(a + length, end), np.minimum(self.n + query + length, end)
            length += np.where(self.levels[level][x] == self.levels[level][y], 1 << level, 0)
        return np.minimum(length, np.minimum(self.left[a], self.test.left[query]))

    def longest(self, doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(longest verbatim match, its place in the document) of each (document, item)."""
        inside = np.flatnonzero((self.left > 0) & np.isin(self.doc, doc))
        width = int(self.rank.max()) + 1
        key = self.doc[inside] * width + self.rank[: self.n][inside]
        order = np.argsort(key, kind="stable")
        inside, key = inside[order], key[order]
        best, place = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        for part in chunks(self.test.sizes[item]):
            size = self.test.sizes[item[part]]
            pair = np.repeat(np.arange(part.start, part.stop), size)
            query = spans(self.test.starts[item[part]], size)
            at = np.searchsorted(key, doc[pair] * width + self.rank[self.n + query])
            for near in (at - 1, at):
                near = near.clip(0, len(inside) - 1)
                same = np.flatnonzero(self.doc[inside[near]] == doc[pair])
                length = self.common(inside[near[same]], query[same])
                # the longest of each pair, then the earliest place
                own = np.lexsort((self.place[inside[near[same]]], -length, pair[same]))
                top = own[np.r_[True, np.diff(pair[same][own]) > 0]] if len(own) else own
                which, value, where = pair[same][top], length[top], self.place[inside[near[same]]][top]
                better = (value > best[which]) | ((value == best[which]) & (where < place[which]))
                best[which[better]], place[which[better]] = value[better], where[better]
        return best, place


def _matched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = TestSuffixes(shared.value)
        code = test.codes.get
        ids, codes, sizes = [], [], []

        def searched() -> pa.RecordBatch:
            doc, place = np.repeat(np.arange(len(ids)), sizes), spans(np.zeros(len(ids), np.int64), np.array(sizes, np.int64))
            array = ShardArray(test, np.array(codes, np.int64), doc, place)
            found = item = length = where = np.zeros(0, np.int64)
            if array.n:
                found, item = array.holders()
                length, where = array.longest(found, item) if len(found) else (length, where)
            return pa.RecordBatch.from_arrays([pa.array([ids[k] for k in found.tolist()], pa.int64()), *(pa.array(x, pa.int64()) for x in (test.ids[item], length, where))], names=["doc_id", "item_id", "longest", "place"])

        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = [code(w, 0) for w in words(text)]
                codes += own
                codes.append(0)
                ids.append(ident)
                sizes.append(len(own) + 1)
                if len(codes) >= SHARD_WORDS:
                    yield searched()
                    ids, codes, sizes = [], [], []
        if ids:
            yield searched()

    return run


def leaked_items(documents: DataFrame, items: DataFrame, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id, longest, place): items of which a document holds at least half.

    ``longest`` is the longest verbatim match in words, ``place`` the number of
    its first word in the document.
    """
    context = documents.sparkSession.sparkContext
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    pairs = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    blocks = max(1, -(-pairs.count() // item_block))
    result = None
    for block in range(blocks):
        own = pairs.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        shared = context.broadcast([tuple(r) for r in own.toLocalIterator()])
        part = texts.mapInArrow(_matched(shared), "doc_id bigint, item_id bigint, longest bigint, place bigint")
        result = part if result is None else result.unionByName(part)
    return result


def clean_documents(documents: DataFrame, leaked: DataFrame) -> DataFrame:
    """Documents without those that hold a test item."""
    return documents.join(leaked.select("doc_id").distinct(), "doc_id", "left_anti")


def leak_report(leaked: DataFrame) -> DataFrame:
    """(item_id, documents, longest) of every item that leaked."""
    return leaked.groupBy("item_id").agg(F.count_distinct("doc_id").alias("documents"), F.max("longest").alias("longest"))
