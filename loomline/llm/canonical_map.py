"""Mapping free-entered values to a canonical list (problem 7).

Each value is brought to a normal form (words without case, marks and known
additions such as "intro to" or "part 2") and looked up, in this order:

1. exactly: an entry's words in order, joined, reversed or turned round a
   comma, its short form (also in the plural), or an entry inside the value;
2. by edits: a BK-tree over the entries under the Levenshtein distance, a true
   metric; the triangle inequality prunes subtrees and every entry within
   the threshold is returned, the nearest one (then the smaller id) wins;
3. as a cut-off entry: the value is the beginning of exactly one entry.

The tree is built and walked for many strings at a time: at each node one
bit-parallel pass gives the distance of its entry to all that reach it. A worker
builds the tree of a list once. A reference list of up to ``MAX_BROADCAST``
entries is broadcast whole; a longer one is sharded. A shard reports how its
winner was found and which entries begin with the value, so that merging the
shards gives what one list would.

Defined results: null and blank values and literal entries are not mapped (no
row); a value that fits nothing gives 0; equal distances go to the smaller id;
very long values exceed every entry by more than the threshold and give 0;
empty reference lists give 0 throughout; entries without id or text are
ignored; repeated rows are mapped each; other columns are not read.
"""

from __future__ import annotations

import re
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.keys import words

MAX_BROADCAST = 100_000
#: Words that people put before and after a topic; a parameter of the operator.
ADDITIONS = (frozenset("topic intro introduction to advanced basic beginner course lesson".split()), frozenset("basics beginner beginners advanced exercises exercise part notes course".split()))
#: How a winner was found, best first.
EXACT, BY_EDITS, NONE = 0, 1, 2
_DIGITS = re.compile(r"\d+")


def threshold(length: int) -> int:
    """Most edits accepted for an entry of so many letters."""
    return 4 if length >= 12 else length // 4


def levenshtein(a: str, b: str) -> int:
    """Plain dynamic programme, for entries longer than a machine word and for tests."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


def distances(entry: str, chars: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Distance of an entry (1..64 letters) to many strings at once (bit-parallel).

    chars: (n, longest) code points, 0 beyond each string's end.
    """
    m, n = len(entry), len(chars)
    one = np.uint64(1)
    masks: dict[int, np.uint64] = {}
    for i, c in enumerate(entry):
        masks[ord(c)] = masks.get(ord(c), np.uint64(0)) | (one << np.uint64(i))
    plus = np.full(n, (1 << m) - 1 if m < 64 else 0xFFFFFFFFFFFFFFFF, np.uint64)
    minus = np.zeros(n, np.uint64)
    top = one << np.uint64(m - 1)
    score = np.full(n, m, np.int64)
    result = np.where(lengths == 0, m, 0)
    known = np.array(sorted(masks), np.int64)
    values = np.array([masks[c] for c in known.tolist()], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(chars.shape[1]):
            at = np.searchsorted(known, chars[:, j]).clip(max=len(known) - 1)
            eq = np.where(known[at] == chars[:, j], values[at], np.uint64(0))
            x = eq | minus
            d0 = (((x & plus) + plus) ^ plus) | x
            hp = minus | ~(d0 | plus)
            hm = plus & d0
            score += ((hp & top) != 0).astype(np.int64) - ((hm & top) != 0)
            hp = (hp << one) | one
            hm = hm << one
            plus = hm | ~(d0 | hp)
            minus = hp & d0
            ended = lengths == j + 1
            result[ended] = score[ended]
    return result


class BKTree:
    """Burkhard-Keller tree over (text, id); searched for many values at a time."""

    def __init__(self, entries: list[tuple[str, int]]):
        self.nodes: list[tuple[str, int]] = entries
        self.children: list[dict[int, int]] = [{} for _ in entries]
        lengths = np.array([len(t) for t, _ in entries], np.int64)
        chars = _code_points([t for t, _ in entries], lengths)
        # a node's subtree: it divides all entries that reach it by their distance, in one pass
        stack = [np.arange(len(entries))] if entries else []
        while stack:
            who = stack.pop()
            root, rest = int(who[0]), who[1:]
            if len(rest):
                d = self._distances(entries[root][0], rest, chars, lengths, [t for t, _ in entries])
                for edge in np.unique(d).tolist():
                    below = rest[d == edge]
                    self.children[root][edge] = int(below[0])
                    stack.append(below)

    @staticmethod
    def _distances(text: str, who: np.ndarray, chars: np.ndarray, lengths: np.ndarray, values: list[str]) -> np.ndarray:
        if 1 <= len(text) <= 64:
            width = int(lengths[who].max())
            return distances(text, chars[who, :width], lengths[who])
        return np.array([levenshtein(text, values[i]) for i in who])

    def within(self, values: list[str], limit) -> list[list[tuple[int, int]]]:
        """For each value, (distance, id) of every entry within ``limit(len(entry))``."""
        found: list[list[tuple[int, int]]] = [[] for _ in values]
        if not self.nodes or not values:
            return found
        longest_entry = max(len(t) for t, _ in self.nodes)
        most = max(limit(len(t)) for t, _ in self.nodes)
        lengths = np.array([len(v) for v in values], np.int64)
        active = np.flatnonzero(lengths <= longest_entry + most)
        chars = _code_points(values, np.where(lengths <= longest_entry + most, lengths, 0))
        stack = [(0, active)]
        while stack:
            node, who = stack.pop()
            if not len(who):
                continue
            text, ident = self.nodes[node]
            d = self._distances(text, who, chars, lengths, values)
            near = d <= limit(len(text))
            for i, x in zip(who[near].tolist(), d[near].tolist()):
                found[i].append((x, ident))
            for edge, child in self.children[node].items():
                stack.append((child, who[np.abs(d - edge) <= most]))
        return found


def _code_points(values: list[str], lengths: np.ndarray) -> np.ndarray:
    """(n, longest) code points of the values, 0 beyond the given lengths."""
    chars = np.zeros((len(values), int(lengths.max()) if len(values) else 0), np.int64)
    for i in np.flatnonzero(lengths):
        chars[i, : lengths[i]] = [ord(c) for c in values[i]]
    return chars


def core_words(value: str, additions: tuple[frozenset, frozenset] = ADDITIONS) -> list[str]:
    """Words of a value without additions at its ends."""
    own = words(value)
    while len(own) > 1 and (own[-1] in additions[1] or _DIGITS.fullmatch(own[-1])):
        own.pop()
    while len(own) > 1 and (own[0] in additions[0] or _DIGITS.fullmatch(own[0])):
        own.pop(0)
    return own


class Matcher:
    """Lookup of values in one reference list of (id, text, short form)."""

    def __init__(self, entries: list[tuple[int, str, str | None]], additions: tuple[frozenset, frozenset] = ADDITIONS):
        self.additions = additions
        self.literal = {t for _, t, _ in entries if t is not None}
        self.exact: dict[str, int] = {}
        self.inside: dict[tuple, int] = {}
        self.plain: dict[str, int] = {}
        for ident, text, short in sorted(entries, key=lambda e: e[0]):
            own = words(text)
            if not own:
                continue
            self.plain.setdefault("".join(own), ident)
            for form in (own, own[::-1], own[-1:] + own[:-1], own[1:] + own[:1]):
                self.exact.setdefault("".join(form), ident)
            self.inside.setdefault(tuple(own), ident)
            if short and (s := "".join(words(short))):
                self.exact.setdefault(s, ident)
                self.exact.setdefault(s + "s", ident)
        self.longest = max((len(k) for k in self.inside), default=0)
        self.tree = BKTree(sorted((t, i) for t, i in self.plain.items()))
        self.sorted = sorted(self.plain)

    def _contained(self, own: list[str]) -> tuple[int, int, int] | None:
        """(minus the words, their place, id) of the longest entry inside the value."""
        for n in range(min(self.longest, len(own)), 0, -1):
            for i in range(len(own) - n + 1):
                if (ident := self.inside.get(tuple(own[i : i + n]))) is not None:
                    return -n, i, ident
        return None

    def _beginning(self, text: str) -> tuple[str | None, str | None, int]:
        """(first and last entry that begins with the text, id of the first if the text is at least half of it)."""
        if len(text) < 5:
            return None, None, 0
        first = bisect_left(self.sorted, text)
        last = bisect_left(self.sorted, text + chr(0x10FFFF)) - 1
        if last < first:
            return None, None, 0
        low = self.sorted[first]
        return low, self.sorted[last], self.plain[low] if 2 * len(text) >= len(low) else 0

    def ranked(self, values: list[str]) -> list[tuple]:
        """(how, a, b, c, id, low, high, cut) of each value.

        The smallest (how, a, b, c, id) of all shards is the winner; without one
        it is ``cut`` if low and high of all shards are one entry.
        """
        result: list[tuple] = []
        open_: list[tuple[int, str]] = []
        for k, value in enumerate(values):
            own = core_words(value, self.additions)
            text, whole = "".join(own), "".join(words(value))
            if ident := self.exact.get(text):
                result.append((EXACT, 0, 0, 0, ident, None, None, 0))
            elif ident := self.exact.get(whole):
                result.append((EXACT, 1, 0, 0, ident, None, None, 0))
            elif inside := self._contained(own):
                result.append((EXACT, 2, *inside, None, None, 0))
            else:
                result.append((NONE, 0, 0, 0, 0, None, None, 0))
                open_.append((k, text))
        for (k, text), found in zip(open_, self.tree.within([t for _, t in open_], threshold)):
            how = (BY_EDITS, 0, 0, *min(found)) if found else (NONE, 0, 0, 0, 0)
            result[k] = (*how, *self._beginning(text))
        return result

    def match(self, values: list[str]) -> list[int]:
        """Id of each value; 0 if nothing fits."""
        return [ident if how < NONE else cut if low is not None and low == high else 0 for how, _, _, _, ident, low, high, cut in self.ranked(values)]


_MATCHERS: dict[str, Matcher] = {}


def _matcher(shared, name: str, additions: tuple[frozenset, frozenset]) -> Matcher:
    """The matcher of a broadcast list, built once per worker."""
    if name not in _MATCHERS:
        while len(_MATCHERS) >= 2:
            _MATCHERS.pop(next(iter(_MATCHERS)))
        _MATCHERS[name] = Matcher(shared.value, additions)
    return _MATCHERS[name]


def _mapped(shared, name: str, additions: tuple[frozenset, frozenset]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, name, additions)
        memo: dict[str, int] = {}
        for batch in batches:
            wanted = [(i, v) for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if v is not None and v.strip() and v not in matcher.literal]
            if len(memo) > 500_000:
                memo.clear()
            new = list(dict.fromkeys(v for _, v in wanted if v not in memo))
            memo.update(zip(new, matcher.match(new)))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in wanted], pa.int64()), pa.array([memo[v] for _, v in wanted], pa.int32())], names=["record_id", "topic_id"])

    return run


_RANKED = "value string, how int, a int, b int, c int, topic_id int, low string, high string, cut int"


def _ranked(shared, name: str, additions: tuple[frozenset, frozenset]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared, name, additions)
        for batch in batches:
            values = [v for v in batch.column(0).to_pylist() if v.strip()]
            columns = list(zip(*matcher.ranked(values))) if values else [()] * 8
            types = [pa.int32()] * 5 + [pa.string()] * 2 + [pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), *(pa.array(c, t) for c, t in zip(columns, types))], names=[c.split()[0] for c in _RANKED.split(", ")])

    return run


def map_to_reference(df: DataFrame, reference: DataFrame, id_column: str = "record_id", value_column: str = "topic", max_broadcast: int = MAX_BROADCAST, additions: tuple[frozenset, frozenset] = ADDITIONS) -> DataFrame:
    """(record_id, topic_id): the entry meant by each hand-typed value, 0 if none.

    ``reference`` has topic_id, topic, short_form.
    """
    entries = reference.select(F.col("topic_id").cast("int"), F.col("topic").cast("string"), F.col("short_form").cast("string")).filter("topic_id is not null and topic is not null")
    pairs = df.select(F.col(id_column).cast("bigint").alias("record_id"), F.col(value_column).cast("string").alias("value"))
    shards = max(1, -(-entries.count() // max_broadcast))
    context = df.sparkSession.sparkContext
    if shards == 1:
        shared = context.broadcast([tuple(r) for r in entries.toLocalIterator()])
        return pairs.mapInArrow(_mapped(shared, uuid.uuid4().hex, additions), "record_id bigint, topic_id int")
    values = pairs.filter("value is not null").join(entries.select(F.col("topic").alias("value")).distinct(), "value", "left_anti")
    distinct = values.select("value").distinct()
    parts = None
    for shard in range(shards):
        own = entries.filter(F.pmod(F.xxhash64("topic"), F.lit(shards)) == shard)
        shared = context.broadcast([tuple(r) for r in own.toLocalIterator()])
        part = distinct.mapInArrow(_ranked(shared, uuid.uuid4().hex, additions), _RANKED)
        parts = part if parts is None else parts.unionByName(part)
    best = parts.groupBy("value").agg(F.min(F.struct("how", "a", "b", "c", "topic_id")).alias("best"), F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.when(F.col("low").isNotNull(), F.col("cut"))).alias("cut"))
    winner = F.when(F.col("best.how") < NONE, F.col("best.topic_id")).when(F.col("low") == F.col("high"), F.col("cut")).otherwise(0)
    return values.join(best.select("value", winner.cast("int").alias("topic_id")), "value").select("record_id", "topic_id")


def unmatched_values(df: DataFrame, mapped: DataFrame, id_column: str = "record_id", value_column: str = "topic") -> DataFrame:
    """(value, records) of the values that fit no entry."""
    none = mapped.filter("topic_id = 0").select(F.col("record_id").alias(id_column))
    return df.select(id_column, F.col(value_column).alias("value")).join(none, id_column, "left_semi").groupBy("value").agg(F.count("*").alias("records"))
