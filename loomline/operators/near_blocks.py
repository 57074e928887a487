"""Exact cosine join of texts over character n-gram TF-IDF, block against block.

No posting is ever written: texts stay in compressed blocks, and grams are made
from them where they are needed.

* Blocks: distinct texts are dealt by hash into blocks, one per partition.
* Weights: a block's distinct grams with their document frequencies are kept
  beside its texts; frequencies are summed over all blocks.
* Lists: grams have one global order (by frequency, then hash; rarest first).
  Of two texts with cosine >= t, let ``p`` and ``q`` be the parts of their squared
  norms that stand before their first common gram; then (1 - p)(1 - q) >= t^2. So
  a block holds lists of the texts that have a gram before 1 - t^2 of their norm,
  sorted by that part, and two lists meet only as far as the product reaches t^2.
* Maps: grams up to a frequency go into bit maps of a text. A bit that only one of
  two texts has is a gram the other lacks; the lightest gram of the map times
  these bits bounds the part of the norm that is not shared. The same product must
  reach t^2, so the two parts add up to 2(1 - t) at most. Few other than the true
  pairs pass (see ``SHARES``).
* The full product of what passes is computed from the texts.

Every bound is lossless, so block sizes and the frequencies of the maps do not
change the result. Work grows with the meetings of the lists, which for texts of
one kind is their square; disk grows with the texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import durable

GRAMS = (3, 4, 5)
MIN_DF = 2
EPSILON = 1e-9
#: Texts and characters of a block at most, on average; smaller ones for up to LEAST_BLOCKS blocks.
BLOCK, BLOCK_CHARACTERS, SMALL_BLOCK, LEAST_BLOCKS = 32_768, 1 << 23, 4_096, 8
#: Texts (a power of two) and characters whose grams are made at once.
TEXTS, CHARACTERS = 1 << 10, 1 << 20
#: Bits of a map; parts of all squared weights up to which grams are in map 1, 2 and (from there) 3.
BITS, SHARES = 256, (0.36, 0.16, 0.45)
#: Parts of the norm are whole steps, rounded down. Meetings and pairs looked at at once.
STEPS, MEETINGS, PAIRS = 1 << 8, 1 << 14, 2_000
#: Allowance for rounding in the bounds.
ROUNDING = 1e-6

PACKED = "block int, texts bigint, rows bigint, rids binary, copies binary, lengths binary, text binary"
LISTED = "block int, rids binary, copies binary, lengths binary, text binary, names binary, dfs binary, list_names binary, list_sizes binary, list_texts binary, list_parts binary, maps binary, lightest binary"


# ---- grams --------------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of consecutive runs."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def _firsts(values: np.ndarray) -> np.ndarray:
    """Positions at which sorted values change, and 0."""
    return np.flatnonzero(np.concatenate(([len(values) > 0], values[1:] != values[:-1])))


def _counted(codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, text, tf) of the grams of up to TEXTS texts, by name; names are hashes of 54 bits."""
    low = np.uint64(TEXTS - 1)
    text = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))
    h, keys = _mix(codes.astype(np.uint64)), []
    for n in range(2, max(GRAMS) + 1):
        h = _mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + codes[n - 1 :])
        if n in GRAMS:
            inside = left[: len(h)] >= n
            keys.append((h[inside] & ~low) | text[: len(h)][inside])
    keys = np.sort(np.concatenate(keys))
    at = _firsts(keys)
    return keys[at] & ~low, (keys[at] & low).astype(np.int64), np.diff(np.append(at, len(keys)))


def _portions(lengths: np.ndarray) -> Iterator[slice]:
    """Consecutive texts whose grams are made at once."""
    begin, ends = 0, np.cumsum(lengths)
    while begin < len(lengths):
        fits = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + CHARACTERS, side="right"))
        yield slice(begin, end := min(max(fits, begin + 1), begin + TEXTS))
        begin = end


class Texts:
    """The texts of a block."""

    def __init__(self, row: dict):
        self.rids, self.copies = (np.frombuffer(row[k], np.int64) for k in ("rids", "copies"))
        self.lengths = np.frombuffer(row["lengths"], np.int32).astype(np.int64)
        whole = pa.decompress(row["text"][8:], int.from_bytes(row["text"][:8], "little"), codec="zstd", asbytes=True)
        self.codes = np.frombuffer(whole.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def counted(self, positions: np.ndarray) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """(some of the positions, their grams), portion by portion."""
        for part in _portions(self.lengths[positions]):
            some = positions[part]
            yield some, _counted(self.codes[_spans(self.starts[some], self.lengths[some])], self.lengths[some])


class Weights:
    """The grams of a block that two rows have, by name, with document frequencies."""

    def __init__(self, names: np.ndarray, dfs: np.ndarray, rows: int):
        self.names, self.order = names, np.lexsort((names, dfs))
        self.rank = np.empty(len(names), np.int64)
        self.rank[self.order] = np.arange(len(names))
        #: by rank
        self.dfs = dfs[self.order]
        self.idf = np.log((1 + rows) / (1 + self.dfs)) + 1

    def weighted(self, grams: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, rank, squared unit-norm weight) by text and rank, and the squared norms of the texts."""
        name, text, tf = grams
        if not len(self.names):
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0)
        at = _firsts(name)
        place = np.minimum(np.searchsorted(self.names, name[at]), len(self.names) - 1)
        rank = np.where(self.names[place] == name[at], self.rank[place], -1)
        rank = np.repeat(rank, np.diff(np.append(at, len(name))))
        if (rank < 0).any():
            known = rank >= 0
            text, rank, tf = text[known], rank[known], tf[known]
        if len(text) < 1 << 22 and len(self.names) < 1 << 31:
            packed = np.sort((text << 53) | (rank << 22) | np.arange(len(text)))
            text, rank, tf = packed >> 53, (packed >> 22) & ((1 << 31) - 1), tf[packed & ((1 << 22) - 1)]
        else:
            order = np.lexsort((rank, text))
            text, rank, tf = text[order], rank[order], tf[order]
        square = (tf * self.idf[rank]) ** 2
        norms = np.bincount(text, square, minlength=1)
        return text, rank, square / norms[text], norms


# ---- stages -------------------------------------------------------------------


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, rid, text, copies) of one block to its row."""
    parts: dict[str, list] = {"rids": [], "copies": [], "lengths": [], "text": []}
    for batch in batches:
        if batch.num_rows:
            block, texts = batch.column("block")[0].as_py(), batch.column("text").to_pylist()
            parts["rids"].append(batch.column("rid").to_numpy())
            parts["copies"].append(batch.column("copies").to_numpy())
            parts["lengths"].append(np.fromiter(map(len, texts), np.int32, len(texts)))
            parts["text"].append("".join(texts).encode("utf-8", "surrogatepass"))
    if parts["rids"]:
        arrays = {k: np.concatenate(parts[k]) for k in ("rids", "copies", "lengths")}
        text = b"".join(parts["text"])
        row = {"block": block, "texts": len(arrays["rids"]), "rows": int(arrays["copies"].sum()), "rids": arrays["rids"].astype(np.int64).tobytes(), "copies": arrays["copies"].astype(np.int64).tobytes()}
        yield _row(PACKED, row | {"lengths": arrays["lengths"].tobytes(), "text": len(text).to_bytes(8, "little") + pa.compress(text, codec="zstd", asbytes=True)})


def _row(schema: str, row: dict) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row[name]], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def _block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, gram, n): rows of a block that have a gram."""
    for batch in batches:
        for row in batch.to_pylist():
            texts, names, counts = Texts(row), [], []
            for some, (name, text, _) in texts.counted(np.arange(len(texts.rids))):
                at = _firsts(name)
                names.append(name[at])
                counts.append(np.add.reduceat(texts.copies[some][text], at) if len(at) else np.empty(0, np.int64))
                if sum(map(len, names)) > 1 << 22:
                    names, counts = ([x] for x in _summed(names, counts))
            names, counts = _summed(names, counts)
            for i in range(0, len(names), 1 << 16):
                name, n = names[i : i + (1 << 16)].view(np.int64), counts[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["block"], np.int32)), pa.array(name), pa.array(n)], names=["block", "gram", "n"])


def _summed(names: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    name, n = np.concatenate(names), np.concatenate(counts)
    order = np.argsort(name)
    at = _firsts(name[order])
    return name[order][at], np.add.reduceat(n[order], at) if len(at) else n


def _list(rows: int, cuts: tuple[int, ...], least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A block's row and (gram, df) of its grams to its lists and maps. least: (1 - p)(1 - q) at least."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, names, dfs = None, [], []
        for batch in batches:
            has_gram = batch.column("gram").is_valid()
            grams = batch.filter(has_gram)
            names.append(grams.column("gram").to_numpy().view(np.uint64))
            dfs.append(grams.column("df").to_numpy())
            if grams.num_rows < batch.num_rows:
                packed = batch.filter(pc.invert(has_gram)).to_pylist()[0]
        if packed is None:
            return
        name, df = np.concatenate(names), np.concatenate(dfs)
        order = np.argsort(name)
        texts, weights = Texts(packed), Weights(name[order], df[order], rows)
        bits = weights.names[weights.order]
        first, second, third = (int(np.searchsorted(weights.dfs, c, side="right")) for c in cuts)
        # one bit stays free: so a count of bits is a byte
        bit = [((bits >> np.uint64(16 * k)) % np.uint64(BITS - 1)).astype(np.int64) for k in (1, 2)]
        entries, maps, lightest = [], [], []
        for some, grams in texts.counted(np.arange(len(texts.rids))):
            text, rank, square, norms = weights.weighted(grams)
            flags, light = np.zeros((len(some), 3 * BITS), bool), np.zeros((len(some), 3), np.float32)
            begins = _firsts(text)
            total = np.cumsum(square) - square
            part = total - np.repeat(total[begins], np.diff(np.append(begins, len(text))))
            inside = np.flatnonzero(part < 1 - least)
            step = np.clip(part[inside] / (1 - least) * STEPS, 0, STEPS - 1).astype(np.int64)
            entries.append((rank[inside] << 36) | (step << 20) | some[text[inside]])
            rare = np.flatnonzero(rank < max(first, second, third))
            text, rank = text[rare], rank[rare]
            for k, (low, high, places) in enumerate(((0, first, bit[0]), (0, second, bit[1] + BITS), (second, third, bit[1] + 2 * BITS))):
                among = np.flatnonzero((rank >= low) & (rank < high))
                flags[text[among], places[rank[among]]] = True
                # the last gram of the map is its commonest, and tf is 1 or more
                sizes = np.bincount(text[among], minlength=len(some))
                has = np.flatnonzero(sizes)
                light[has, k] = weights.idf[rank[among[np.cumsum(sizes)[has] - 1]]] ** 2 / norms[has] * (1 - ROUNDING)
            maps.append(np.packbits(flags, axis=1))
            lightest.append(light)
        entry = np.sort(np.concatenate(entries)) if entries else np.empty(0, np.int64)
        at = _firsts(entry >> 36)
        yield _row(
            LISTED,
            {k: packed[k] for k in ("block", "rids", "copies", "lengths", "text")}
            | {
                "names": weights.names.tobytes(), "dfs": weights.dfs[weights.rank].tobytes(), "list_names": bits[(entry >> 36)[at]].tobytes(), "list_sizes": np.diff(np.append(at, len(entry))).astype(np.int32).tobytes(),
                "list_texts": (entry & ((1 << 20) - 1)).astype(np.min_scalar_type(len(texts.rids))).tobytes(), "list_parts": ((entry >> 20) & (STEPS - 1)).astype(np.uint8).tobytes(),
                "maps": np.concatenate(maps).tobytes(), "lightest": np.concatenate(lightest).tobytes(),
            },
        )

    return listed


class Lists:
    """Lists and maps of a block."""

    def __init__(self, row: dict):
        n = len(row["rids"]) // 8
        self.names, self.sizes = np.frombuffer(row["list_names"], np.uint64), np.frombuffer(row["list_sizes"], np.int32).astype(np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.texts, self.parts = np.frombuffer(row["list_texts"], np.min_scalar_type(n)), np.frombuffer(row["list_parts"], np.uint8)
        maps, lightest = np.frombuffer(row["maps"], np.uint64).reshape(n, 3, -1), np.frombuffer(row["lightest"], np.float32).reshape(n, 3)
        self.maps, self.lightest = [np.ascontiguousarray(maps[:, k]) for k in range(3)], [np.ascontiguousarray(lightest[:, k]) for k in range(3)]
        #: what would be lacking if nothing of the map was shared
        self.mapped = [_ones(m) * u for m, u in zip(self.maps, self.lightest)]


def _ones(maps: np.ndarray) -> np.ndarray:
    """Number of bits of each map, at most 255."""
    counts = np.bitwise_count(maps).view(np.uint32)[:, 0] * np.uint32(0x01010101)
    return (counts >> np.uint32(24)).astype(np.float32)


def _lacking(left: Lists, right: Lists, x: np.ndarray, y: np.ndarray, number: int) -> np.ndarray:
    """Sum of the parts of the norms of x and of y that the other lacks, at least, by one map."""
    shared = np.take(left.maps[number], x, axis=0)
    shared &= np.take(right.maps[number], y, axis=0)
    return left.mapped[number][x] + right.mapped[number][y] - _ones(shared) * (left.lightest[number][x] + right.lightest[number][y])


def _passing(left: Lists, right: Lists, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of positions that pass the bounds, by x."""
    common, at_left, at_right = np.intersect1d(left.names, right.names, assume_unique=True, return_indices=True)
    sizes = right.sizes[at_right]
    there = _spans(right.starts[at_right], sizes)
    there_text, there_key = right.texts[there].astype(np.int64), (np.repeat(np.arange(len(common)), sizes) << 9) | right.parts[there]
    begin = np.cumsum(sizes) - sizes
    sizes = left.sizes[at_left]
    here, gram = _spans(left.starts[at_left], sizes), np.repeat(np.arange(len(common)), sizes)
    here_text = left.texts[here].astype(np.int64)
    scale = (1 - least) / STEPS
    reach = np.maximum((1 - least / (1 - left.parts[here] * scale)) / scale, 0).astype(np.int64)
    begin = begin[gram]
    counts = np.searchsorted(there_key, (gram << 9) | reach, side="right") - begin
    ends, found, done = np.cumsum(counts), [np.empty((2, 0), np.int64)], 0
    # (1 - p)(1 - q) is largest where p = q
    most = 2 * (1 - np.sqrt(least)) + ROUNDING
    while done < len(counts):
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + MEETINGS, side="right")))
        n = counts[done:upto]
        x, y = np.repeat(here_text[done:upto], n), there_text[_spans(begin[done:upto], n)]
        done = upto
        if same:
            x, y = x[x < y], y[x < y]
        good = np.flatnonzero(_lacking(left, right, x, y, 0) <= most)
        x, y = x[good], y[good]
        good = _lacking(left, right, x, y, 1) + _lacking(left, right, x, y, 2) <= most
        found.append(np.stack((x[good], y[good])))
    pairs = np.concatenate(found, axis=1)
    keys = np.unique((pairs[0] << 32) | pairs[1])
    return keys >> 32, keys & ((1 << 32) - 1)


def _products(left: tuple[Texts, Weights], right: tuple[Texts, Weights], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of pairs of positions."""

    def postings(side: tuple[Texts, Weights], positions: np.ndarray):
        """(starts, sizes, name, weight) of the grams of the positions."""
        sizes, names, values = [], [], []
        for some, grams in side[0].counted(positions):
            text, rank, square, _ = side[1].weighted(grams)
            sizes.append(np.bincount(text, minlength=len(some)))
            names.append(side[1].order[rank])
            values.append(np.sqrt(square))
        size = np.concatenate(sizes)
        return np.cumsum(size) - size, size, np.concatenate(names), np.concatenate(values)

    result, mine, theirs = [], left[1].names, right[1].names
    place = np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)
    as_mine = np.where(mine[place] == theirs, place, len(mine))
    for i in range(0, len(x), PAIRS):
        (a, of_a), (b, of_b) = np.unique(x[i : i + PAIRS], return_inverse=True), np.unique(y[i : i + PAIRS], return_inverse=True)
        sides = []
        for side, positions, of in ((left, a, of_a), (right, b, of_b)):
            starts, size, name, value = postings(side, positions)
            at = _spans(starts[of], size[of])
            name = name if side is left else as_mine[name]
            sides.append(((np.repeat(np.arange(len(of)), size[of]) << 32) | name[at], value[at]))
        order = np.argsort(sides[0][0])
        keys, values = sides[0][0][order], sides[0][1][order]
        if not len(keys):
            result.append(np.zeros(len(of_a)))
            continue
        place = np.minimum(np.searchsorted(keys, sides[1][0]), len(keys) - 1)
        shared = keys[place] == sides[1][0]
        result.append(np.bincount(sides[1][0][shared] >> 32, values[place[shared]] * sides[1][1][shared], minlength=len(of_a)))
    return np.concatenate(result) if result else np.empty(0)


def _join(rows: int, threshold: float, least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of two blocks (columns l_ and r_) to pairs of texts."""

    def side(row: dict) -> tuple[Texts, Weights]:
        return Texts(row), Weights(np.frombuffer(row["names"], np.uint64), np.frombuffer(row["dfs"], np.int64), rows)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                here, there = ({k[2:]: v for k, v in row.items() if k[0] == s} for s in "lr")
                x, y = _passing(Lists(here), Lists(there), here["block"] == there["block"], least)
                if not len(x):
                    continue
                left, right = side(here), side(there)
                similarity = _products(left, right, x, y)
                good = similarity >= threshold - EPSILON
                (a, b), value = (left[0], right[0]), similarity[good]
                columns = [a.rids[x[good]], b.rids[y[good]], value, a.copies[x[good]], b.copies[y[good]]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "similarity", "a_copies", "b_copies"])

    return joined


# ---- join ---------------------------------------------------------------------


def _blocks(texts: int, characters: int) -> int:
    return max(1, -(-texts // BLOCK), -(-characters // BLOCK_CHARACTERS), min(LEAST_BLOCKS, -(-texts // SMALL_BLOCK)))


def _cuts(grams: DataFrame, rows: int) -> tuple[int, ...]:
    """Document frequencies up to which grams have the SHARES of all squared weights, about."""
    level = F.ceil(F.log("df") / F.log(F.lit(1.1)))
    weight = F.col("n") * F.pow(F.log((1 + rows) / (1 + F.col("df"))) + 1, 2)
    # some two hundred levels
    levels = sorted((r["level"], r["weight"]) for r in grams.groupBy(level.alias("level")).agg(F.sum(weight).alias("weight")).toLocalIterator())
    total, upto, cuts = sum(w for _, w in levels), 0.0, [1] * len(SHARES)
    for number, w in levels:
        upto += w
        cuts = [max(c, int(1.1**number)) if upto <= share * total else c for c, share in zip(cuts, SHARES)]
    return tuple(cuts)


def block_pairs(sides: list[tuple[DataFrame, int, int]], threshold: float) -> DataFrame:
    """(a, b, similarity, a_copies, b_copies) of texts with cosine >= threshold.

    sides: one table of (rid, text, copies), or two whose texts meet only those of
    the other, each with the texts and characters it has, about. Weights are those
    of all rows of all sides. Pairs of one table come once, in any order of ids.
    """
    counts = [_blocks(*size) for _, *size in sides]
    total_blocks, least = sum(counts), threshold**2 - ROUNDING
    packed = None
    for k, (classes, *_) in enumerate(sides):
        block = (F.pmod(F.xxhash64("rid"), F.lit(counts[k])) + sum(counts[:k])).cast("int")
        rows_ = classes.select(block.alias("block"), "rid", "text", "copies")
        packed = rows_ if packed is None else packed.unionByName(rows_)
    packed = durable(packed.repartitionById(total_blocks, "block").mapInArrow(_pack, PACKED))
    rows = packed.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    # a gram has one row a block
    df = F.sum("n").over(Window.partitionBy("gram"))
    grams = durable(packed.mapInArrow(_block_grams, "block int, gram bigint, n bigint").withColumn("df", df).filter(F.col("df") >= MIN_DF))
    columns = ["block", "rids", "copies", "lengths", "text"]
    mixed = packed.select(*columns, F.lit(None).cast("bigint").alias("gram"), F.lit(None).cast("bigint").alias("df"))
    mixed = mixed.unionByName(grams.select("block", "gram", "df"), allowMissingColumns=True)
    listed = durable(mixed.repartitionById(total_blocks, "block").mapInArrow(_list(rows, _cuts(grams, rows), least), LISTED))
    names = [x.split()[0] for x in LISTED.split(", ")]
    left, right = (listed.select(*(F.col(c).alias(f"{s}_{c}") for c in names)) for s in "lr")
    if len(sides) == 2:
        left, right = left.filter(F.col("l_block") < counts[0]), right.filter(F.col("r_block") >= counts[0])
        met = left.hint("shuffle_replicate_nl").crossJoin(right)
    else:
        met = left.hint("shuffle_replicate_nl").join(right, F.col("l_block") <= F.col("r_block"))
    return met.mapInArrow(_join(rows, threshold, least), "a bigint, b bigint, similarity double, a_copies bigint, b_copies bigint")
