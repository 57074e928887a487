"""Reading level of each document (problem 10).

Every grade level has a smoothed unigram language model; a document gets the
grade under which its text is likeliest (posterior with equal priors), and the
band that grade lies in. Levels are defined by the difficulty

    D = words per sentence + percentage of words of more than six characters

of the prose, which depends on the shape of words and not on which words they
are. So the models are unigram models over word shapes: their symbols are a
long word, another word and the end of a sentence (all words of a shape back
off to it completely). The vocabulary is three symbols at any corpus size.

* Grades are the cells of a fixed grid of sentence length and share of long
  words; a band holds all grades whose centre the formula puts there.
* Formula-seeded: each model starts with ``SEED`` symbols in the proportions of
  its grade's centre (the smoothing prior; no symbol has probability zero).
* Trained: it adds the symbol counts of all documents of its grade, labelled by
  the formula. They are summed where the texts are read, by batch and grade, so
  only counts leave (one row a grade); grading reads the texts a second time.

The formula labels training documents only. It has no part in the result.

Defined results: null, empty and short texts (under 50 words of prose) have no
band; equal posteriors go to the lower grade; repeated documents are graded
each; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.keys import words

BOUNDARIES = (30.0, 45.0, 60.0)
LEAST_WORDS = 50
LONG_WORD = 6
#: Symbols of the smoothing prior of each grade.
SEED = 200.0
#: Percentage points of long words, and words a sentence, of a grade.
SHARE_STEP, LENGTH_STEP = 2.5, 2
_FENCED = re.compile(r"^[ \t]*```.*?(?:^[ \t]*```[^\n]*$|\Z)", re.M | re.S)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_NOT_PROSE = re.compile(r"\s*(?:#|[-*+•] |\d+[.)] |\||\[)")
_END = re.compile(r"[.!?](?=\s|$)")


def sentences(text: str | None) -> list[list[str]]:
    """Sentences of the prose of a text, as words; sentences without a word are left out."""
    if not text:
        return []
    if "```" in text:
        text = _FENCED.sub("\n\n", text)
    if "<" in text:
        text = _TAG.sub("", text)
    blocks, block = [], []
    for line in text.split("\n"):
        if not line.strip() or _NOT_PROSE.match(line):
            blocks.append(" ".join(block))
            block = []
        else:
            block.append(line)
    blocks.append(" ".join(block))
    return [own for b in blocks if b for part in _END.split(b) if (own := words(part))]


def difficulty(parts: list[list[str]]) -> tuple[float | None, int]:
    """(D, words); D is None for prose that is too short."""
    n = sum(map(len, parts))
    if n < LEAST_WORDS:
        return None, n
    long = sum(len(w) > LONG_WORD for own in parts for w in own)
    return n / len(parts) + 100.0 * long / n, n


def band_of(d: float) -> int:
    return 1 + sum(d >= b for b in BOUNDARIES)


def shapes(parts: list[list[str]]) -> tuple[int, int, int]:
    """Symbol counts of a prose text: long words, other words, sentence ends."""
    long = sum(len(w) > LONG_WORD for own in parts for w in own)
    return long, sum(map(len, parts)) - long, len(parts)


def grade_grid() -> np.ndarray:
    """(grades, 3): words per sentence, percentage of long words and band of each grade's centre."""
    lengths = [*range(1, 4), *range(4, 64, LENGTH_STEP), *(64 * 1.25**k for k in range(36))]
    shares = np.arange(0, 100 + SHARE_STEP / 2, SHARE_STEP)
    return np.array([(s, h, band_of(s + h)) for s in lengths for h in shares])


def nearest_grade(grid: np.ndarray, long: int, other: int, ends: int) -> int:
    """Grade that the formula gives a training document: the nearest centre of its band."""
    n = long + other
    length, share = n / ends, 100.0 * long / n
    apart = np.abs(grid[:, 0] - length) / np.maximum(LENGTH_STEP, grid[:, 0] / 4) + np.abs(grid[:, 1] - share) / SHARE_STEP
    return int(np.argmin(np.where(grid[:, 2] == band_of(length + share), apart, np.inf)))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Symbol counts per grade of the labelled documents, one row per batch and grade."""
    grid = grade_grid()
    for batch in batches:
        counts: dict[int, np.ndarray] = {}
        for text in batch.column(0).to_pylist():
            long, other, ends = shapes(sentences(text))
            if long + other >= LEAST_WORDS:
                grade = nearest_grade(grid, long, other, ends)
                counts[grade] = counts.get(grade, 0) + np.array([long, other, ends])
        sums = np.array(list(counts.values()), np.int64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), *(pa.array(sums[:, i]) for i in range(3))], names=["grade", "long", "other", "ends"])


class GradeModels:
    """Smoothed unigram models of all grades."""

    def __init__(self, counts: list[tuple[int, int, int, int]]):
        grid = grade_grid()
        self.band = grid[:, 2].astype(np.int32)
        length, share = grid[:, 0], np.clip(grid[:, 1] / 100, 0.002, 0.998)
        table = SEED * np.stack([length * share, length * (1 - share), np.ones(len(grid))], axis=1) / (length + 1)[:, None]
        for grade, *own in counts:
            table[grade] += own
        self.log = np.log(table / table.sum(axis=1, keepdims=True)).T

    def grade(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(grade of the highest posterior, its log odds against the best grade of another band)."""
        grades, odds = [], []
        for start in range(0, len(symbols), 512):
            score = symbols[start : start + 512] @ self.log
            best = score.argmax(axis=1)
            other = np.where(self.band[None, :] == self.band[best][:, None], -np.inf, score).max(axis=1)
            grades.append(best)
            odds.append(score.max(axis=1) - other)
        return (np.concatenate(grades), np.concatenate(odds)) if grades else (np.zeros(0, np.int64), np.zeros(0))


def train_models(documents: DataFrame, sample: int | None = None, text_column: str = "text", id_column: str = "doc_id") -> list[tuple[int, int, int, int]]:
    """Symbol counts for ``GradeModels``, one row per grade at most, from all documents.

    sample: only for trials, about so many documents (a hash range of the ids).
    """
    chosen = documents.select(F.col(text_column).cast("string").alias("text"))
    if sample is not None:
        share = min(1.0, sample / max(1, documents.count()))
        chosen = documents.filter(F.pmod(F.xxhash64(F.col(id_column)), F.lit(1 << 30)) < F.lit(math.ceil((1 << 30) * share))).select(F.col(text_column).cast("string").alias("text"))
    counts = chosen.mapInArrow(_labelled, "grade int, long bigint, other bigint, ends bigint").groupBy("grade").agg(*(F.sum(c).alias(c) for c in ("long", "other", "ends")))
    return [tuple(r) for r in counts.collect()]


def _graded(shared, n_kept: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = GradeModels(shared.value)
        for batch in batches:
            rows, symbols = [], []
            for k, text in enumerate(batch.column(1).to_pylist()):
                own = shapes(sentences(text))
                if own[0] + own[1] >= LEAST_WORDS:
                    rows.append(k)
                    symbols.append(own)
            grades, odds = models.grade(np.array(symbols, float).reshape(-1, 3))
            kept = [batch.column(2 + i).take(pa.array(rows, pa.int64())) for i in range(n_kept)]
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(models.band[grades]), pa.array(grades, pa.int32()), pa.array(odds, pa.float64()), *kept]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "band", "grade", "log_odds", *(f"kept_{i}" for i in range(n_kept))])

    return run


def reading_levels(documents: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, band, grade, log_odds, kept columns as text) of every document with enough prose.

    ``log_odds``: how much likelier its grade is than the best one of another band.
    """
    shared = documents.sparkSession.sparkContext.broadcast(train_models(documents))
    texts = documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), *(F.col(c).cast("string").alias(f"kept_{i}") for i, c in enumerate(kept)))
    schema = "doc_id bigint, band int, grade int, log_odds double" + "".join(f", kept_{i} string" for i in range(len(kept)))
    return texts.mapInArrow(_graded(shared, len(kept)), schema).select("doc_id", "band", "grade", "log_odds", *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(kept)))


PROFILED = ("lang", "source", "kind")


def level_profile(levels: DataFrame) -> DataFrame:
    """(lang, source, kind, band, documents) of levels that kept the ``PROFILED`` columns."""
    return levels.groupBy(*(F.coalesce(F.lower(F.col(c)), F.lit("(none)")).alias(c) for c in PROFILED), "band").agg(F.count("*").alias("documents"))
