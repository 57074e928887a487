"""Token budget per source, language and category (problem 1).

The tokenizer is an existing vocabulary file, loaded once per Python worker and
never trained here. Whole Arrow batches are encoded at a time; only counts
leave Python. Totals are pre-aggregated per (source, language, category) before
the cube expands them, so the shuffle carries small partial sums whatever the
skew of the sources.

Defined results: a null text has 0 tokens; special-token strings inside a text
count as ordinary text; null sources, categories and languages appear as
``(none)``, subtotals as ``*``; the language is the declared one in lower case,
else that of the question, else of the answer, else ``(none)``; empty tables
give an empty cube; texts of any length are encoded whole.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.keys import words
from loomline.llm.lang import detect_language

#: Vocabulary used where the caller names none; any file that ``load_tokenizer`` knows will do.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Splitting pattern that belongs to the byte-level vocabularies (fixed value).
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict[tuple[str, str], Callable[[list[str]], list[list[int]]]] = {}


def load_tokenizer(path: str, pattern: str = BYTE_LEVEL_PATTERN) -> Callable[[list[str]], list[list[int]]]:
    """Batch encoder of a vocabulary file: .tiktoken ranks, .json or .model.

    ``pattern`` is the splitting pattern that belongs to a .tiktoken vocabulary;
    the other formats carry their own.
    """
    if (path, pattern) not in _LOADED:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
            encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            # its batch call hands single texts to threads, which costs half as much again
            _LOADED[path, pattern] = lambda texts: [encoding.encode_ordinary(t) for t in texts]
        elif path.endswith(".json"):
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.encode_special_tokens = True
            _LOADED[path, pattern] = lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path, pattern] = lambda texts: piece.encode(texts, num_threads=1)
    return _LOADED[path, pattern]


def count_tokens(texts: list[str | None], path: str = TOKENIZER, pattern: str = BYTE_LEVEL_PATTERN) -> list[int]:
    """Exact token counts of a batch; null counts 0."""
    some = [t for t in texts if t]
    counts = iter([len(ids) for ids in load_tokenizer(path, pattern)(some)])
    return [next(counts) if t else 0 for t in texts]


def _counted(path: str, pattern: str, n_texts: int, with_lang: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [batch.column(i + 1).to_pylist() for i in range(n_texts)]
            columns = {"id": batch.column(0)} | {f"tokens_{i}": pa.array(count_tokens(t, path, pattern), pa.int64()) for i, t in enumerate(texts)}
            kept = range(n_texts + 1, batch.num_columns)
            if with_lang:
                langs = []
                for row in zip(batch.column(n_texts + 1).to_pylist(), *texts):
                    declared = (row[0] or "").strip().lower()
                    langs.append(declared or next((x for x in (detect_language(words(t)) for t in row[1:]) if x), None))
                columns["lang"] = pa.array(langs, pa.string())
                kept = kept[1:]
            columns |= {f"kept_{i}": batch.column(k) for i, k in enumerate(kept)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return run


def token_counts(df: DataFrame, id_column: str, text_columns: list[str], lang_column: str | None, kept: list[str], path: str = TOKENIZER, pattern: str = BYTE_LEVEL_PATTERN) -> DataFrame:
    """(id, one count per text column, lang, kept string columns) of every row; no lang without ``lang_column``.

    ``path`` must name the vocabulary on every worker (ship it with the job, or
    use a shared folder).
    """
    lang = [] if lang_column is None else ["lang"]
    columns = [F.col(id_column).cast("bigint").alias("id"), *(F.col(c).cast("string").alias(f"text_{i}") for i, c in enumerate(text_columns)), *(F.col(lang_column).cast("string").alias(c) for c in lang), *(F.col(c).cast("string").alias(f"kept_{i}") for i, c in enumerate(kept))]
    schema = ", ".join(["id bigint", *(f"tokens_{i} bigint" for i in range(len(text_columns))), *(f"{c} string" for c in lang), *(f"kept_{i} string" for i in range(len(kept)))])
    counted = df.select(*columns).mapInArrow(_counted(path, pattern, len(text_columns), bool(lang)), schema)
    return counted.select(F.col("id").alias(id_column), *(F.col(f"tokens_{i}").alias(f"{c}_tokens") for i, c in enumerate(text_columns)), *lang, *(F.col(f"kept_{i}").alias(c) for i, c in enumerate(kept)))


def token_budget(counted: DataFrame) -> DataFrame:
    """Cube of records and tokens over source, lang and category."""
    base = counted.groupBy(*(F.coalesce(F.col(c), F.lit("(none)")).alias(c) for c in ("source", "lang", "category"))).agg(F.count("*").alias("n"), F.sum("question_tokens").alias("q"), F.sum("answer_tokens").alias("a"))
    cube = base.cube("source", "lang", "category").agg(F.sum("n").alias("records"), F.sum("q").alias("question_tokens"), F.sum("a").alias("answer_tokens"))
    return cube.select(*(F.coalesce(F.col(c), F.lit("*")).alias(c) for c in ("source", "lang", "category")), "records", "question_tokens", "answer_tokens", (F.col("question_tokens") + F.col("answer_tokens")).alias("tokens"))
