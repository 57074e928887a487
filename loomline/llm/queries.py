"""Queries of the training-data problems: those on text (1, 2, 8, 9, 10) and those of ``records``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import grading, leak, mixing, pairs, records, tokens
from loomline.session import table

_QA = ["record_id", "question", "answer", "lang", "source", "category"]


def _split_tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "splits").select(_QA).unionByName(table(spark, d, "validation").select(_QA))
    return tokens.token_counts(rows, "record_id", ["question", "answer"], "lang", ["source", "category"])


def p1_token_budget(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_budget(_split_tokens(spark, d))


def p1_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return _split_tokens(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.broken_pairs(table(spark, d, "merged_dataset")).select("record_id", "defect")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "merged_dataset")
    return pairs.defect_report(pairs.broken_pairs(rows), rows)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_items(table(spark, d, "documents"), table(spark, d, "test_items")).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    return leak.leak_report(leak.leaked_items(table(spark, d, "documents"), table(spark, d, "test_items")))


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    leaked = leak.leaked_items(documents, table(spark, d, "test_items"))
    return leak.clean_documents(documents.select("doc_id", "source"), leaked)


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(mixing.document_tokens(table(spark, d, "documents")), table(spark, d, "source_weights"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1].filter("short").select("source")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return grading.reading_levels(table(spark, d, "documents")).select("doc_id", "band")


def p10_profile(spark: SparkSession, d: str) -> DataFrame:
    return grading.level_profile(grading.reading_levels(table(spark, d, "documents"), kept=grading.PROFILED))


QUERIES = records.QUERIES | {f.__name__: f for f in (p1_token_budget, p1_token_counts, p2_found, p2_report, p8_found, p8_leaked_items, p8_clean, p9_found, p9_mix, p9_report, p10_found, p10_profile)}


def _words(x: str) -> str:
    return f"regexp_extract_all(lower(nfc_normalize({x})), '[\\p{{L}}\\p{{N}}]+')"


def _grams(table_: str, ident: str) -> str:
    four = "list_transform(range(1, greatest(len(w) - 2, 1)), lambda k: list_aggregate(w[k:k + 3], 'string_agg', ' '))"
    return f"SELECT DISTINCT {ident}, unnest({four}) AS g FROM (SELECT {ident}, {_words('text')} AS w FROM {table_})"


#: bands: (doc_id, band) by the formula.
_BANDS = f"""
WITH a AS (SELECT doc_id, regexp_replace(text, '(?ms)^[ \\t]*```.*?(?:^[ \\t]*```[^\\n]*$|\\z)', chr(10) || chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL),
 b AS (SELECT doc_id, regexp_replace(t, '</?[A-Za-z!][^<>]*>', '', 'g') AS t FROM a),
 c AS (SELECT doc_id, regexp_replace(t, '(?m)^[\\s\\p{{Z}}]*(?:#|[-*+•] |[0-9]+[.)] |\\||\\[)[^\\n]*$', chr(30), 'g') AS t FROM b),
 e AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\\n[\\s\\p{{Z}}]*\\n', chr(30), 'g'), '[.!?](?:[\\s\\p{{Z}}]|$)', chr(30), 'g') AS t FROM c),
 s AS (SELECT doc_id, unnest(string_split(t, chr(30))) AS s FROM e),
 w AS (SELECT doc_id, {_words('s')} AS w FROM s),
 x AS (SELECT doc_id, sum(len(w)) AS n, count(*) FILTER (len(w) > 0) AS k, sum(len(list_filter(w, lambda y: length(y) > 6))) AS l FROM w GROUP BY 1),
 y AS (SELECT doc_id, n / k + 100.0 * l / n AS d FROM x WHERE n >= 50),
 bands AS (SELECT doc_id, (1 + (d >= 30)::INT + (d >= 45)::INT + (d >= 60)::INT)::INT AS band FROM y)
"""

_LEAKS = f"""
WITH dg AS ({_grams('documents', 'doc_id')}), ig AS ({_grams('test_items', 'item_id')}), n AS (SELECT item_id, count(*) AS n FROM ig GROUP BY 1),
 leaks AS (SELECT doc_id, item_id FROM dg JOIN ig USING (g) JOIN n USING (item_id) GROUP BY doc_id, item_id, n.n HAVING 2 * count(*) >= n.n)
"""

#: Tokenizers, defect rules and draws are not in SQL; those queries are tested against brute force.
SQL: dict[str, str] = records.SQL | {
    "p8_found": _LEAKS + "SELECT doc_id, item_id FROM leaks",
    "p8_clean": _LEAKS + "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaks)",
    "p10_found": _BANDS + "SELECT * FROM bands",
    "p10_profile": _BANDS + "SELECT coalesce(lower(lang), '(none)') AS lang, coalesce(lower(source), '(none)') AS source, coalesce(lower(kind), '(none)') AS kind, band, count(*) AS documents FROM bands JOIN documents USING (doc_id) GROUP BY 1, 2, 3, 4",
}
