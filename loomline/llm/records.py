"""Queries of the training-data problems on records (3 to 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.keys import FIELD_LABELS
from loomline.llm import canonical_map, form_duplicates, linked_split, quota_sample, split_overlap
from loomline.session import table


def _targets(spark: SparkSession, d: str) -> list[tuple[str, float]]:
    return [(r["split"], r["target_share"]) for r in table(spark, d, "split_targets").orderBy(F.desc("target_share"), "split").toLocalIterator()]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_split.linked_records(table(spark, d, "merged_dataset"), table(spark, d, "case_studies"))


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "merged_dataset")
    groups = linked_split.record_groups(records, table(spark, d, "case_studies"))
    return linked_split.stratified_group_split(groups, records, _targets(spark, d)).select("record_id", "group_id", "split")


def p3_split_report(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "merged_dataset")
    groups = linked_split.record_groups(records, table(spark, d, "case_studies"))
    return linked_split.split_report(linked_split.stratified_group_split(groups, records, _targets(spark, d)))


def _evaluation(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    columns = ["record_id", "split", "question", "source"]
    splits, validation = table(spark, d, "splits").select(columns), table(spark, d, "validation").select(columns)
    return splits.filter("split = 'train'"), splits.filter("split = 'test'").unionByName(validation.filter("split = 'validation'"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = split_overlap.expanded_pairs(*split_overlap.cross_split_overlaps(*_evaluation(spark, d)))
    return pairs.select(F.least("train_id", "eval_id").alias("record_id_a"), F.greatest("train_id", "eval_id").alias("record_id_b"))


def p4_overlap_report(spark: SparkSession, d: str) -> DataFrame:
    return split_overlap.overlap_report(*split_overlap.cross_split_overlaps(*_evaluation(spark, d), kept=("split", "source")))


def _sampled(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return quota_sample.quota_sample(table(spark, d, "python_balanced_1000"), table(spark, d, "sample_targets"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1].filter("short").select("category", "topic")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[0]


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return _sampled(spark, d)[1]


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return form_duplicates.form_groups(table(spark, d, "merged_dataset"))


def p6_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return form_duplicates.collapse_forms(table(spark, d, "merged_dataset"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical_map.map_to_reference(table(spark, d, "merged_dataset"), table(spark, d, "topic_reference"))


def p7_unmatched(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "merged_dataset")
    return canonical_map.unmatched_values(records, canonical_map.map_to_reference(records, table(spark, d, "topic_reference")))


QUERIES = {f.__name__: f for f in (p3_found, p3_split, p3_split_report, p4_found, p4_overlap_report, p5_found, p5_sample, p5_report, p6_found, p6_collapsed, p7_found, p7_unmatched)}



# ---- SQL twins, over whole tables -------------------------------------------


def sql_words(x: str) -> str:
    """Words of a text in DuckDB: runs of letters and digits after composition."""
    return f"regexp_extract_all(lower(nfc_normalize({x})), '[\\p{{L}}\\p{{N}}]+')"


_FOLDED = "replace(lower(nfc_normalize(question)), 'ß', 'ss')"
#: t without invisible characters.
_VISIBLE = r"regexp_replace(t, '\p{Cf}', '', 'g')"
_BLANKS = r"[\s\p{Z}\p{Cf}]*"
_LABEL = f"(?:{'|'.join(FIELD_LABELS)}){_BLANKS}:"
_BEFORE = r"(?:^|[^\p{L}\p{N}])"


def _letters(x: str) -> str:
    return f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')"


def _field(label: str) -> str:
    own = f"{_BEFORE}{label}{_BLANKS}:"
    text = f"regexp_extract(t, '(?s){own}(.*?)(?:[^\\p{{L}}\\p{{N}}]{_LABEL}|$)', 1)"
    return f"CASE WHEN regexp_matches(t, '{own}') THEN '{label}' || {_letters(text)} ELSE '' END"


#: k: the form key of every question.
_FORM_KEYS = f"""
WITH RECURSIVE q AS (SELECT record_id, {_FOLDED} AS t FROM merged_dataset WHERE question IS NOT NULL),
 k AS (SELECT record_id, CASE WHEN regexp_matches(t, '^[^\\p{{L}}\\p{{N}}]*{_LABEL}') AND len(regexp_extract_all(t, '{_BEFORE}{_LABEL}')) >= 2
   THEN {' || '.join(map(_field, FIELD_LABELS))} ELSE {_letters('t')} END AS k FROM q)
"""

# questions with the same fields in other order have the same words
_OVERLAPS = f"""
WITH u AS (SELECT record_id, split, source, question FROM splits UNION ALL SELECT record_id, split, source, question FROM validation),
 k AS (SELECT record_id, split = 'train' AS train, {_letters(_FOLDED)} AS k, list_distinct({sql_words('question')}) AS w FROM u WHERE question IS NOT NULL),
 f AS (SELECT record_id, train, len(w) AS n, unnest(w) AS w FROM k),
 j AS (SELECT a.record_id AS a, b.record_id AS b FROM f a JOIN f b ON a.w = b.w AND a.train AND NOT b.train
       GROUP BY a.record_id, b.record_id, a.n, b.n HAVING 4 * count(*) >= 3 * (a.n + b.n - count(*))),
 x AS (SELECT a.record_id AS a, b.record_id AS b FROM k a JOIN k b ON a.k = b.k AND a.train AND NOT b.train WHERE a.k <> ''),
 pairs AS (SELECT DISTINCT a, b FROM (SELECT * FROM j UNION ALL SELECT * FROM x))
"""

SQL = {
    "p3_found": _FORM_KEYS + f""",
 r AS (SELECT record_id, lower(nfc_normalize(question)) AS t FROM merged_dataset WHERE question IS NOT NULL),
 v AS (SELECT record_id, unnest(list_distinct(list_concat({sql_words('t')}, {sql_words(_VISIBLE)}))) AS w FROM r),
 x AS (SELECT record_id, CASE WHEN regexp_full_match(w, 'cs[0-9]{{7}}') THEN substr(w, 3) ELSE w END AS w FROM v),
 c AS (SELECT case_id, {sql_words('name')}[1] AS w FROM case_studies UNION SELECT case_id, regexp_extract(case_code, '[0-9]{{7}}') FROM case_studies),
 m AS (SELECT DISTINCT k.k, c.case_id FROM x JOIN c USING (w) JOIN k USING (record_id) WHERE k.k <> ''),
 link AS (SELECT DISTINCT a.case_id AS a, b.case_id AS b FROM m a JOIN m b USING (k)),
 reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
 comp AS (SELECT a AS case_id, min(b) AS comp FROM reach GROUP BY a),
 kc AS (SELECT m.k, min(comp) AS comp FROM m JOIN comp USING (case_id) GROUP BY m.k),
 g AS (SELECT record_id, coalesce('case ' || comp, 'key ' || k.k) AS g FROM k LEFT JOIN kc ON kc.k = k.k WHERE k.k <> ''),
 s AS (SELECT g, min(record_id) AS group_id FROM g GROUP BY g HAVING count(*) > 1)
SELECT record_id, group_id FROM g JOIN s USING (g)
""",
    "p4_found": _OVERLAPS + "SELECT least(a, b) AS record_id_a, greatest(a, b) AS record_id_b FROM pairs",
    "p4_overlap_report": _OVERLAPS + """, n AS (SELECT b AS record_id, count(*) AS n FROM pairs GROUP BY b)
SELECT split, coalesce(source, '') AS source, count(*) AS records, count(n) AS overlapping, coalesce(sum(n), 0)::BIGINT AS pairs
FROM u LEFT JOIN n USING (record_id) WHERE split IN ('test', 'validation') GROUP BY 1, 2""",
    "p6_found": _FORM_KEYS + """,
 g AS (SELECT k, min(record_id) AS group_id FROM k WHERE k <> '' GROUP BY k HAVING count(*) > 1)
SELECT record_id, group_id FROM k JOIN g USING (k)
""",
    "p6_collapsed": _FORM_KEYS + "SELECT min(record_id) AS record_id, count(*) AS copies FROM k WHERE k <> '' GROUP BY k",
    "p5_found": """
        WITH have AS (
          SELECT lower(regexp_replace(category, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS c,
                 lower(regexp_replace(topic, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g')) AS t, count(*) AS n
          FROM python_balanced_1000 GROUP BY 1, 2)
        SELECT s.category, s.topic FROM sample_targets s
        LEFT JOIN have h ON h.c = lower(trim(s.category)) AND h.t = lower(trim(s.topic))
        WHERE coalesce(h.n, 0) < s.target_share * (SELECT count(*) * 0.2 FROM python_balanced_1000)
    """,
}
