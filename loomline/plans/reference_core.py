"""Queries over text, duplicates, classifiers, profiles, samples and exact overlaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import classify
from loomline.functions.text import clean_text, key_marks_to_blanks, key_trimmed, key_with_marks, key_without_marks, or_default
from loomline.operators import dedup, leakage, profile, sampling
from loomline.operators.order import row_numbers
from loomline.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}

# the same classes in DuckDB's regular expressions
_WS = r"[\s\p{Z}\x1c-\x1f\x{85}]+"
_PUNCT = r"[^\p{L}\p{N}_\s\p{Z}\x1c-\x1f\x{85}]"


def sql_clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_WS}', ' ', 'g'))"


def sql_n1(x: str) -> str:
    return sql_clean(f"regexp_replace(lower({sql_clean(x)}), '{_PUNCT}', '', 'g')")


def sql_n2(x: str) -> str:
    return sql_clean(f"regexp_replace(lower({sql_clean(x)}), '{_PUNCT}', ' ', 'g')")


def sql_n3(x: str) -> str:
    return sql_clean(f"lower(coalesce({x}, ''))")


def sql_n4(x: str) -> str:
    return f"lower(regexp_replace(coalesce({x}, ''), '^{_WS}|{_WS}$', '', 'g'))"


def sql_default(x: str, default: str) -> str:
    return f"coalesce(nullif({sql_clean(x)}, ''), '{default}')"


def sql_any(text: str, signs) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, s.replace("'", "''")) for s in signs) + ")"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def merged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "merged_dataset")


Q, A = sql_clean("question"), sql_clean("answer")
_REASON = f"CASE WHEN {Q} = '' THEN 'missing question' WHEN {A} = '' THEN 'missing answer' WHEN length({A}) < 30 THEN 'short answer' END"


# ---- text and duplicates -------------------------------------------------


@query(f"""
WITH c AS (SELECT doc_id, coalesce(lower(lang), '') AS lang, {sql_clean('text')} AS text, {sql_n1('text')} AS k FROM documents),
     w AS (SELECT k, min(doc_id) AS doc_id FROM c WHERE length(text) >= 30 GROUP BY k)
SELECT lang, count(*) AS records, sum(length(text))::BIGINT AS characters FROM c JOIN w USING (doc_id) GROUP BY lang
""")
def clean_dedup(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.coalesce(F.lower("lang"), F.lit("")).alias("lang"), clean_text("text").alias("text"), key_without_marks("text").alias("key")).filter(F.length("text") >= 30)
    # the winner's language and length travel with it, so the text itself is not shuffled
    first = rows.groupBy(F.md5("key").alias("key")).agg(F.min_by(F.struct("lang", F.length("text").alias("n")), "doc_id").alias("w"))
    return first.groupBy("w.lang").agg(F.count("*").alias("records"), F.sum("w.n").alias("characters"))


@query(f"""
WITH r AS (SELECT record_id, {_REASON} AS reason, {sql_n1('question')} AS k FROM merged_dataset),
     s AS (SELECT coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason IS NULL, k ORDER BY record_id) = 1 THEN 'kept' ELSE 'duplicate' END) AS reason FROM r)
SELECT reason, count(*) AS records FROM s GROUP BY reason
""")
def drop_reasons(spark, d):
    return dedup.drop_reasons(merged(spark, d))


@query(f"""
SELECT min(record_id) AS rid, {sql_n1('question')} AS key FROM merged_dataset
WHERE {_REASON} IS NULL GROUP BY 2
""")
def dedup_n1(spark, d):
    return dedup.deduplicated(merged(spark, d))


@query(f"""
WITH u AS (SELECT 0 AS file, record_id AS rid, {sql_n2('question')} AS key FROM splits
           UNION ALL SELECT 1, record_id, {sql_n2('question')} FROM validation),
     r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY file, rid) AS n FROM u WHERE key <> '')
SELECT file, rid, key FROM r WHERE n = 1
""")
def dedup_n2(spark, d):
    return dedup.merged_first_wins([table(spark, d, "splits"), table(spark, d, "validation")])


@query(f"""
WITH k AS (SELECT {sql_n2('question')} AS key, coalesce(source, '') AS source FROM merged_dataset),
     g AS (SELECT key, count(*) AS n, count(DISTINCT source) AS s FROM k WHERE key <> '' GROUP BY key)
SELECT count(*) AS unique_keys, count(*) FILTER (n > 1) AS repeated_keys, coalesce(sum(n - 1), 0)::BIGINT AS surplus_rows, count(*) FILTER (s > 1) AS keys_in_sources FROM g
""")
def dup_stats(spark, d):
    return dedup.duplicate_stats(merged(spark, d), key_marks_to_blanks("question"))


@query(f"""
SELECT {sql_n1('question')} AS key, count(*) AS copies FROM merged_dataset WHERE {sql_n1('question')} <> ''
GROUP BY 1 HAVING count(*) > 1 ORDER BY copies DESC, key LIMIT 20
""")
def top_dups(spark, d):
    return dedup.top_duplicates(merged(spark, d), key_without_marks("question"))


@query(f"""
SELECT record_id, md5({sql_n1('question')}) AS n1, md5({sql_n2('question')}) AS n2, md5({sql_n3('question')}) AS n3, md5({sql_n4('question')}) AS n4 FROM merged_dataset
""")
def norm_variants(spark, d):
    keys = {"n1": key_without_marks, "n2": key_marks_to_blanks, "n3": key_with_marks, "n4": key_trimmed}
    return merged(spark, d).select("record_id", *(F.md5(f("question")).alias(n) for n, f in keys.items()))


@query(f"""
SELECT count(*) AS keyed, count(*) - count(DISTINCT k) AS repeats FROM (SELECT {sql_n4('question')} AS k FROM merged_dataset) WHERE k <> ''
""")
def incremental_dups(spark, d):
    keyed = merged(spark, d).select(key_trimmed("question").alias("k")).filter("k <> ''")
    return keyed.agg(F.count("*").alias("keyed"), (F.count("*") - F.count_distinct("k")).alias("repeats"))


@query(f"""
SELECT record_id, coalesce(nullif({sql_clean('topic')}, ''), {sql_clean('category')}) AS label, {sql_clean('topic')} = '' AS fell_back FROM merged_dataset
""")
def coalesce_on_empty(spark, d):
    topic = clean_text("topic")
    return merged(spark, d).select("record_id", F.coalesce(F.nullif(topic, F.lit("")), clean_text("category")).alias("label"), (topic == "").alias("fell_back"))


@query(f"""
SELECT record_id, {Q} AS question, {A} AS answer, 'Python' AS topic, 'Python' AS category, '' AS level, 'python_pool.jsonl' AS source
FROM merged_dataset WHERE source = 'python_pool.jsonl' AND {_REASON} IS NULL
""")
def prepared_records(spark, d):
    rows = merged(spark, d).filter("source = 'python_pool.jsonl'").filter(dedup.drop_reason("question", "answer").isNull())
    return rows.select("record_id", clean_text("question").alias("question"), clean_text("answer").alias("answer"), F.lit("Python").alias("topic"), F.lit("Python").alias("category"), F.lit("").alias("level"), F.lit("python_pool.jsonl").alias("source"))


def _good():
    return (F.length(clean_text("question")) >= 10) & F.length(clean_text("answer")).between(30, 10000)


@query(f"""SELECT record_id FROM merged_dataset WHERE length({Q}) >= 10 AND length({A}) BETWEEN 30 AND 10000""")
def quality_filter(spark, d):
    return merged(spark, d).filter(_good()).select("record_id")


@query(f"""SELECT record_id, length(question) BETWEEN 1 AND 8000 AND {Q} <> '' AS valid FROM merged_dataset WHERE question IS NOT NULL""")
def input_validation(spark, d):
    return merged(spark, d).filter("question is not null").select("record_id", (F.length("question").between(1, 8000) & (clean_text("question") != "")).alias("valid"))


@query("""SELECT record_id, row_number() OVER (ORDER BY record_id) AS position, left(question, 150) AS head FROM merged_dataset""")
def row_positions(spark, d):
    rows = merged(spark, d).select("record_id", F.substring("question", 1, 150).alias("head"))
    return rows.join(row_numbers(rows, "record_id", [F.col("record_id")]), "record_id").select("record_id", F.col("number").alias("position"), "head")


# ---- classifiers ----------------------------------------------------------

_TEXT = "lower(" + sql_clean("topic") + " || ' ' || " + sql_clean("question") + " || ' ' || " + sql_clean("answer") + ")"


def _text():
    return F.lower(F.concat_ws(" ", clean_text("topic"), clean_text("question"), clean_text("answer")))


def _scored_sql() -> str:
    scores = ", ".join("{{'score': {}, 'rank': {}, 'topic': '{}'}}".format(" + ".join("contains(t, '{}')::INT".format(k) for k in keywords), -i, topic) for i, (topic, keywords) in enumerate(classify.SCORED_TOPICS.items()))
    return f"""
WITH x AS (SELECT record_id, {_TEXT} AS t FROM merged_dataset),
     b AS (SELECT record_id, list_max([{scores}]) AS best FROM x)
SELECT record_id, CASE WHEN best.score > 0 THEN best.topic ELSE '{classify.SCORED_DEFAULT}' END AS detected FROM b
"""


@query(_scored_sql())
def topic_score(spark, d):
    return merged(spark, d).select("record_id", _text().alias("t")).select("record_id", classify.scored_topic(F.col("t")).alias("detected"))


@query(
    f"WITH x AS (SELECT {_TEXT} AS t FROM merged_dataset), l AS (SELECT list_filter(["
    + ", ".join(f"CASE WHEN {sql_any('t', k)} THEN '{topic}' END" for topic, k in classify.LABEL_TOPICS.items())
    + "], lambda z: z IS NOT NULL) AS ls FROM x) SELECT label, count(*) AS records FROM (SELECT unnest(CASE WHEN len(ls) = 0 THEN ['Other'] ELSE ls END) AS label FROM l) GROUP BY label"
)
def topic_multilabel(spark, d):
    rows = merged(spark, d).select(_text().alias("t"))
    return rows.select(F.explode(classify.topic_labels(F.col("t"))).alias("label")).groupBy("label").agg(F.count("*").alias("records"))


@query(
    "WITH x AS (SELECT " + sql_n3("question || ' ' || coalesce(answer, '')") + " AS t FROM merged_dataset) SELECT language, count(*) AS records FROM (SELECT CASE "
    + " ".join(f"WHEN {sql_any('t', s)} THEN '{n}'" for n, s in classify.LANGUAGE_SIGNS)
    + " ELSE 'Other' END AS language FROM x) GROUP BY language"
)
def language_detect(spark, d):
    text = key_with_marks(F.concat(F.col("question"), F.lit(" "), F.coalesce("answer", F.lit(""))))
    return merged(spark, d).select(text.alias("t")).groupBy(classify.programming_language(F.col("t")).alias("language")).agg(F.count("*").alias("records"))


@query(
    f"SELECT record_id, CASE lower({sql_clean('level')}) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in classify.LEVELS.items()) + f" ELSE '' END AS level, {sql_default('category', 'Unknown')} AS category, {sql_default('topic', 'General')} AS topic FROM merged_dataset"
)
def level_map(spark, d):
    return merged(spark, d).select("record_id", classify.level_name("level").alias("level"), or_default("category", "Unknown").alias("category"), or_default("topic", "General").alias("topic"))


@query(f"SELECT count(*) AS records, count(*) FILTER ({sql_any('lower(answer)', classify.CODE_SIGNS)}) AS with_code FROM merged_dataset")
def code_presence(spark, d):
    return merged(spark, d).agg(F.count("*").alias("records"), F.count_if(classify.any_of(F.lower("answer"), classify.CODE_SIGNS)).alias("with_code"))


def reference_keywords(spark: SparkSession, d: str) -> dict[str, list[str]]:
    """Keyword table of the ordered classifier: topics of the fixed reference list, by category."""
    found: dict[str, list[str]] = {}
    for r in table(spark, d, "topic_reference").orderBy("topic_id").limit(100_000).toLocalIterator():
        found.setdefault(r["category"], []).append(r["topic"].lower())
    return found


@query(f"""
WITH m AS (SELECT record_id, lower({sql_clean('topic')}) AS t1, {_TEXT} AS t2 FROM merged_dataset),
     c AS (SELECT category, min(topic_id) AS ord FROM topic_reference GROUP BY category),
     r AS (SELECT lower(topic) AS k, category, ord FROM topic_reference JOIN c USING (category)),
     h AS (SELECT record_id, min({{'pass': CASE WHEN contains(t1, k) THEN 1 ELSE 2 END, 'ord': ord, 'category': category}}) AS best FROM m JOIN r ON contains(t1, k) OR contains(t2, k) GROUP BY record_id)
SELECT m.record_id, coalesce(h.best.category, 'Other') AS category FROM m LEFT JOIN h USING (record_id)
""")
def category_rule(spark, d):
    rows = merged(spark, d).select("record_id", F.lower(clean_text("topic")).alias("t1"), _text().alias("t2"))
    return rows.select("record_id", classify.ordered_category(F.col("t1"), F.col("t2"), reference_keywords(spark, d)).alias("category"))


# ---- profiles ---------------------------------------------------------------


def _dist_sql(value: str, keep: str = "") -> str:
    return f"WITH c AS (SELECT {value} AS value, count(*) AS records FROM merged_dataset GROUP BY 1) SELECT value, records, round(100 * records / (SELECT sum(records) FROM c), 4) AS percent FROM c {keep}"


@query(_dist_sql(sql_default("category", "Unknown")))
def dist_category(spark, d):
    return profile.distribution(merged(spark, d), or_default("category", "Unknown"))


@query(_dist_sql(sql_clean("source")))
def dist_source(spark, d):
    return profile.distribution(merged(spark, d), clean_text("source"))


@query(_dist_sql(sql_default("topic", "General")))
def dist_topic(spark, d):
    return profile.distribution(merged(spark, d), or_default("topic", "General"))


@query(_dist_sql(sql_clean("level")))
def dist_level(spark, d):
    return profile.distribution(merged(spark, d), clean_text("level"))


@query(_dist_sql(sql_clean("level"), "WHERE value <> ''"))
def dist_level_excl_blank(spark, d):
    return profile.distribution(merged(spark, d), clean_text("level"), blank_counts=False)


@query(f"SELECT {sql_default('category', 'Other')} AS category, {sql_default('level', 'Unknown')} AS level, count(*) AS records FROM merged_dataset GROUP BY 1, 2")
def stratum_counts(spark, d):
    return merged(spark, d).groupBy(or_default("category", "Other").alias("category"), or_default("level", "Unknown").alias("level")).agg(F.count("*").alias("records"))


@query(f"SELECT {sql_clean('topic')} AS topic, count(*) AS records FROM merged_dataset WHERE {sql_clean('category')} = 'Other' GROUP BY 1")
def other_topics(spark, d):
    return merged(spark, d).filter(clean_text("category") == "Other").groupBy(clean_text("topic").alias("topic")).agg(F.count("*").alias("records"))


@query(f"""
SELECT count(*) AS total, count(*) FILTER ({Q} = '') AS empty_questions, count(*) FILTER ({A} = '') AS empty_answers,
  count(*) FILTER ({sql_n4('question')} <> '') - count(DISTINCT nullif({sql_n4('question')}, '')) AS repeated_questions,
  round(avg(length({Q})), 4) AS mean_question, round(avg(length({A})), 4) AS mean_answer FROM merged_dataset
""")
def file_profile(spark, d):
    return profile.file_profile(merged(spark, d), key_trimmed("question"))


@query(f"""
SELECT count(*) AS total, count(*) FILTER (q = 0) AS empty_questions, count(*) FILTER (q > 0 AND q < 10) AS short_questions,
  count(*) FILTER (a = 0) AS empty_answers, count(*) FILTER (a > 0 AND a < 30) AS very_short_answers, count(*) FILTER (a >= 30 AND a < 100) AS short_answers,
  count(*) FILTER (a > 3000 AND a <= 10000) AS long_answers, count(*) FILTER (a > 10000) AS very_long_answers,
  count(*) FILTER (t = '') AS missing_topic, count(*) FILTER (c = '') AS missing_category, count(*) FILTER (l = '') AS missing_level
FROM (SELECT length({Q}) AS q, length({A}) AS a, {sql_clean('topic')} AS t, {sql_clean('category')} AS c, {sql_clean('level')} AS l FROM merged_dataset)
""")
def length_profile(spark, d):
    return profile.length_profile(merged(spark, d))


@query(f"SELECT round(avg(length({A})), 4) AS mean_length, min(length({A}))::INT AS min_length, max(length({A}))::INT AS max_length FROM merged_dataset")
def length_stats(spark, d):
    return profile.length_stats(merged(spark, d), "answer")


_BAD = ", ".join("'{}'".format(p.replace("'", "''")) for p in profile.PLACEHOLDER_ANSWERS)
_SUSPICIOUS = f"((length({A}) > 50 AND len(list_distinct(string_split(lower({A}), ' '))) <= 3) OR lower({A}) IN ({_BAD}))"


@query(f"SELECT record_id FROM merged_dataset WHERE {_SUSPICIOUS}")
def suspicious_answers(spark, d):
    return merged(spark, d).filter(profile.suspicious("answer")).select("record_id")


@query(f"""
WITH r AS (SELECT count(*) AS total, count(*) FILTER ({Q} = '') AS empty_questions, count(*) FILTER ({A} = '') AS empty_answers,
  count(*) FILTER ({A} <> '' AND length({A}) < 30) AS very_short_answers, count(*) FILTER ({_SUSPICIOUS}) AS suspicious_records,
  count(*) FILTER ({sql_n2('question')} <> '') - count(DISTINCT nullif({sql_n2('question')}, '')) AS duplicate_records FROM merged_dataset),
 i AS (SELECT *, empty_questions + empty_answers + very_short_answers + suspicious_records + duplicate_records AS issues FROM r)
SELECT *, CASE WHEN issues = 0 THEN 'very clean' WHEN issues < total * 0.05 THEN 'good' WHEN issues < total * 0.10 THEN 'some cleaning' ELSE 'more cleaning' END AS verdict FROM i
""")
def quality_verdict(spark, d):
    return profile.quality_verdict(merged(spark, d))


@query("SELECT field, count(*) AS records FROM (SELECT unnest(json_keys(props)) AS field FROM events WHERE props IS NOT NULL) GROUP BY field")
def json_field_freq(spark, d):
    return profile.json_field_frequency(table(spark, d, "events"), "props")


@query(f"""
SELECT record_id AS rid, problem FROM (
  SELECT record_id, 'very short answer' AS problem FROM merged_dataset WHERE {A} <> '' AND length({A}) < 30
  UNION ALL SELECT record_id, 'suspicious answer' FROM merged_dataset WHERE {_SUSPICIOUS}) ORDER BY rid, problem LIMIT 20
""")
def problem_samples(spark, d):
    return profile.problem_samples(merged(spark, d))


# ---- samples, splits and exact overlaps -------------------------------------


def _detected(df):
    return classify.scored_topic(_text())


_QUOTA = " ".join(f"WHEN '{k}' THEN {n}" for k, n in sampling.QUOTAS.items())


@query(f"""
WITH f AS (SELECT min(row_id) AS row_id FROM python_balanced_1000 WHERE {sql_n1('question')} <> '' GROUP BY {sql_n1('question')}),
     q AS (SELECT * FROM python_balanced_1000 JOIN f USING (row_id) WHERE length({Q}) >= 10 AND length({A}) BETWEEN 30 AND 10000),
     x AS (SELECT row_id, {_TEXT} AS t FROM q),
     b AS ({_scored_sql().replace('record_id', 'row_id').split('b AS (', 1)[1].split(')\nSELECT', 1)[0]}),
     s AS (SELECT row_id AS rid, CASE WHEN best.score > 0 THEN best.topic ELSE 'Python Basics' END AS topic, md5('42|' || row_id) AS o FROM b),
     r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY o, rid) <= (CASE topic {_QUOTA} ELSE 0 END) AS first FROM s)
SELECT rid, topic FROM r ORDER BY (NOT first)::INT, o, rid LIMIT 1000
""")
def balanced_sample(spark, d):
    # the first row of every question, then the quality filter, then the draw
    rows = table(spark, d, "python_balanced_1000")
    first = dedup.first_wins(rows, key_without_marks("question"), "row_id").select(F.col("rid").alias("row_id"))
    pool = rows.filter(_good()).join(first, "row_id", "left_semi")
    return sampling.quota_sample(pool, _detected(pool), "row_id")


_SPLIT = f"""
WITH s AS (SELECT record_id AS rid, {sql_default('category', 'Other')} AS category, {sql_default('level', 'Unknown')} AS level, md5('42|' || record_id) AS o FROM merged_dataset),
     r AS (SELECT *, row_number() OVER (PARTITION BY category, level ORDER BY o, rid) AS rank, count(*) OVER (PARTITION BY category, level) AS n FROM s),
     p AS (SELECT *, CASE WHEN n <= 3 THEN 0 WHEN n >= 20 AND round_even(n * 0.05, 0) < 1 THEN 1 ELSE round_even(n * 0.05, 0)::BIGINT END AS part FROM r),
     z AS (SELECT rid, category, level, CASE WHEN rank <= n - 2 * part THEN 'train' WHEN rank <= n - part THEN 'validation' ELSE 'test' END AS split FROM p)
"""


@query(_SPLIT + "SELECT rid, category, level, split FROM z")
def stratified_split(spark, d):
    return sampling.stratified_split(merged(spark, d))


@query(_SPLIT + ", c AS (SELECT split AS part, category AS value, count(*) AS records FROM z GROUP BY 1, 2) SELECT part, value, records, round(100 * records / sum(records) OVER (PARTITION BY part), 4) AS percent FROM c")
def split_distribution(spark, d):
    return profile.distribution_within(sampling.stratified_split(merged(spark, d)), "split", F.col("category"))


def _invariants_sql(rows: str, group: str) -> str:
    return f"""SELECT (SELECT count(*) FROM merged_dataset) AS total, (SELECT count(*) FROM {rows}) AS assigned,
 (SELECT count(*) FROM (SELECT rid FROM {rows} GROUP BY rid HAVING count(*) > 1)) AS assigned_twice,
 (SELECT count(*) FROM (SELECT {group} FROM {rows} GROUP BY {group} HAVING count(DISTINCT split) > 1)) AS divided_groups"""


#: faulty: validation rows stand in test as well; grouped: with exact groups, which a split by rows divides.
_FAULTY = f""", faulty AS (SELECT * FROM z UNION ALL SELECT rid, category, level, 'test' FROM z WHERE split = 'validation'),
 k AS (SELECT record_id AS rid, {sql_n3('question')} AS k FROM merged_dataset),
 grouped AS (SELECT z.rid, split, CASE WHEN k = '' THEN z.rid ELSE min(z.rid) OVER (PARTITION BY k) END AS group_id FROM z JOIN k USING (rid)),
 i AS (SELECT 'sound' AS assignment, * FROM ({_invariants_sql('z', 'rid')}) UNION ALL SELECT 'faulty', * FROM ({_invariants_sql('faulty', 'rid')}) UNION ALL SELECT 'by rows', * FROM ({_invariants_sql('grouped', 'group_id')}))
SELECT *, total = assigned AND assigned_twice = 0 AND divided_groups = 0 AS holds FROM i
"""


@query(_SPLIT + _FAULTY)
def split_invariants(spark, d):
    """The checks on a sound split, on one with rows assigned twice, and on exact groups that a split by rows divides."""
    records = merged(spark, d)
    sound = sampling.stratified_split(records)
    faulty = sound.unionByName(sound.filter("split = 'validation'").withColumn("split", F.lit("test")))
    keyed = records.select(F.col("record_id").alias("rid"), key_with_marks("question").alias("key"))
    first = dedup.first_wins(records, key_with_marks("question"), "record_id").select("key", F.col("rid").alias("group_id"))
    grouped = sound.join(keyed.join(first, "key", "left").select("rid", F.coalesce("group_id", "rid").alias("group_id")), "rid")
    results = [("sound", sound, None), ("faulty", faulty, None), ("by rows", grouped, F.col("group_id"))]
    checks = [sampling.split_invariants(records, df, "record_id", group).select(F.lit(name).alias("assignment"), "*") for name, df, group in results]
    return checks[0].unionByName(checks[1]).unionByName(checks[2])


@query("SELECT sum(target_share) AS total, abs(sum(target_share) - 1) <= 1e-6 AND min(target_share) >= 0 AS holds FROM split_targets UNION ALL SELECT sum(target_share), abs(sum(target_share) - 1) <= 1e-6 AND min(target_share) >= 0 FROM split_targets WHERE split <> 'test'")
def ratio_check(spark, d):
    """Whether shares sum to one: those of all splits, and those without the test split."""
    shares = table(spark, d, "split_targets")
    check = lambda df: df.agg(F.sum("target_share").alias("total"), ((F.abs(F.sum("target_share") - 1) <= 1e-6) & (F.min("target_share") >= 0)).alias("holds"))
    return check(shares).unionByName(check(shares.filter("split <> 'test'")))


@query("SELECT count(*) AS total, round_even(count(*) * 0.9, 0)::BIGINT AS train, round_even(count(*) * 0.05, 0)::BIGINT AS validation, count(*) - round_even(count(*) * 0.9, 0)::BIGINT - round_even(count(*) * 0.05, 0)::BIGINT AS test FROM merged_dataset")
def target_counts(spark, d):
    row = merged(spark, d).agg(F.count("*").alias("total"))
    return row.select("total", *(c.alias(s) for c, s in zip(sampling.split_targets(F.col("total")), ("train", "validation", "test"))))


def parts(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    splits = table(spark, d, "splits").select("record_id", "question", "split")
    return {"train": splits.filter("split = 'train'"), "validation": table(spark, d, "validation").select("record_id", "question", "split"), "test": splits.filter("split = 'test'")}


_PARTS = f"""
WITH u AS (SELECT record_id, split AS part, {sql_n3('question')} AS k FROM splits UNION ALL SELECT record_id, split, {sql_n3('question')} FROM validation),
     p AS (SELECT * FROM u WHERE k <> '')
"""


@query(_PARTS + "SELECT part, record_id AS rid, min(record_id) OVER (PARTITION BY part, k) AS representative FROM p")
def text_membership(spark, d):
    """The representative of every row's text in its part: pairs of texts are pairs of representatives."""
    rows = None
    for name, df in parts(spark, d).items():
        own = leakage.keyed(df)
        first = own.groupBy("key").agg(F.min("rid").alias("representative"))
        part = own.join(first, "key").select(F.lit(name).alias("part"), "rid", "representative")
        rows = part if rows is None else rows.unionByName(part)
    return rows


@query(_PARTS + """, l AS (SELECT k, min(record_id) AS left_id, count(*) AS left_copies FROM p WHERE part = 'train' GROUP BY k),
 r AS (SELECT k, min(record_id) AS right_id, count(*) AS right_copies FROM p WHERE part = 'test' GROUP BY k)
SELECT left_id, right_id, left_copies, right_copies, left_copies * right_copies AS pairs FROM l JOIN r USING (k)""")
def exact_overlap_pairs(spark, d):
    p = parts(spark, d)
    return leakage.overlap_pairs(p["train"], p["test"])


@query(_PARTS + ", l AS (SELECT k, count(*) AS left_copies, min(record_id) AS first_left_id FROM p WHERE part = 'train' GROUP BY k) SELECT record_id AS right_id, left_copies, first_left_id FROM p JOIN l USING (k) WHERE part = 'validation'")
def exact_overlap_rows(spark, d):
    p = parts(spark, d)
    return leakage.overlap_rows(p["train"], p["validation"])


@query(_PARTS + "SELECT k AS key FROM p WHERE part = 'train' INTERSECT SELECT k FROM p WHERE part = 'test'")
def overlap_intersect(spark, d):
    p = parts(spark, d)
    return leakage.shared_keys(p["train"], p["test"])


@query(_PARTS + """, k AS (SELECT DISTINCT part, k FROM p), c(left_part, right_part) AS (VALUES ('train', 'validation'), ('train', 'test'), ('validation', 'test'))
SELECT left_part, right_part, (SELECT count(*) FROM k a JOIN k b ON a.k = b.k WHERE a.part = left_part AND b.part = right_part) AS keys FROM c""")
def overlap_summary(spark, d):
    return leakage.overlap_summary(parts(spark, d))


@query(f"SELECT record_id AS rid FROM merged_dataset WHERE {sql_n1('question')} NOT IN (SELECT {sql_n1('question')} FROM splits)")
def anti_select(spark, d):
    return leakage.not_selected(merged(spark, d), table(spark, d, "splits"), "record_id")


@query(_PARTS + "SELECT part, count(DISTINCT k) AS keys, count(*) AS records FROM p GROUP BY part")
def key_sets(spark, d):
    rows = None
    for name, df in parts(spark, d).items():
        part = leakage.keyed(df).select(F.lit(name).alias("part"), "key")
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("part").agg(F.count_distinct("key").alias("keys"), F.count("*").alias("records"))


@query("""
SELECT source, count(*) AS records FROM (SELECT 'splits' AS source FROM splits UNION ALL SELECT 'validation' FROM validation) GROUP BY source
""")
def union_with_source(spark, d):
    a = table(spark, d, "splits").select(F.lit("splits").alias("source"))
    return a.unionByName(table(spark, d, "validation").select(F.lit("validation").alias("source"))).groupBy("source").agg(F.count("*").alias("records"))
