"""Queries over similarity, groups, group splits, token arrays and losses."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.text import clean_text, key_with_marks
from loomline.operators import dedup, examples, groups, leakage, sampling, similarity
from loomline.plans.reference_core import merged, parts, sql_clean, sql_default, sql_n3
from loomline.session import durable, scratch_path, table
from loomline.sources import jsonl

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# ---- similarity -------------------------------------------------------------

def _tfidf_sql(classes: str) -> str:
    """Weights by plain SQL. classes: a query of (rid, text, copies)."""
    return f"""
WITH RECURSIVE t AS ({classes}),
 raw AS (SELECT rid, copies, unnest(list_concat(
     list_transform(range(1, greatest(length(text) - 1, 1)), lambda i: substr(text, i, 3)),
     list_transform(range(1, greatest(length(text) - 2, 1)), lambda i: substr(text, i, 4)),
     list_transform(range(1, greatest(length(text) - 3, 1)), lambda i: substr(text, i, 5)))) AS gram FROM t),
 tf AS (SELECT rid, any_value(copies) AS copies, gram, count(*) AS tf FROM raw GROUP BY rid, gram),
 df AS (SELECT gram, sum(copies) AS df FROM tf GROUP BY gram HAVING sum(copies) >= 2),
 x AS (SELECT rid, gram, tf * (ln((1 + (SELECT sum(copies) FROM t)) / (1 + df)) + 1) AS r FROM tf JOIN df USING (gram)),
 p AS (SELECT rid, gram, r / sqrt(sum(r * r) OVER (PARTITION BY rid)) AS w FROM x)
"""


def _classes_sql(source: str, rid: str = "min(record_id)", least: int = 20) -> str:
    return f"SELECT {rid} AS rid, k AS text, count(*) AS copies FROM (SELECT record_id, {sql_n3('question')} AS k FROM {source}) WHERE length(k) >= {least} GROUP BY k"


_VALIDATION = _tfidf_sql(_classes_sql("validation"))
_NEAR = _VALIDATION + ", pairs AS (SELECT a.rid AS a, b.rid AS b, sum(a.w * b.w) AS similarity FROM p a JOIN p b ON a.gram = b.gram AND a.rid < b.rid GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.9 - 1e-9)"


def _cross_sql(left: str, right: str, threshold: float, least: int) -> str:
    both = _classes_sql(left, "2 * min(record_id)", least) + " UNION ALL " + _classes_sql(right, "2 * min(record_id) + 1", least)
    met = f"SELECT a.rid AS x, b.rid AS y, sum(a.w * b.w) AS similarity FROM p a JOIN p b ON a.gram = b.gram WHERE a.rid % 2 = 0 AND b.rid % 2 = 1 GROUP BY 1, 2 HAVING sum(a.w * b.w) >= {threshold} - 1e-9"
    return _tfidf_sql(both) + f", met AS ({met}), pairs AS (SELECT x // 2 AS a, y // 2 AS b, similarity, u.copies AS a_copies, v.copies AS b_copies FROM met JOIN t u ON u.rid = x JOIN t v ON v.rid = y)"


_TRAIN, _TEST = "(SELECT * FROM splits WHERE split = 'train')", "(SELECT * FROM splits WHERE split = 'test')"


@query(_VALIDATION + "SELECT rid, count(*) AS grams, round(sum(w), 4) AS weight, round(max(w), 4) AS heaviest FROM p GROUP BY rid")
def tfidf_weights(spark, d):
    postings = similarity.tfidf_postings(similarity.text_classes(table(spark, d, "validation")))
    return postings.groupBy("rid").agg(F.count("*").alias("grams"), F.round(F.sum("w"), 4).alias("weight"), F.round(F.max("w"), 4).alias("heaviest"))


@query(_NEAR + "SELECT a, b, round(similarity, 4) AS similarity FROM pairs")
def near_pairs_090(spark, d):
    return similarity.near_pairs(table(spark, d, "validation")).select("a", "b", F.round("similarity", 4).alias("similarity"))


# The same over the whole master table; its self-join in plain SQL is too slow for a twin.


@query()
def merged_tfidf_weights(spark, d):
    postings = similarity.tfidf_postings(similarity.text_classes(merged(spark, d)))
    return postings.groupBy("rid").agg(F.count("*").alias("grams"), F.round(F.sum("w"), 4).alias("weight"), F.round(F.max("w"), 4).alias("heaviest"))


@query()
def merged_near_pairs_090(spark, d):
    return similarity.near_pairs(merged(spark, d)).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query(_cross_sql("validation", _TEST, 0.85, 1) + "SELECT a, b, round(similarity, 4) AS similarity, a_copies, b_copies FROM pairs ORDER BY round(similarity, 9) DESC, a, b LIMIT 50")
def cross_pairs_085_top50(spark, d):
    p = parts(spark, d)
    pairs = similarity.cross_pairs(p["validation"], p["test"], 0.85)
    return pairs.orderBy(F.desc(F.round("similarity", 9)), "a", "b").limit(50).select("a", "b", F.round("similarity", 4).alias("similarity"), "a_copies", "b_copies")


@query(_cross_sql(_TRAIN, "validation", 0.9, 20) + ", r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY round(similarity, 9) DESC, a)::INT AS rank FROM pairs) SELECT a, b, round(similarity, 4) AS similarity, a_copies, b_copies, rank FROM r WHERE rank <= 5")
def cross_knn_train_validation(spark, d):
    p = parts(spark, d)
    return similarity.nearest(similarity.cross_pairs(p["train"], p["validation"], 0.9, least=20)).select("a", "b", F.round("similarity", 4).alias("similarity"), "a_copies", "b_copies", "rank")


@query(_cross_sql(_TRAIN, _TEST, 0.9, 20) + "SELECT t.x AS threshold, (SELECT count(*) FROM pairs WHERE similarity >= t.x - 1e-9) AS texts, (SELECT coalesce(sum(a_copies * b_copies), 0)::BIGINT FROM pairs WHERE similarity >= t.x - 1e-9) AS pairs FROM (VALUES (0.98::DOUBLE), (0.95::DOUBLE), (0.90::DOUBLE)) t(x)")
def threshold_counts(spark, d):
    p = parts(spark, d)
    return similarity.threshold_counts(similarity.cross_pairs(p["train"], p["test"], 0.9, least=20))


def _audit_sql() -> str:
    sides = {"train": _TRAIN, "validation": "validation", "test": _TEST}
    names, rows = list(sides), []
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            counts = ", ".join(f"coalesce(sum(a_copies * b_copies) FILTER (similarity >= {t} - 1e-9), 0)::BIGINT AS near_{round(100 * t)}" for t in (0.98, 0.95, 0.90))
            exact = f"(SELECT count(*) FROM (SELECT {sql_n3('question')} AS k FROM {sides[a]} INTERSECT SELECT {sql_n3('question')} FROM {sides[b]}) WHERE k <> '')"
            rows.append(f"SELECT '{a}' AS left_part, '{b}' AS right_part, {exact} AS exact_keys, near.* FROM ({_cross_sql(sides[a], sides[b], 0.9, 20)} SELECT {counts} FROM pairs) near")
    return "SELECT *, exact_keys + near_90 = 0 AS passed FROM (" + " UNION ALL ".join(rows) + ")"


@query(_audit_sql())
def leakage_audit(spark, d):
    p, result = parts(spark, d), None
    names = list(p)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            near = similarity.cross_pairs(p[a], p[b], 0.9, least=20).agg(*(similarity.row_pairs(t).alias(f"near_{round(100 * t)}") for t in (0.98, 0.95, 0.90)))
            row = near.select(F.lit(a).alias("left_part"), F.lit(b).alias("right_part"), "*")
            result = row if result is None else result.unionByName(row)
    exact = leakage.overlap_summary(p).withColumnRenamed("keys", "exact_keys")
    return result.join(exact, ["left_part", "right_part"]).withColumn("passed", F.col("exact_keys") + F.col("near_90") == 0)


# ---- groups -----------------------------------------------------------------


@query(f"""
WITH k AS (SELECT record_id AS rid, {sql_n3('question')} AS k FROM merged_dataset),
 g AS (SELECT k, min(rid) AS group_id, count(*) AS size FROM k WHERE k <> '' GROUP BY k HAVING count(*) > 1)
SELECT rid, group_id, size FROM k JOIN g USING (k)
""")
def exact_groups(spark, d):
    return dedup.exact_groups(merged(spark, d), key_with_marks("question"))


@query(_NEAR + f""", link AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
 reach(node, seen) AS (SELECT DISTINCT a, a FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.seen),
 comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
 rep AS (SELECT {sql_n3('question')} AS k, min(record_id) AS rep FROM validation GROUP BY 1),
 v AS (SELECT record_id, {sql_n3('question')} AS k FROM validation)
SELECT v.record_id AS rid, CASE WHEN v.k = '' THEN v.record_id ELSE coalesce(comp.component, rep.rep) END AS group_id FROM v JOIN rep USING (k) LEFT JOIN comp ON comp.node = rep.rep""")
def near_dup_groups(spark, d):
    return groups.duplicate_groups(table(spark, d, "validation"))


@query()
def merged_near_dup_groups(spark, d):
    return near_membership(merged(spark, d))


def exact_membership(df: DataFrame) -> DataFrame:
    """(rid, group_id): rows with equal N3 questions; rows without one stand alone."""
    rows = df.select(F.col("record_id").alias("rid"), key_with_marks("question").alias("key"))
    first = rows.filter("key <> ''").groupBy("key").agg(F.min("rid").alias("group_id"))
    return rows.join(first, "key", "left").select("rid", F.coalesce("group_id", "rid").alias("group_id"))


_MEMBERS = f"""
WITH v AS (SELECT record_id AS rid, {sql_n3('question')} AS k, {sql_default('category', 'Other')} AS category, {sql_default('level', 'Unknown')} AS level FROM merged_dataset),
 m AS (SELECT *, CASE WHEN k = '' THEN rid ELSE min(rid) OVER (PARTITION BY k) END AS group_id FROM v),
 c AS (SELECT group_id, category, count(*) AS n, min(rid) AS f FROM m GROUP BY 1, 2),
 l AS (SELECT group_id, level, count(*) AS n, min(rid) AS f FROM m GROUP BY 1, 2),
 dc AS (SELECT group_id, category FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, f) AS r FROM c) WHERE r = 1),
 dl AS (SELECT group_id, level FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY n DESC, f) AS r FROM l) WHERE r = 1)
"""


def near_membership(df: DataFrame) -> DataFrame:
    """(rid, group_id): rows joined by equal N3 questions and by near copies, transitively."""
    return durable(groups.duplicate_groups(df))


def labelled_exact(spark: SparkSession, d: str) -> DataFrame:
    records = merged(spark, d)
    return groups.with_labels(exact_membership(records), records)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    records = merged(spark, d)
    return groups.with_labels(near_membership(records), records)


@query(_MEMBERS + """, hc AS (SELECT group_id, string_agg(category || '=' || n, ',' ORDER BY category || '=' || n) AS category_counts FROM c GROUP BY 1),
 hl AS (SELECT group_id, string_agg(level || '=' || n, ',' ORDER BY level || '=' || n) AS level_counts FROM l GROUP BY 1),
 s AS (SELECT group_id, count(*) AS size FROM m GROUP BY 1)
SELECT group_id, size, category, level, category_counts, level_counts FROM s JOIN dc USING (group_id) JOIN dl USING (group_id) JOIN hc USING (group_id) JOIN hl USING (group_id)""")
def group_profile(spark, d):
    return groups.group_profile(labelled_exact(spark, d))


@query(_MEMBERS + ", s AS (SELECT group_id, count(*) AS size FROM m GROUP BY 1) SELECT row_number() OVER (ORDER BY size DESC, group_id) AS number, group_id, size FROM s")
def numbered_groups(spark, d):
    return groups.numbered(exact_membership(merged(spark, d)))


@query(_MEMBERS + "SELECT category, count(*) AS groups FROM dc GROUP BY category")
def group_dominant(spark, d):
    return groups.dominant(labelled_exact(spark, d), "category").groupBy("category").agg(F.count("*").alias("groups"))


@query()
def near_group_profile(spark, d):
    return groups.group_profile(labelled(spark, d))


@query()
def near_numbered_groups(spark, d):
    return groups.numbered(near_membership(merged(spark, d)))


@query()
def near_group_dominant(spark, d):
    return groups.dominant(labelled(spark, d), "category").groupBy("category").agg(F.count("*").alias("groups"))


@query()
def group_stratified_split(spark, d):
    return groups.group_stratified_split(labelled(spark, d))


@query()
def group_split_v2(spark, d):
    return groups.greedy_split(labelled(spark, d), groups.GREEDY_V2)


@query()
def group_split_v3(spark, d):
    return groups.greedy_split(labelled(spark, d), groups.GREEDY_V3)


@query()
def group_split_invariants(spark, d):
    return sampling.split_invariants(merged(spark, d), groups.group_stratified_split(labelled(spark, d)), "record_id", F.col("group_id"))


@query()
def near_group_split(spark, d):
    return groups.group_stratified_split(labelled(spark, d))


# ---- tokens and losses --------------------------------------------------------

_FULL = "'<|user|> ' || coalesce(question, '') || ' <|end|> ' || '<|assistant|> ' || coalesce(answer, '') || ' <|end|> '"
_PROMPT = "'<|user|> ' || coalesce(question, '') || ' <|end|> ' || '<|assistant|> '"


def _ids(text: str) -> str:
    return f"list_transform(list_filter(string_split({text}, ' '), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 6))::INT)"


_TOKENS = f"""
WITH x AS (SELECT record_id AS rid, {_ids(_FULL)} AS f, len({_ids(_PROMPT)}) AS s FROM merged_dataset),
 e AS (SELECT rid, s, f[1:512] AS ids FROM x),
 y AS (SELECT rid, ids, len(ids) AS n, least(s, len(ids)) AS hidden FROM e)
"""


def _examples(spark: SparkSession, d: str) -> DataFrame:
    return examples.tokenized(merged(spark, d))


@query(f"SELECT record_id AS rid, md5({_FULL}) AS conversation, md5({_PROMPT}) AS prompt FROM merged_dataset")
def chat_render(spark, d):
    full = examples.render_chat(examples.chat_messages(F.col("question"), F.col("answer")))
    prompt = examples.render_chat(examples.chat_messages(F.col("question")), prompt=True)
    return merged(spark, d).select(F.col("record_id").alias("rid"), F.md5(full).alias("conversation"), F.md5(prompt).alias("prompt"))


@query(_TOKENS + "SELECT rid, n::INT AS tokens, hidden::INT AS ignored, n >= 512 AS truncated, list_sum(ids)::BIGINT AS id_sum FROM y")
def tokenize_mask(spark, d):
    rows = _examples(spark, d)
    ignored = F.size(F.filter("labels", lambda x: x == examples.IGNORED))
    return rows.select("rid", F.size("input_ids").alias("tokens"), ignored.alias("ignored"), "truncated", F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("id_sum"))


@query(_TOKENS + """SELECT rid, CASE WHEN n % 11 = 0 THEN 'empty' ELSE 'lengths differ' END AS problem FROM y WHERE n % 11 = 0 OR n % 7 = 0""")
def token_contract(spark, d):
    """The contract over examples into which faults were put: arrays emptied or cut, by their length."""
    n = F.size("input_ids")
    faulty = _examples(spark, d).select("rid", F.when(n % 11 != 0, F.col("input_ids")).alias("input_ids"), F.when((n % 7 == 0) & (n % 2 == 0), F.slice("attention_mask", 2, 1 << 30)).otherwise(F.col("attention_mask")).alias("attention_mask"), F.when((n % 7 == 0) & (n % 2 == 1), F.slice("labels", 2, 1 << 30)).otherwise(F.col("labels")).alias("labels"))
    return examples.contract_violations(faulty)


@query(_TOKENS + "SELECT rid, n::INT AS tokens, n::INT AS trained, list_sum(ids)::BIGINT AS label_sum FROM y")
def unmasked_labels(spark, d):
    rows = examples.unmasked(_examples(spark, d))
    return rows.select("rid", F.size("input_ids").alias("tokens"), F.size(F.filter("labels", lambda x: x != examples.IGNORED)).alias("trained"), F.aggregate("labels", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("label_sum"))


@query(_TOKENS + "SELECT count(*) AS examples, count(*) FILTER (n >= 512) AS truncated, sum(n)::BIGINT AS tokens, sum(n - hidden)::BIGINT AS trained, count(*) FILTER (n = hidden) AS untrained FROM y")
def tokenize_counters(spark, d):
    return examples.run_counters(_examples(spark, d))


_BATCHES = _TOKENS + ", b AS (SELECT *, (row_number() OVER (ORDER BY rid) - 1) // 4 AS batch_id FROM y), w AS (SELECT *, max(n) OVER (PARTITION BY batch_id) AS longest FROM b)"


@query(_BATCHES + "SELECT rid, batch_id, longest::INT AS width, (longest - n)::INT AS filled FROM w")
def pad_batches(spark, d):
    rows = examples.padded(examples.batched(_examples(spark, d)))
    return rows.select("rid", "batch_id", F.size("input_ids").alias("width"), F.size(F.filter("attention_mask", lambda x: x == 0)).alias("filled"))


@query(_BATCHES + "SELECT batch_id, sum(n)::BIGINT AS real, sum(longest - n)::BIGINT AS padding, sum(hidden + longest - n)::BIGINT AS ignored, sum(n - hidden)::BIGINT AS trainable FROM w GROUP BY batch_id")
def batch_inspection(spark, d):
    return examples.batch_inspection(examples.padded(examples.batched(_examples(spark, d))))


@query(_TOKENS + ", q AS (SELECT unnest(ids) AS token_id FROM y) SELECT token_id, count(*) AS positions FROM q GROUP BY token_id")
def token_positions(spark, d):
    return examples.positions(_examples(spark, d)).groupBy("token_id").agg(F.count("*").alias("positions"))


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    full = examples.blank_tokenizer(examples.render_chat(examples.chat_messages(F.col("question"), F.col("answer"))))
    return merged(spark, d).select(F.col("record_id").alias("rid"), F.size(full).alias("n"))


_N = f"WITH y AS (SELECT record_id AS rid, len(list_filter(string_split({_FULL}, ' '), lambda w: w <> ''))::INT AS n FROM merged_dataset), s AS (SELECT list(n ORDER BY n) AS v, count(*) AS c FROM y)"


@query(_N + """SELECT c AS n, v[1] AS least, v[-1] AS greatest, round(list_sum(v) / c, 4) AS mean, (v[(c + 1) // 2] + v[(c + 2) // 2]) / 2.0 AS median,
 v[CASE WHEN floor(0.90 * c) < 1 THEN c ELSE floor(0.90 * c)::BIGINT END] AS p90, v[CASE WHEN floor(0.95 * c) < 1 THEN c ELSE floor(0.95 * c)::BIGINT END] AS p95, v[CASE WHEN floor(0.99 * c) < 1 THEN c ELSE floor(0.99 * c)::BIGINT END] AS p99 FROM s""")
def token_length_stats(spark, d):
    return examples.token_length_stats(_lengths(spark, d))


@query(_N + "SELECT m.x AS max_length, count(*) FILTER (n > m.x) AS truncated, round(100 * count(*) FILTER (n > m.x) / count(*), 4) AS percent FROM y, (VALUES (256), (384), (512), (1024)) m(x) GROUP BY m.x")
def truncation_sweep(spark, d):
    return examples.truncation_sweep(_lengths(spark, d))


@query(_N + "SELECT rid, n FROM y WHERE n <= 512 ORDER BY n DESC, rid LIMIT 1")
def longest_under_cap(spark, d):
    return examples.longest_under(_lengths(spark, d), 512)


_LOSSES = "SELECT l_linestatus AS part, l_tax * 100 AS loss, l_quantity::BIGINT - 1 AS tokens FROM lineitem"


@query(f"""WITH z AS ({_LOSSES}), a AS (SELECT sum(loss * tokens) / sum(tokens) AS w, avg(loss) AS p, sum(tokens)::BIGINT AS tokens FROM z WHERE tokens > 0
 UNION ALL SELECT sum(loss * tokens) / sum(tokens), avg(loss), sum(tokens)::BIGINT FROM z WHERE tokens > 0 AND part = 'none')
SELECT round(w, 6) AS weighted_loss, round(p, 6) AS mean_loss, tokens, CASE WHEN w < 50 THEN round(exp(w), 4) END AS perplexity FROM a""")
def weighted_loss(spark, d):
    """Losses of a table with rows without tokens, and those of no row at all."""
    losses = table(spark, d, "lineitem").select(F.col("l_linestatus").alias("part"), (F.col("l_tax") * 100).alias("loss"), (F.col("l_quantity").cast("bigint") - 1).alias("tokens"))
    return examples.weighted_loss(losses).unionByName(examples.weighted_loss(losses.filter("part = 'none'")))


@query("SELECT ceil(count(*) / 8)::BIGINT AS updates_per_epoch, (ceil(count(*) / 8) * 2)::BIGINT AS updates, floor(ceil(count(*) / 8) * 2 * 0.03)::BIGINT AS warm_up_updates FROM splits WHERE split = 'train'")
def lr_schedule(spark, d):
    return table(spark, d, "splits").filter("split = 'train'").agg(F.count("*").alias("n")).select(examples.schedule(F.col("n")).alias("s")).select("s.*")


@query(f"SELECT {sql_default('category', 'Other')} AS category, count(*) AS user_turns, count(nullif(answer, '')) AS answered FROM merged_dataset GROUP BY 1")
def user_question_count(spark, d):
    from loomline.functions.text import or_default

    turns = merged(spark, d).select(or_default("category", "Other").alias("category"), F.explode(examples.chat_messages(F.col("question"), F.col("answer"))).alias("m"))
    return turns.groupBy("category").agg(F.count_if(F.col("m.role") == "user").alias("user_turns"), F.count_if((F.col("m.role") == "assistant") & (F.col("m.content") != "")).alias("answered"))


@query("SELECT record_id, question, answer AS reference_answer, upper(coalesce(question, '')) AS base_answer, reverse(coalesce(question, '')) AS tuned_answer FROM validation")
def generation_compare(spark, d):
    rows = table(spark, d, "validation").select("record_id", "question", F.col("answer").alias("reference_answer"))
    base = examples.generated(rows, lambda: lambda texts: [t.upper() for t in texts], "question", "base_answer")
    return examples.generated(base, lambda: lambda texts: [t[::-1] for t in texts], "question", "tuned_answer")


# ---- JSON lines: written to a scratch folder and read back --------------------

_LINE = "record_id bigint, question string, answer string, category string"
_RECORDS = "record_id, md5(question) AS question, md5(answer) AS answer"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return merged(spark, d).select("record_id", "question", "answer", "category")


def _written(spark: SparkSession, df: DataFrame, partition: str | None = None) -> str:
    path = scratch_path(spark)
    jsonl.write_jsonl(df, path, partition)
    return path


def _dirty(spark: SparkSession, d: str) -> str:
    """Every record, a broken line for each without category, a list for each without source, a blank one for each without answer."""
    rows = merged(spark, d)
    good = rows.select(F.to_json(F.struct("record_id", "question", "answer", "category"), {"ignoreNullFields": "false"}).alias("line"))
    bad = [(rows.filter("category is null"), '{"record_id": 1, "question"'), (rows.filter("source is null"), "[1, 2]"), (rows.filter("answer is null"), " \t")]
    path = scratch_path(spark)
    for df, line in bad:
        good = good.unionByName(df.select(F.lit(line).alias("line")))
    good.write.text(path)
    return path


@query(f"SELECT {_RECORDS} FROM merged_dataset")
def json_roundtrip(spark, d):
    records = jsonl.read_strict(spark, _written(spark, _lines(spark, d)), _LINE)
    return records.select("record_id", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query("SELECT count(*) + count(*) FILTER (category IS NULL) + count(*) FILTER (source IS NULL) + count(*) FILTER (answer IS NULL) AS total, count(*) FILTER (answer IS NULL) AS blank, count(*) FILTER (category IS NULL) + count(*) FILTER (source IS NULL) AS invalid, count(*) AS valid FROM merged_dataset")
def jsonl_line_counts(spark, d):
    return jsonl.line_counts(spark, _dirty(spark, d), _LINE).agg(*(F.sum(c).alias(c) for c in ("total", "blank", "invalid", "valid")))


@query(f"SELECT {_RECORDS} FROM merged_dataset")
def jsonl_lenient(spark, d):
    return jsonl.read_lenient(spark, _dirty(spark, d), _LINE).select("record_id", F.md5("question").alias("question"), F.md5("answer").alias("answer"))


@query("SELECT 0::BIGINT AS records")
def jsonl_missing_is_empty(spark, d):
    return jsonl.read_or_empty(spark, scratch_path(spark), _LINE).agg(F.count("*").alias("records"))


@query("SELECT count(*) AS records FROM merged_dataset")
def jsonl_exact_rows(spark, d):
    rows = _lines(spark, d)
    return jsonl.read_exactly(spark, _written(spark, rows), _LINE, rows.count()).agg(F.count("*").alias("records"))


@query("SELECT coalesce(category, '__HIVE_DEFAULT_PARTITION__') AS category, count(*) AS records FROM (SELECT nullif(category, '') AS category FROM merged_dataset) GROUP BY 1")
def jsonl_partitioned(spark, d):
    path = _written(spark, _lines(spark, d).withColumn("category", F.nullif("category", F.lit(""))), "category")
    return spark.read.schema("record_id bigint, category string").json(path).groupBy(F.coalesce("category", F.lit("__HIVE_DEFAULT_PARTITION__")).alias("category")).agg(F.count("*").alias("records"))


@query("SELECT true AS refused, count(*) AS records FROM merged_dataset")
def jsonl_overwrite_guard(spark, d):
    path = _written(spark, _lines(spark, d))
    try:
        jsonl.write_jsonl(_lines(spark, d).filter("false"), path)
        refused = False
    except AnalysisException:
        refused = True
    return jsonl.read_strict(spark, path, _LINE).agg(F.lit(refused).alias("refused"), F.count("*").alias("records"))


@query("SELECT source, records FROM (SELECT 'splits' AS source, count(*) AS records FROM splits UNION ALL SELECT 'validation', count(*) FROM validation)")
def jsonl_union(spark, d):
    paths = [_written(spark, table(spark, d, name).select("record_id", "question")) for name in ("splits", "validation")]
    rows = jsonl.read_union(spark, [*paths, scratch_path(spark)], "record_id bigint, question string")
    names = F.when(F.col("file") == 0, "splits").otherwise("validation")
    return rows.groupBy(names.alias("source")).agg(F.count("*").alias("records"))


@query("SELECT record_id, md5(question) AS question FROM merged_dataset ORDER BY record_id LIMIT 20")
def first_twenty(spark, d):
    return jsonl.first_rows(merged(spark, d), "record_id", 20).select("record_id", F.md5("question").alias("question"))
