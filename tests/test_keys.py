import re

from pyspark.sql import functions as F

from loomline.functions import text

PROBES = ["Ça  va bien?", "c++ a-b a b ab", "x y", "a\u001cb", "été été", "漢字、かな", "½ ² İx", "zero​width", "\u0085nel", "snake_case, x", "", "   ", "!?!"]


def python_clean(x):
    return " ".join(x.split())


def test_cleaning_and_keys_match_python(spark):
    df = spark.createDataFrame(list(enumerate(PROBES)), "i int, x string")
    got = {r["i"]: r for r in df.select("i", text.clean_text("x").alias("c"), text.key_without_marks("x").alias("n1"), text.key_marks_to_blanks("x").alias("n2"), text.key_with_marks("x").alias("n3"), text.key_trimmed("x").alias("n4")).collect()}
    for i, x in enumerate(PROBES):
        c = python_clean(x)
        assert got[i]["c"] == c
        assert got[i]["n1"] == python_clean(re.sub(r"[^\w\s]", "", c.lower()))
        assert got[i]["n2"] == python_clean(re.sub(r"[^\w\s]", " ", c.lower()))
        assert got[i]["n3"] == python_clean(x.lower())
        assert got[i]["n4"] == x.strip().lower()


def test_null_text_is_empty(spark):
    row = spark.createDataFrame([(None,)], "x string").select(text.clean_text("x").alias("a"), text.key_without_marks("x").alias("b"), text.distinct_tokens("x").alias("c"), text.or_default("x", "d").alias("d")).first()
    assert tuple(row) == ("", "", 0, "d")


def test_no_python_in_keys(spark):
    plan = spark.range(1).select(text.key_without_marks(F.lit("x")))._jdf.queryExecution().toString()
    assert "Python" not in plan
