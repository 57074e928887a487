"""Keyword classifiers as column expressions built once on the driver."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import clean_text

#: Spelling of levels.
LEVELS = {"beginner": "Beginner", "intermediate": "Intermediate", "skilled": "Skilled", "advanced": "Advanced", "expert": "Expert", "exploration policies": "Advanced"}
#: Signs of program code in an answer.
CODE_SIGNS = ("```", "def ", "class ", "import ", "#include", "public static", "function ", "console.log", "select ", "select *", "<?php")
#: Signs of a programming language, in order of precedence.
LANGUAGE_SIGNS = (("Python", ("python", "def ", "import pandas")), ("C/C++", ("#include", "std::")), ("Java", ("public static void main",)), ("JavaScript", ("javascript", "console.log")), ("PHP", ("php", "<?php")), ("SQL", ("sql", "select * from")))
#: Keywords of each topic of the scored classifier, in order of precedence.
SCORED_TOPICS = {
    "Algorithms": ["algorithm", "algorithms", "sorting", "searching", "binary search", "linear search", "merge sort", "quick sort", "bubble sort", "insertion sort", "selection sort", "heap sort", "recursion", "dynamic programming", "backtracking", "greedy", "graph", "graphs", "shortest path", "dijkstra", "bfs", "dfs", "breadth first search", "depth first search"],
    "NumPy": ["numpy", "np.", "ndarray", "numpy array", "numpy arrays", "np.array", "np.zeros", "np.ones", "np.reshape", "np.mean", "np.sum", "np.random", "np.arange", "np.linspace"],
    "Debugging": ["debug", "debugging", "bug", "error", "errors", "exception", "exceptions", "traceback", "fix this error", "fix the error", "not working", "why does this code", "error message", "runtime error", "syntax error", "typeerror", "valueerror", "indexerror", "keyerror", "attributeerror", "nameerror", "zerodivisionerror"],
    "Web/API": ["flask", "fastapi", "django", "api", "rest api", "restful api", "endpoint", "http", "request", "response", "web application", "web app", "route", "routing", "json api", "api endpoint"],
    "Pandas": ["pandas", "pd.", "dataframe", "data frame", "series", "groupby", "group by", "merge", "concat", "pivot", "pivot_table", "read_csv", "to_csv", "dropna", "fillna", "loc", "iloc", "dataframe manipulation"],
    "Machine Learning": ["machine learning", "scikit-learn", "scikit learn", "sklearn", "train_test_split", "linear regression", "logistic regression", "random forest", "decision tree", "classification", "regression", "model training", "model prediction", "fit model", "predict", "train model", "ml model"],
    "File Handling": ["file handling", "file handling in python", "open(", "read file", "write file", "file", "csv file", "json file", "text file", "read", "write", "append", "file path", "directory", "folder"],
    "Python Basics": ["python", "variable", "variables", "data type", "data types", "string", "strings", "list", "lists", "tuple", "tuples", "set", "sets", "dictionary", "dictionary", "dict", "loop", "loops", "for loop", "while loop", "if statement", "conditional", "conditional statement", "comprehension", "list comprehension"],
    "Functions": ["function", "functions", "def ", "lambda", "parameter", "parameters", "argument", "arguments", "return value", "recursive function", "function definition"],
    "OOP": ["class", "classes", "object", "objects", "inheritance", "polymorphism", "encapsulation", "abstraction", "constructor", "self", "method", "methods", "object-oriented", "object oriented", "oop"],
}
#: Keywords of each topic of the multi-label classifier.
LABEL_TOPICS = {
    "Python Basics": ["python", "variable", "data type", "string", "list", "tuple", "set", "dictionary", "dict", "loop", "for loop", "while loop", "if statement", "conditional"],
    "Functions": ["function", "def ", "lambda", "recursion", "parameter", "argument"],
    "OOP": ["class", "object", "inheritance", "polymorphism", "encapsulation", "abstraction", "constructor", "self", "method"],
    "Exception Handling": ["exception", "try", "except", "finally", "raise", "error handling"],
    "File Handling": ["file handling", "open(", "read file", "write file", "csv file", "json file"],
    "NumPy": ["numpy", "np.", "ndarray", "array"],
    "Pandas": ["pandas", "pd.", "dataframe", "series", "groupby", "merge", "concat", "pivot"],
    "Machine Learning": ["machine learning", "scikit-learn", "sklearn", "train_test_split", "linear regression", "logistic regression", "random forest", "decision tree", "classification", "regression", "model training"],
    "Algorithms": ["algorithm", "sorting", "searching", "binary search", "linear search", "merge sort", "quick sort", "bubble sort", "dynamic programming", "backtracking", "graph"],
    "Data Structures": ["stack", "queue", "linked list", "tree", "binary tree", "heap", "hash table", "dictionary", "array"],
    "Debugging": ["debug", "debugging", "fix this error", "error", "exception", "traceback", "bug", "not working", "why does this code"],
    "Web/API": ["flask", "fastapi", "api", "rest api", "django", "http", "endpoint", "request", "response"],
}
SCORED_DEFAULT = "Python Basics"


def any_of(text: Column, signs) -> Column:
    """Whether the text contains any sign; a constant array keeps the generated code small."""
    return F.exists(F.array(*map(F.lit, signs)), lambda s: F.contains(text, s)) if signs else F.lit(False)


def bound(text: Column, f) -> Column:
    """``f(text)`` with the text computed once, however often ``f`` uses it."""
    return F.transform(F.array(text), f)[0]


def level_name(column: str) -> Column:
    """Canonical level; '' for anything unknown."""
    wanted = F.lower(clean_text(column))
    return reduce(lambda chain, kv: chain.when(wanted == kv[0], kv[1]), list(LEVELS.items())[1:], F.when(wanted == "beginner", "Beginner")).otherwise("")


def programming_language(text: Column) -> Column:
    """First language whose sign the lower-cased text contains, else Other."""

    def pick(t: Column) -> Column:
        chain = F
        for name, signs in LANGUAGE_SIGNS:
            chain = chain.when(any_of(t, signs), name)
        return chain.otherwise("Other")

    return bound(text, pick)


def minimal(keywords: list[str]) -> list[str]:
    """Keywords of which none contains another: enough wherever one hit counts."""
    once = list(dict.fromkeys(keywords))
    return [k for k in once if not any(o != k and o in k for o in once)]


def keyword_table(lines: list[str]) -> dict[str, list[str]]:
    """Keyword table of a classifier from JSON lines ``{"category": ..., "keywords": [...]}``; order counts."""
    table: dict[str, list[str]] = {}
    for line in lines:
        if line.strip():
            entry = json.loads(line)
            table.setdefault(entry["category"], []).extend(" ".join(k.lower().split()) for k in entry["keywords"])
    return table


def ordered_category(first: Column, second: Column, table: dict[str, list[str]], default: str = "Other") -> Column:
    """First category with a keyword in ``first``; failing that, in ``second``; else the default."""

    def pick(texts: Column) -> Column:
        chain = F
        for text in (texts["first"], texts["second"]):
            for category, keywords in table.items():
                chain = chain.when(any_of(text, minimal(keywords)), category)
        return chain.otherwise(default)

    return bound(F.struct(first.alias("first"), second.alias("second")), pick) if table else F.lit(default)


def scored_topic(text: Column, table: dict[str, list[str]] | None = None, default: str = SCORED_DEFAULT) -> Column:
    """Topic with most contained keywords (each listing counts); ties go to the earlier topic."""
    table = SCORED_TOPICS if table is None else table

    def best(t: Column) -> Column:
        scores = [F.struct(reduce(Column.__add__, (F.contains(t, F.lit(k)).cast("int") for k in keywords), F.lit(0)).alias("score"), F.lit(-i).alias("rank"), F.lit(topic).alias("topic")) for i, (topic, keywords) in enumerate(table.items())]
        return F.array_max(F.array(*scores))

    return bound(bound(text, best), lambda b: F.when(b["score"] > 0, b["topic"]).otherwise(default))


def topic_labels(text: Column, table: dict[str, list[str]] | None = None, default: str = "Other") -> Column:
    """All topics of which the text contains a keyword; the default where there are none."""
    table = LABEL_TOPICS if table is None else table
    found = bound(text, lambda t: F.filter(F.array(*(F.when(any_of(t, minimal(keywords)), F.lit(topic)) for topic, keywords in table.items())), lambda x: x.isNotNull()))
    return bound(found, lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(default))))
