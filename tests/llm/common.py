"""Brute-force twins and hard tables for the operators' tests."""

import re

SPACES = r"[^\x20\x09-\x0D]+"
SMALL = "/root/testdata/sf0.001"

# Null and empty texts, no words, one word, copies, an extra column whose name some operator uses.
HARD = [
    (1, None, "en", None, 0, "x"),
    (2, "", "en", "a", 0, "x"),
    (3, " \t\n ", "en", "a", 4, "x"),
    (4, "word", "en", "b", 4, "x"),
    (5, "one two three four five six seven eight nine ten eleven twelve", "en", "b", 60, "x"),
    (6, "one two three four five six seven eight nine ten eleven twelve", "fr", "a", 60, "y"),
    (6, "one two three four five six seven eight nine ten eleven twelve", "fr", "a", 60, "y"),
    (7, "ONE two three four five six seven eight nine ten eleven twelve", "fr", None, 60, "y"),
    (None, "one two three four five six seven eight nine ten eleven twelve", "fr", "c", 60, "y"),
    (None, None, None, None, None, None),
    (8, "é" * 50 + " ß. ñ! " * 30, "de", "a", 260, "z"),
    (9, " ".join(f"w{i}" for i in range(30_000)), "en", "a", 10, "z"),
    (10, "x" * 200_000, "en", "a", 10, "z"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string"


def hard(spark, parts=3):
    return spark.createDataFrame(HARD, SCHEMA).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
