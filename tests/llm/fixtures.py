"""Small tables that hold the cases every operator must survive."""

from __future__ import annotations

import random

from pyspark.sql import types as T

LONG_WORDS = 60_000

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # columns of the caller whose names the operators use themselves
    T.StructField("size", T.StringType()), T.StructField("mix", T.StringType()), T.StructField("score", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("fp", T.StringType()), T.StructField("label", T.StringType()),
    T.StructField("length", T.StringType()), T.StructField("r", T.StringType()), T.StructField("target", T.StringType()),
])
EXTRA = ("x",) * 9
WORDS = {"en": "the of and to in that it is was for with this from are have but they which one all".split(),
         "de": "der die und das ist nicht ein eine mit auf für von dem den zu sich auch wird als".split()}


def prose(lang: str, n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n)).capitalize() + "."


def edge_rows() -> list[tuple]:
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", "en", None), (None, prose("en", 30, 1), "en", "b"), (None, None, None, None),
            (4, prose("en", LONG_WORDS, 2), "en", "b"), (5, prose("de", 40, 3), None, "c"), (6, "12345 !!! ???", "en", "c"),
            (7, prose("de", 30, 4), "de", None), (7, prose("de", 30, 4), "de", None), (7, prose("de", 30, 4), "de", None),
            (8, "x" * 200_000, "de", "a"), (9, "naïve \U0001f600 öäü a\x00b", "de", "a"), (-10, prose("en", 25, 5), "en", "a")]
    rows += [(i, prose(lang, 20 + i % 50, i), lang, f"s{i % 5}") for i in range(100, 220) for lang in (("en", "de")[i % 2],)]
    return [(i, t, la, s, None if t is None else len(t), *EXTRA) for i, t, la, s in rows]


def edge_docs(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(4)


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def null_rows(spark):
    return spark.createDataFrame([(None,) * len(SCHEMA)] * 3, SCHEMA)
