"""Similarity of two texts or vectors in one row: sequence ratio, pairwise TF-IDF cosine, embedding cosine."""

from __future__ import annotations

import difflib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def difflib_ratio(a: Column, b: Column, autojunk: bool = True) -> Column:
    """Ratcliff-Obershelp ratio of two texts; the order matters, and popular characters of long texts are junk unless switched off."""

    @F.pandas_udf("double")
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=autojunk).ratio() for x, y in zip(left, right)], dtype="float64")

    return ratio(a, b)


def tfidf_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``pairs`` with ``similarity``: the cosine of TF-IDF vectors fitted on just the two texts of a row.

    0 where a text is blank or neither has a word of two characters, null where a text is null. A term of both texts has idf 1,
    a term of one 1 + ln 1.5. Words are counted by an aggregation over (row, word); rows are told apart by a hash of their
    texts, as equal pairs of texts have equal scores.
    """
    one = (1 + math.log(1.5)) ** 2
    tokens = lambda t: F.coalesce(F.regexp_extract_all(F.lower(t), F.lit(r"(?U)\b\w\w+\b"), F.lit(0)), F.array().cast("array<string>"))
    texts = pairs.select(a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    keyed = texts.select(F.sha2(F.to_json(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))), 256).alias("_pair"), F.col(a).alias("_a"), F.col(b).alias("_b"))
    side = lambda text, x, y: F.transform(tokens(F.col(text)), lambda w: F.struct(w.alias("w"), F.lit(x).alias("x"), F.lit(y).alias("y")))
    words = keyed.select("_pair", F.inline(F.concat(side("_a", 1, 0), side("_b", 0, 1))))
    counted = words.groupBy("_pair", "w").agg(F.sum("x").cast("double").alias("x"), F.sum("y").cast("double").alias("y"))
    idf = lambda other: F.when(F.col(other) > 0, F.lit(1.0)).otherwise(F.lit(one))
    norms = counted.groupBy("_pair").agg(F.sum(F.col("x") * F.col("y")).alias("_dot"), F.sqrt(F.sum(F.col("x") * F.col("x") * idf("y"))).alias("_na"), F.sqrt(F.sum(F.col("y") * F.col("y") * idf("x"))).alias("_nb"))
    marked = pairs.withColumn("_pair", F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.sha2(F.to_json(F.struct(F.col(a).alias("a"), F.col(b).alias("b"))), 256)))
    score = F.when(F.col("_pair").isNotNull(), F.coalesce(F.try_divide(F.col("_dot"), F.col("_na") * F.col("_nb")), F.lit(0.0)))
    return marked.join(norms, "_pair", "left").withColumn("similarity", score).drop("_pair", "_dot", "_na", "_nb")


def embedding_similarity(a: Column, b: Column) -> Column:
    """Cosine of two vectors, clamped to 0..1; 0 where a vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    cosine = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(cosine, F.lit(0.0)))))


def _embedded(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.withColumn("similarity", embedding_similarity(F.col(f"{a}_vector"), F.col(f"{b}_vector")))


#: Methods by name; vectors stand in columns named after the texts', with "_vector" behind.
METHODS: dict[str, Callable[[DataFrame, str, str], DataFrame]] = {
    "embedding": _embedded,
    "tfidf": tfidf_similarity,
    "difflib": lambda pairs, a, b: pairs.withColumn("similarity", difflib_ratio(F.col(a), F.col(b))),
}


def compare(pairs: DataFrame, expected: str, actual: str, method: str = "tfidf", id_column: str = "dialogue_id") -> DataFrame:
    """``id, similarity, method, expected_chars, actual_chars`` of the rows that have both texts; similarity to six digits.

    Without columns of vectors "embedding" falls back to "tfidf"; ``method`` names what was used.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    if method == "embedding" and not {f"{expected}_vector", f"{actual}_vector"} <= set(pairs.columns):
        method = "tfidf"
    scored = METHODS[method](pairs.filter(F.col(expected).isNotNull() & F.col(actual).isNotNull()), expected, actual)
    return scored.select(id_column, F.round("similarity", 6).alias("similarity"), F.lit(method).alias("method"), F.length(expected).alias("expected_chars"), F.length(actual).alias("actual_chars"))


def summary(details: DataFrame, value: str = "similarity") -> DataFrame:
    """One row: ``n, mean, median, min, max, stdev`` of the values; all null without values, stdev null below two."""
    x = F.col(value)
    return details.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), F.when(F.count(x) > 1, F.stddev_samp(x)).alias("stdev"))


def match_outcomes(test: DataFrame, master: DataFrame, id_column: str = "dialogue_id") -> DataFrame:
    """``test`` (id, ``actual``) with the master's ``expected`` and an ``outcome``: compared, not in master or missing content.

    Both have one row per id; rows of ``test`` keep their other columns, such as the place they are listed by.
    """
    known = master.select(id_column, "expected", F.lit(True).alias("_known"))
    outcome = F.when(F.col("_known").isNull(), "not in master").when(F.col("expected").isNull() | F.col("actual").isNull(), "missing content").otherwise("compared")
    return test.join(known, id_column, "left").withColumn("outcome", outcome).drop("_known")
