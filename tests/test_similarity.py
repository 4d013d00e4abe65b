import difflib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dialogforge.operators import similarity

PAIRS = [("the cat sat", "the cat ran"), ("  ", "abc"), ("a", "b"), ("x y", None), ("Äpfel über alles alles", "über alles"), ("same words", "same words")]


def reference(a, b):
    ta, tb = (Counter(re.findall(r"\b\w\w+\b", t.lower())) for t in (a, b))
    idf = {t: 1.0 if t in ta and t in tb else 1 + math.log(1.5) for t in ta | tb}
    norm = lambda t: math.sqrt(sum((n * idf[w]) ** 2 for w, n in t.items()))
    return sum(ta[w] * tb[w] * idf[w] ** 2 for w in ta) / (norm(ta) * norm(tb)) if ta and tb else 0.0


def test_tfidf(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PAIRS)], "i int, a string, b string")
    got = [r.s for r in similarity.tfidf_similarity(df, "a", "b").select("i", F.col("similarity").alias("s")).orderBy("i").collect()]
    for (a, b), s in zip(PAIRS, got):
        assert s == (None if b is None else pytest.approx(reference(a, b)))


def test_difflib_keeps_autojunk(spark):
    a = "".join(chr(97 + k % 23) for k in range(600))
    b = a[:300] + "#" + a[301:]
    df = spark.createDataFrame([(a, b), (a, None)], "a string, b string")
    got = [r.s for r in df.select(similarity.difflib_ratio(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got[0] == difflib.SequenceMatcher(None, a, b).ratio() < 0.9 and got[1] is None
    plain = df.limit(1).select(similarity.difflib_ratio(F.col("a"), F.col("b"), autojunk=False)).first()[0]
    assert plain > 0.99


def test_embeddings_are_clamped(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(similarity.embedding_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0, None]


def test_compare_and_summary(spark):
    df = spark.createDataFrame([("d", "ab cd", "ab cd"), ("e", "ab", None)], "dialogue_id string, x string, y string")
    r = similarity.compare(df, "x", "y").collect()
    assert [tuple(x) for x in r] == [("d", 1.0, "tfidf", 5, 5)]
    s = similarity.summary(similarity.compare(df, "x", "y")).first()
    assert (s.n, s.mean, s.stdev) == (1, 1.0, None)
    assert similarity.summary(similarity.compare(df.limit(0), "x", "y")).first().mean is None
    with pytest.raises(ValueError):
        similarity.compare(df, "x", "y", "unknown")


def test_embeddings_fall_back_to_words(spark):
    df = spark.createDataFrame([(1, "a word", "a word", [1.0, 0.0], [0.0, 1.0])], "dialogue_id int, e string, a string, e_vector array<double>, a_vector array<double>")
    got = [similarity.compare(x, "e", "a", "embedding").first() for x in (df, df.drop("a_vector"))]
    assert [(r.method, r.similarity) for r in got] == [("embedding", 0.0), ("tfidf", 1.0)]


def test_repeated_rows_have_one_score_each(spark):
    df = spark.createDataFrame([(1, "red blue blue", "blue"), (1, "red blue blue", "blue"), (2, "x", "y"), (3, None, "y")], "i int, a string, b string")
    got = [(r.i, r.similarity) for r in similarity.tfidf_similarity(df, "a", "b").orderBy("i").collect()]
    assert got[0] == got[1] and 0 < got[0][1] < 1 and got[2:] == [(2, 0.0), (3, None)]
