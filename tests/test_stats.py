import statistics
from math import comb

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dialogforge.functions.stats import pass_at_k, summarise


def test_summary_example(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (1, 2, 3, 4, 10, 12.5)] + [("b", 7.0), ("c", None)], "k string, x double")
    got = {r.k: r for r in summarise(df, ["k"], "x").collect()}
    assert (got["a"].q1, got["a"].q3) == (1.75, 10.625)
    assert got["a"].stdev == pytest.approx(4.694855340334425)
    assert (got["b"].stdev, got["b"].q1, got["b"].q3, got["b"].median) == (0.0, 7.0, 7.0, 7.0)
    assert "c" not in got


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=2, max_size=12))
def test_summary_is_the_standard_librarys(spark, xs):
    got = summarise(spark.createDataFrame([(float(x),) for x in xs], "x double").withColumn("k", F.lit(1)), ["k"], "x").first()
    q = statistics.quantiles(xs, n=4)
    assert (got.n, got.median, got.q1, got.q3) == (len(xs), statistics.median(xs), q[0], q[2])
    assert got.mean == pytest.approx(statistics.fmean(xs)) and got.stdev == pytest.approx(statistics.stdev(xs), abs=1e-9)


def test_pass_at_k(spark):
    cases = [(5, 0, 1), (5, 5, 1), (5, 2, 3), (10, 3, 5), (2, 1, 2), (0, 0, 1)]
    for n, c, k in cases:
        got = spark.range(1).select(pass_at_k(F.lit(n), F.lit(c), k).alias("p")).first().p
        want = None if n == 0 else 1 - comb(n - c, k) / comb(n, k)
        assert got == (None if want is None else pytest.approx(want))
