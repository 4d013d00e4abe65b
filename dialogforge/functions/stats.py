"""Statistics: exclusive quartiles by counted values, pass@k, and the ten-column summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def pass_at_k(n: Column, c: Column, k: Column | int) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product; 1 where fewer than k samples failed, null without samples."""
    failed = n - c
    k = k if isinstance(k, Column) else F.lit(k)
    product = F.aggregate(F.sequence((failed + 1).cast("int"), n.cast("int")), F.lit(1.0), lambda a, i: a * (F.lit(1.0) - k.cast("double") / i))
    return F.when(n <= 0, F.lit(None)).when(failed < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0) - product)


def summarise(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """``keys, n, mean, median, stdev, min, max, q1, q3`` of the non-null values of each group.

    stdev is the sample's, 0 for one value; quartiles are exclusive (extrapolating for two values; the value itself for one).
    Values are counted per group first, so that a group's rows are never gathered: what is ordered in one place is its
    distinct values only. weight: a column that says how often a row's value occurs, where that has been counted already.
    """
    occurs = F.sum(weight) if weight else F.count("*")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(occurs.alias("_c"))
    up_to = W.partitionBy(*keys).orderBy("_x")
    whole = W.partitionBy(*keys)
    placed = counted.withColumn("_last", F.sum("_c").over(up_to)).withColumn("_n", F.sum("_c").over(whole)).withColumn("_first", F.col("_last") - F.col("_c") + 1)

    def at(rank: Column) -> Column:
        """The value of this rank (1 to n)."""
        return F.max(F.when((F.col("_first") <= rank) & (rank <= F.col("_last")), F.col("_x")))

    n = F.col("_n")
    wanted = {"m1": F.floor((n + 1) / 2), "m2": F.floor(n / 2) + 1}
    for q in (1, 3):
        j = F.least(F.greatest(F.floor((n + 1) * q / 4), F.lit(1)), n - 1)
        wanted |= {f"q{q}_j": j, f"q{q}_k": j + 1}
    sums = placed.groupBy(*keys).agg(
        F.max("_n").alias("n"),
        (F.sum(F.col("_x") * F.col("_c")) / F.max("_n")).alias("mean"),
        F.min("_x").alias("min"),
        F.max("_x").alias("max"),
        *[at(r.cast("bigint")).alias(f"_{name}") for name, r in wanted.items()],
        F.sum(F.col("_x") * F.col("_x") * F.col("_c")).alias("_squares"),
        F.sum(F.col("_x") * F.col("_c")).alias("_sum"),
    )
    n = F.col("n")

    def quartile(q: int) -> Column:
        j = F.least(F.greatest(F.floor((n + 1) * q / 4), F.lit(1)), n - 1)
        d = (n + 1) * q - j * 4
        return F.when(n == 1, F.col("min")).otherwise((F.col(f"_q{q}_j") * (4 - d) + F.col(f"_q{q}_k") * d) / 4)

    variance = F.greatest(F.lit(0.0), (F.col("_squares") - F.col("_sum") * F.col("_sum") / n) / (n - 1))
    return sums.select(
        *keys, "n", "mean", ((F.col("_m1") + F.col("_m2")) / 2).alias("median"), F.when(n == 1, F.lit(0.0)).otherwise(F.sqrt(F.when(n > 1, variance))).alias("stdev"), "min", "max", quartile(1).alias("q1"), quartile(3).alias("q3")
    )
