"""Scores of evaluated dialogues: the long table, zeroing by failed code runs, statistics, verdicts, rankings and pass@k.

Records are rows with an id, a task and ``scores`` (map of judge -> array of samples); null maps, arrays and samples give no
rows. A record's arrays are exploded in place; nothing is joined back across records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialogforge.functions.stats import pass_at_k, summarise
from dialogforge.functions.text import py_round

UNKNOWN = "UNKNOWN"
CODE_JUDGE = "code_tests"


def long_scores(records: DataFrame, id_column: str = "record_id", task: str = "metadata.primary_task", code_judge: str = CODE_JUDGE) -> DataFrame:
    """``record_id, task, judge, idx, score, verdict, passed, failed_code`` of every sample.

    failed_code: the code run of the same index says ``passed = false`` (missing or null is no failure). Code runs are
    indexed after null samples are dropped, other judges before.
    """
    runs = F.filter(F.element_at("scores", code_judge), lambda s: s.isNotNull())
    rows = records.select(id_column, F.coalesce(F.col(task), F.lit(UNKNOWN)).alias("task"), "scores", F.transform(runs, lambda s: s["passed"]).alias("_runs"))
    rows = rows.select(id_column, "task", "_runs", F.explode("scores").alias("judge", "samples"))
    rows = rows.select(id_column, "task", "_runs", "judge", F.posexplode("samples").alias("idx", "s")).filter("s is not null")
    failed = F.when((F.col("judge") != code_judge) & (F.col("idx") < F.size("_runs")), F.try_element_at("_runs", F.col("idx") + 1).eqNullSafe(F.lit(False)))
    return rows.select(id_column, "task", "judge", "idx", F.col("s.score").alias("score"), F.col("s.verdict").alias("verdict"), F.col("s.passed").alias("passed"), F.coalesce(failed, F.lit(False)).alias("failed_code"))


def zeroed(long: DataFrame, zero_failed: bool = True) -> DataFrame:
    """The scores that count: 0 where the code run failed, else as given; samples without a score are left out."""
    score = F.when(F.col("failed_code"), F.lit(0.0)).otherwise(F.col("score")) if zero_failed else F.col("score")
    return long.filter("score is not null").withColumn("score", score)


def score_statistics(long: DataFrame) -> DataFrame:
    """``scope, metric`` and the summary of the scores, by task and judge and over all tasks."""
    # Scores are counted by task first; the global scope sums these counts.
    counted = long.filter("score is not null").groupBy("task", F.col("judge").alias("metric"), "score").agg(F.count("*").alias("n"))
    both = counted.select(F.explode(F.array(F.concat(F.lit("task:"), F.col("task")), F.lit("GLOBAL"))).alias("scope"), "metric", "score", "n")
    return summarise(both, ["scope", "metric"], "score", "n")


def verdicts(long: DataFrame) -> DataFrame:
    """``metric, verdict, samples, share`` of the lower-cased verdicts."""
    counts = long.filter("verdict is not null").groupBy(F.col("judge").alias("metric"), F.lower("verdict").alias("verdict")).agg(F.count("*").alias("samples"))
    return counts.withColumn("share", F.col("samples") / F.sum("samples").over(W.partitionBy("metric")))


def task_ranking(long: DataFrame) -> DataFrame:
    """``metric, task, mean, n, place``: tasks by mean score, best first (ties by name)."""
    means = long.groupBy(F.col("judge").alias("metric"), "task").agg(F.avg("score").alias("mean"), F.count("score").alias("n")).filter("n > 0")
    return means.withColumn("place", F.row_number().over(W.partitionBy("metric").orderBy(F.col("mean").desc(), "task")))


def pass_rates(records: DataFrame, ks: list[int], id_column: str = "record_id", task: str = "metadata.primary_task", code_judge: str = CODE_JUDGE) -> DataFrame:
    """``task, k, records, skipped, pass_at_k``: mean over the records with at least k runs, and how many have fewer."""
    runs = F.filter(F.element_at("scores", code_judge), lambda s: s.isNotNull())
    n = F.size(runs)
    c = F.size(F.filter(runs, lambda s: s["passed"].eqNullSafe(F.lit(True))))
    tried = records.filter(F.element_at("scores", code_judge).isNotNull()).select(F.coalesce(F.col(task), F.lit(UNKNOWN)).alias("task"), n.alias("n"), c.alias("c")).filter("n > 0")
    # Records with equal counts are alike: each kind is rated once for every k.
    kinds = tried.groupBy("task", "n", "c").agg(F.count("*").alias("w")).withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    enough = F.col("n") >= F.col("k")
    weight = F.when(enough, F.col("w"))
    total = F.sum(weight)
    rate = F.sum(weight * pass_at_k(F.col("n"), F.col("c"), F.col("k")))
    grouped = kinds.groupBy("task", "k").agg(F.coalesce(total, F.lit(0)).alias("records"), F.coalesce(F.sum(F.when(~enough, F.col("w"))), F.lit(0)).alias("skipped"), F.try_divide(rate, total).alias("pass_at_k"))
    return grouped.select("task", "k", "records", "skipped", "pass_at_k")


#: Columns of the statistics file, in this order.
CSV_COLUMNS = ["scope", "metric", "n", "mean", "median", "stdev", "min", "max", "q1", "q3"]


def csv_rows(statistics: DataFrame) -> DataFrame:
    """The statistics as they are written: ten columns, numbers rounded to four digits as Python does."""
    return statistics.select(*[py_round(F.col(c), 4).alias(c) if c in CSV_COLUMNS[3:] else F.col(c) for c in CSV_COLUMNS])


def report(statistics: DataFrame, ranking: DataFrame, verdict_table: DataFrame) -> str:
    """A Markdown report from the small aggregates."""

    def block(title: str, df: DataFrame, order: list[Column]) -> str:
        rows = df.orderBy(*order).collect()  # one row per task and judge
        head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns)
        return f"## {title}\n\n{head}\n" + "\n".join("| " + " | ".join(f"{v:.3f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in rows)

    return "\n\n".join(
        [
            "# Scores",
            block("Statistics", statistics, [F.col("scope") != "GLOBAL", F.col("scope"), F.col("metric")]),
            block("Ranking", ranking, [F.col("metric"), F.col("place")]),
            block("Verdicts", verdict_table, [F.col("metric"), F.col("samples").desc()]),
        ]
    )
