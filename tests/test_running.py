import random

from pyspark.sql import functions as F

from dialogforge.operators import turns
from dialogforge.operators.running import before


def test_running_sums_cross_chunks(spark):
    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), k, rng.randrange(5)) for k in range(300)]
    df = spark.createDataFrame(rows, "k string, o int, v int").withColumn("c", F.floor(F.col("o") / 17)).repartition(5)
    got = {(r.k, r.o): r.s for r in before(df, ["k"], ["c"], ["o"], {"s": F.col("v")}).collect()}
    sums, want = {}, {}
    for k, o, v in rows:
        want[k, o] = sums.get(k, 0)
        sums[k] = want[k, o] + v
    assert got == want


def test_long_dialogues_are_cut(spark, monkeypatch):
    rows = [("d", k, k, ["user", "assistant", "assistant"][k % 3], "xy", None, None) for k in range(40)]
    df = spark.createDataFrame(rows, "dialogue_id string, msg_id bigint, msg_index int, role string, content string, code_snippet string, contains_code boolean")
    results = []
    for size in (10_000, 7):
        monkeypatch.setattr(turns, "CHUNK", size)
        results.append([sorted(map(tuple, f(df).collect())) for f in (turns.rewrap, turns.prefixes, turns.requests)])
    assert results[0] == results[1]
