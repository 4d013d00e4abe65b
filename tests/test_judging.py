import pytest
from pyspark.sql import functions as F

from dialogforge.operators import judging


def test_replies(spark):
    replies = ['{"score": 6, "reasoning": "r", "strengths": ["s"]}', '```json\n{"score": "7"}\n```', '{"score": 7.9}', '{"score": 0}', '{"score": 11}', '{"score": null}', "[1]", "no json", None, '{"score": 3}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    got = [(r.j.score, r.j.verdict) for r in df.select("i", judging.parse_judgement(F.col("r")).alias("j")).orderBy("i").collect()]
    assert got == [(6, "pass"), (7, "pass"), (7, "pass"), *[(0, "error")] * 6, (3, "fail")]


def test_judge_runs_through_the_client(spark):
    df = spark.createDataFrame([(1, "g", "r", "c")], "i int, guideline string, reference string, candidate string")
    assert judging.judge(df, judging.EchoClient).first().judgement.verdict == "error"
    with pytest.raises(ValueError):
        judging.judge(df, judging.EchoClient, threshold=0)
    assert spark.range(1).select(judging.mock_output(F.lit("x" * 30))).first()[0] == "Mock output for: " + "x" * 20


def test_retries():
    class Limited(Exception):
        status_code = 429

    calls, delays = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise Limited
        return "ok"

    assert judging.with_retries(call, sleep=delays.append) == "ok" and len(delays) == 2
    with pytest.raises(KeyError):
        judging.with_retries(lambda: {}["x"], sleep=delays.append)
