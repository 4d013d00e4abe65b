import json

from pyspark.sql import functions as F

from dialogforge.operators import records, requests


def test_numbering_is_the_order(spark):
    df = spark.range(500).select((F.lit(499) - F.col("id")).alias("v")).repartition(7)
    got = [(r.v, r.number) for r in records.numbered(df, ["v"], start=3).collect()]
    assert sorted(got) == [(k, k + 3) for k in range(500)]
    assert records.numbered(df.limit(0), ["v"]).count() == 0


def test_batch_requests(spark, tmp_path):
    for tier, task in (("a", "x"), ("b", "y")):
        (tmp_path / tier / task).mkdir(parents=True)
        (tmp_path / tier / task / "PROMPT.md").write_text(f"prompt {task}")
    library = requests.prompt_library(spark, str(tmp_path))
    rows = requests.batch_requests(library, ["tier", "task"], "some-model", header="H", copies=2, tools=["run"], start=5).orderBy("custom_id").collect()
    assert [r.custom_id for r in rows] == ["id_5", "id_6", "id_7", "id_8"]
    body = rows[0].body
    assert body.messages[0].content == "H\nprompt x" and body.max_tokens == 3000 and body.tools[0].name == "run" and body.temperature is None
    assert requests.batch_requests(library, ["tier"], "m", limit=1).count() == 1


def test_split_turns(spark):
    kind = "array<struct<turn_id:bigint,messages:array<struct<role:string,content:string,old:string>>>>"
    rows = [([{"turn_id": 1, "messages": [{"role": "user", "content": "a\n```py\nx\n```", "old": "o"}, None, {"role": "user", "content": None, "old": None}]}, None, {"turn_id": None, "messages": None}],), (None,), ([],)]
    got = [r.t for r in spark.createDataFrame(rows, f"turns {kind}").coalesce(1).select(requests.split_turns(F.col("turns")).alias("t")).collect()]
    assert got[1:] == [None, []]
    first, second, third = got[0]
    assert second is None and third.messages is None
    assert first.messages[0].asDict(recursive=True) == {"role": "user", "content": "a", "code_snippet": "x", "metadata": {"contains_code": True, "intent": ""}}
    assert first.messages[1] is None and first.messages[2].content is None


def test_containers(spark):
    m = [{"role": "user", "content": "c", "other": 1}]
    raws = [{"conversation": m, "messages": []}, {"messages": m}, {"turns": [{"messages": m}, {"messages": m}]}, {"turns": m}, {"x": 1}]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(raws)] + [(5, None), (6, "{bad")], "i int, raw string")
    got = [r.n for r in df.select("i", F.size(requests.message_container(F.col("raw"))).alias("n")).orderBy("i").collect()]
    assert got[:4] == [1, 1, 2, 1] and all(n in (None, -1) for n in got[4:])


def test_judge_pairs(spark):
    df = spark.createDataFrame([(1, {"expected_nl_output": "e"}, None), (2, None, None)], "record_id bigint, final_ground_truth struct<expected_nl_output:string>, turns array<struct<a:int>>")
    assert [tuple(r) for r in requests.judge_pairs(df).collect()] == [(1, "", '{"expected_nl_output":"e"}', "{}")]
    assert [tuple(r) for r in requests.answer_pairs(df).collect()] == [(1, "e")]
    many = spark.createDataFrame([(1, "g", "r", ["a", "b"])], "record_id bigint, guideline string, reference string, candidates array<string>")
    assert {(r["index"], r.candidate) for r in requests.judged_candidates(many).collect()} == {(0, "a"), (1, "b")}


def test_records_are_split_wherever_they_keep_messages(spark):
    rows = ['{"k": 1, "messages": [{"role": "user", "content": "see\\nimport a\\na.b()", "x": 1}, 5]}', '{"turns": [{"turn_id": 1, "messages": [{"role": "r", "content": null}]}, null]}', '{"conversation": "none", "messages": []}', "[1]", "bad", None]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, raw string")
    got = [None if r.o is None else json.loads(r.o) for r in df.orderBy("k").select(requests.split_records(F.col("raw")).alias("o")).collect()]
    assert got[0] == {"k": 1, "messages": [{"role": "user", "content": "see", "code_snippet": "import a\na.b()", "metadata": {"contains_code": True, "intent": ""}}, 5]}
    assert got[1]["turns"] == [{"turn_id": 1, "messages": [{"role": "r", "content": None, "code_snippet": "", "metadata": {"contains_code": False, "intent": ""}}]}, None]
    assert got[2:] == [{"conversation": "none", "messages": []}, None, None, None]
