import json

import pytest
from pyspark.sql import functions as F

from dialogforge.functions.text import json_valid
from dialogforge.operators import records


def test_last_wins(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), ("b", 1, None)], "k string, o int, v string")
    assert {(r.k, r.v) for r in records.last_wins(df, "k", ["o"]).collect()} == {("a", "y"), ("b", None)}
    assert [tuple(r) for r in records.repeated_keys(df, "k").collect()] == [("a", 2)]
    assert records.last_wins(df.limit(0), "k", ["o"]).count() == 0


def test_pairs_and_missing(spark):
    inputs = spark.createDataFrame([(i,) for i in range(4)], "line_index bigint")
    outputs = spark.createDataFrame([("id_0", 1, "a"), ("id_00", 2, "b"), ("id_00", 3, "c"), ("x", 4, "d"), (None, 5, "e")], "custom_id string, out_order int, v string")
    assert {(r.line_index, r.v) for r in records.pair_by_index(inputs, outputs).collect()} == {(0, "a"), (1, "c")}
    assert {r.line_index for r in records.missing_outputs(inputs, outputs).collect()} == {2, 3}


def test_envelopes(spark):
    a = {"result": {"type": "succeeded", "message": {"stop_reason": "end", "content": [{"type": "text", "text": "```json\n{\"x\":1}\n```"}]}}}
    cut = {"result": {"message": {"stop_reason": "max_tokens", "content": [{"text": "t"}]}}}
    b = {"response": {"body": {"choices": [{"finish_reason": "stop", "message": {"content": "plain"}}]}}}
    raws = [json.dumps(x) for x in (a, cut, b, {"dialogue_id": None}, {"result": {"type": "errored"}}, {"other": 1})] + ["{bad", None]
    got = [r.payload for r in records.open_envelopes(spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")).orderBy("i").collect()]
    assert got == ['{"x":1}', "plain", '{"dialogue_id": null}']


def test_expand_payload(spark):
    contents = ['```json\n{"content":"c","code_snippet":"x"}\n```', '{"other":1}', "text", None, "[1]"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "i int, c string")
    got = [tuple(r.m) for r in df.select("i", records.expand_payload(F.lit("user"), F.col("c")).alias("m")).orderBy("i").collect()]
    assert got == [("user", "c", "x"), ("user", None, None), ("user", "text", None), ("user", None, None), ("user", "[1]", None)]


def test_ids_and_paths(spark):
    df = spark.createDataFrame([(1, "a"), (3, "b")], "line_no bigint, raw string")
    assert [r.id for r in records.add_ids(df, "p").orderBy("line_no").collect()] == ["p_0", "p_2"]
    assert [r.id for r in records.add_ids(df).orderBy("line_no").collect()] == ["0", "2"]
    nested = records.set_nested(records.set_nested(df, "a.b", F.lit(1)), "a.c", F.lit(2)).first()
    assert (nested.a.b, nested.a.c) == (1, 2)
    twice = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "id string, o int")
    assert {r.id for r in records.unique_ids(twice, "id", ["o"]).collect()} == {"x", "x-1", "y"}


def test_line_counts(spark):
    df = spark.createDataFrame([("f", "{}"), ("f", " "), ("f", None), ("f", "{bad")], "f string, raw string")
    r = records.line_counts(df, json_valid(F.col("raw")), ["f"]).first()
    assert (r.lines, r.blank, r.valid, r.invalid) == (4, 2, 1, 1)


def test_split_results(spark):
    df = spark.createDataFrame([("succeeded",), ("errored",), ("expired",), ("canceled",), (None,)], "t string")
    assert sorted(r.output for r in records.split_results(df, F.col("t")).collect()) == ["error", "error", "success"]


def test_joined_text(spark):
    kind = "array<struct<type:string,text:string>>"
    df = spark.createDataFrame([([{"type": "text", "text": "a"}, {"type": "tool", "text": "x"}, {"type": "text", "text": None}, {"type": "text", "text": "b"}],)], f"c {kind}")
    assert df.select(records.joined_text(F.col("c"))).first()[0] == "a  b"


@pytest.mark.parametrize("n", [0, 1, 50, 999, 1000, 2000])
def test_exact_samples(spark, n):
    rows = spark.range(1000)
    got = records.sample_exact(rows, n, ["id"], seed=3)
    ids = [r.id for r in got.collect()]
    assert len(ids) == len(set(ids)) == min(n, 1000)


def test_percent_samples(spark):
    assert records.sample_percent(spark.range(25), 10, ["id"]).count() == 2  # half to even
    with pytest.raises(ValueError):
        records.sample_percent(spark.range(5), 0, ["id"])


def test_unique_ids_do_not_meet_ids_that_are_there(spark):
    rows = [("a", 1), ("a", 2), ("a-1", 3), ("a", 4), ("a-1", 5), ("a-1_", 6), (None, 7), (None, 8)]
    got = {r.o: r.id for r in records.unique_ids(spark.createDataFrame(rows, "id string, o int"), "id", ["o"]).collect()}
    assert got == {1: "a", 2: "a-1__", 3: "a-1", 4: "a-2", 5: "a-1-1", 6: "a-1_", 7: None, 8: None}
    empty = spark.createDataFrame([], "id string, o int")
    assert records.unique_ids(empty, "id", ["o"]).count() == 0


def test_a_bucket_at_the_cut_is_taken_apart(spark, monkeypatch):
    monkeypatch.setattr(records, "_BUCKETS", 2)
    monkeypatch.setattr(records, "_ORDERED", 3)
    rows = spark.range(500)
    for n in (0, 1, 77, 499, 500, 600):
        got = [r.id for r in records.sample_exact(rows, n, ["id"], seed=1).collect()]
        assert len(got) == len(set(got)) == min(n, 500)


def test_json_field_is_replaced_and_nested(spark):
    df = spark.createDataFrame([(1, '{"id": 1, "a": 2}'), (2, '{"a": {"b": 1}}'), (3, "[1]"), (4, None), (5, "bad")], "k int, raw string")
    put = lambda path: [r.r for r in df.orderBy("k").select(records.with_json_field(F.col("raw"), path, F.lit("x")).alias("r")).collect()]
    assert put("id") == ['{"id": "x", "a": 2}', '{"a": {"b": 1}, "id": "x"}', "[1]", None, "bad"]
    assert put("a.b")[:2] == ['{"id": 1, "a": {"b": "x"}}', '{"a": {"b": "x"}}']


def test_a_missing_path_stops_the_job(spark):
    df = spark.createDataFrame([('{"a": {"b": 1}}',), ('{"a": {}}',)], "raw string")
    assert records.require_path(df.limit(1), "raw", "a.b").count() == 1
    with pytest.raises(Exception, match="no value at a.b"):
        records.require_path(df, "raw", "a.b").collect()
