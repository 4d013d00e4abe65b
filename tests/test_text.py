from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dialogforge.functions import tasks, text


def values(spark, inputs, f, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, x {kind}")
    return [r.v for r in df.select("i", f(F.col("x")).alias("v")).orderBy("i").collect()]


def test_norm_text_keeps_runs_of_blanks(spark):
    assert values(spark, [" Hé,  lo\n W x", None, "", "A\tB"], text.norm_text) == ["h   lo w x", "", "", "a b"]


def test_fences(spark):
    two = "prose ```json\n{\"a\":1}\n``` more ```json\n{}\n```"
    assert values(spark, [two, "plain", None, "```json\n{} "], text.unwrap_fenced_json) == ['{"a":1}', "plain", None, "{}"]
    assert values(spark, ["```json\n{}\n```", " x "], text.strip_code_fence) == ["{}", "x"]
    assert values(spark, ["```json\n{}\n```", "{} ```"], text.unfence_judgement) == ["{}", "{} ```"]
    assert values(spark, ["a\n```py\nx = 1\n```\nb\n```\ny\n```", "```py\nopen"], text.fenced_blocks) == [["x = 1\n", "y\n"], []]


def test_custom_ids(spark):
    assert values(spark, ["id_0", "id_00", "id_01", "id_05", "id_0x", "other", None], text.custom_id_index) == [0, 1, 2, 6, None, None, None]


def test_parse_k_values():
    assert text.parse_k_values("3, 1,1") == [1, 3]
    for bad in ("", "0", "x"):
        with pytest.raises(ValueError):
            text.parse_k_values(bad)


def test_split_text_and_code(spark):
    assert text.split_text_and_code("Fix this:\ndef f():\n  pass") == ("Fix this:", "def f():\n  pass")
    assert text.split_text_and_code("") == ("", "")
    got = values(spark, ["a\n```py\nx\n```\nb", None], lambda c: text.text_and_code(c)["code"])
    assert got == ["x", None]


def test_tests_are_wrapped(spark):
    assert values(spark, ["assert f(1)\nassert f(2)", "import pytest\n"], text.wrap_test) == ["def check():\n    assert f(1)\n    assert f(2)", "import pytest\n"]


def test_json_validity_is_pythons(spark):
    assert values(spark, ['{"a":1}', '{"a":1} x', '{"a":1,"a":2}', '{"a":NaN}', "{bad", None], text.json_valid) == [True, False, True, True, False, None]


def test_rounding_is_pythons(spark):
    assert values(spark, [0.125, 2.675, None], lambda c: text.py_round(c, 2), "double") == [0.12, 2.67, None]


def test_small_renderings(spark):
    assert values(spark, [3, 12], text.score_bar, "int") == ["███░░░░░░░", "██████████"]
    assert values(spark, [1], lambda c: text.percent(c, F.lit(8)), "int") == ["12.5%"]
    assert values(spark, [datetime(2025, 3, 1, 4, 5, 6)], text.run_stamp, "timestamp") == ["01-03-2025-04-05-06"]


def test_task_codes(spark):
    names = ["Code Comprehension & Analysis", "Code Comprehension and Analysis (CCA)", "drc", "Multi-Turn Program Reasoning", None, "Semantic Code Rewriting"]
    assert values(spark, names, tasks.strict_task_code) == ["CCA", "CCA", None, "MPR", None, "SCR"]
    assert values(spark, names, tasks.loose_task_code) == ["MPR", "CCA", "DRC", None, None, "SCR"]
    assert values(spark, names, tasks.task_code) == ["CCA", "CCA", "DRC", "MPR", None, "SCR"]
    assert values(spark, ["SCR", "CD", "x"], tasks.evaluators_of) == [["code", "judge"], ["judge"], None]
    assert values(spark, ["SCR", "CD"], lambda c: tasks.evaluators_of(c, code_only=True)) == [["code"], []]
    assert tasks.task_table(spark).count() == 11


def test_prose_that_begins_like_an_import_is_no_code():
    assert text.split_text_and_code("from now on the cache is shared.\nimport") == ("from now on the cache is shared.\nimport", "")
    assert text.split_text_and_code("see\nfrom a import b\nb()") == ("see", "from a import b\nb()")
