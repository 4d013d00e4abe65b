import json

import pytest
from pyspark.sql import functions as F

from dialogforge.sources import jsonl


@pytest.fixture
def file(tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"dialogue_id":"a","v":1}\n\n{bad\n{"dialogue_id":"a","v":2}\n{"dialogue_id":null}\n{"a":1} x\n', encoding="utf-8")
    return str(p)


def test_lines_are_physical(spark, file):
    rows = jsonl.scan_lines(spark, file).orderBy("line_no").collect()
    assert [r.line_no for r in rows] == [1, 2, 3, 4, 5, 6] and rows[1].raw == ""
    assert jsonl.scan_records(spark, file).count() == 6


def test_lines_of_a_file_in_several_splits(spark, tmp_path):
    p = tmp_path / "big.jsonl"
    p.write_text("".join(f"{k:05d} {'x' * (k % 90)}\r\n" for k in range(3000)))
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = jsonl.scan_lines(spark, str(p)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert sorted((r.line_no, r.raw) for r in rows) == [(k + 1, f"{k:05d} {'x' * (k % 90)}") for k in range(3000)]


def test_modes(spark, file):
    lines = jsonl.scan_lines(spark, file)
    assert sorted(r.line_no for r in jsonl.validated(lines).collect()) == [1, 4, 5]
    assert [(r.line_no, r.snippet) for r in jsonl.malformed(lines).orderBy("line_no").collect()] == [(3, "{bad"), (6, '{"a":1} x')]
    with pytest.raises(Exception, match="no JSON"):
        jsonl.validated(lines, on_bad="error").collect()
    with pytest.raises(Exception, match="blank"):
        jsonl.validated(lines, on_blank="error").collect()
    with pytest.raises(ValueError):
        jsonl.validated(lines, on_bad="other")


def test_keyed(spark, file):
    rows = jsonl.keyed(jsonl.scan_lines(spark, file)).collect()
    assert [(r.key, r.line_no) for r in rows] == [("a", 4)]


def test_json_files(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"a": 1}')
    (tmp_path / "two.json").write_text('[{"a": 2}, {"a": 3}]')
    rows = jsonl.scan_json_file(spark, str(tmp_path / "*.json")).collect()
    assert sorted(json.loads(r.raw)["a"] for r in rows) == [1, 2, 3]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("ä", 1), ("b", None)], "s string, n int")
    out = str(tmp_path / "out")
    jsonl.write_jsonl(df, out)
    assert sorted(r.value for r in spark.read.text(out).collect()) == ['{"s":"b","n":null}', '{"s":"ä","n":1}']
    jsonl.replace(spark.read.json(out).filter("n = 1"), out, backup=True)
    assert [r.n for r in spark.read.json(out).collect()] == [1] and spark.read.json(out + ".backup").count() == 2
    jsonl.append_with_ids(df, str(tmp_path / "app"), ["s"])
    jsonl.append_with_ids(df, str(tmp_path / "app"), ["s"])
    assert sorted(r.custom_id for r in spark.read.json(str(tmp_path / "app")).collect()) == ["id_0", "id_1", "id_2", "id_3"]
    jsonl.write_by(df, "s", str(tmp_path / "by"))
    assert (tmp_path / "by" / "s=b").is_dir()
    jsonl.write_lines(df.select(F.col("s").alias("raw")), str(tmp_path / "raw"))
    assert spark.read.text(str(tmp_path / "raw")).count() == 2
    df.write.option("header", True).csv(str(tmp_path / "csv"))
    assert dict(jsonl.read_csv(spark, str(tmp_path / "csv")).dtypes)["n"] == "int"


def test_names():
    assert jsonl.output_names(["a.jsonl"], "deduped") == ["a.deduped.jsonl"]
    assert jsonl.output_names(["a.jsonl"], "x", out="o.jsonl") == ["o.jsonl"]
    assert jsonl.output_names(["p/a.jsonl", "b.jsonl"], "x", out="d") == ["d/a.jsonl", "d/b.jsonl"]
    assert jsonl.output_names(["a"], "x", inplace=True) == ["a"]
    with pytest.raises(ValueError):
        jsonl.output_names(["a"], "x", out="o", inplace=True)


def test_excel_is_gated(spark):
    with pytest.raises(RuntimeError):
        jsonl.read_excel(spark, "x.xlsx")


def test_ascii_lines(spark, tmp_path):
    out = str(tmp_path / "a")
    jsonl.write_jsonl(spark.createDataFrame([("é",)], "x string"), out, ascii=True)
    assert [r.value.lower() for r in spark.read.text(out).collect()] == ['{"x":"\\u00e9"}']
