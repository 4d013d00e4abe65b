import json

import pytest

from dialogforge import cli


def dialogue(k, text, **more):
    return {"dialogue_id": f"d{k}", "metadata": {"primary_task": "SCR"}, "turns": [{"messages": [{"role": "user", "content": text}, {"role": "assistant", "content": f"answer number {k}"}]}], "final_ground_truth": {"expected_nl_output": "answer number one"}, "scores": {"judge": [{"score": 7, "verdict": "pass"}], "code_tests": [{"passed": k % 2 == 0}]}, "kept": [1]} | more


@pytest.fixture
def data(tmp_path):
    p = tmp_path / "in.jsonl"
    rows = [dialogue(1, "the same opening of a dialogue"), dialogue(2, "the same opening of a dialogue"), dialogue(3, "another opening")]
    p.write_text("\n".join(json.dumps(r) for r in rows) + "\n\n{bad\n")
    return str(p)


def lines(spark, path):
    return [json.loads(r.value) for r in spark.read.text(path).collect()]


def test_duplicates(spark, data, tmp_path):
    out, kept = str(tmp_path / "flagged"), str(tmp_path / "kept")
    cli.main(["check-duplicates", data, "--out", out], spark)
    got = {r["dialogue_id"]: (r["duplicate_flag"], r["kept"]) for r in lines(spark, out)}
    assert got == {"d1": ("ORIGINAL (dups: L2)", [1]), "d2": ("DUPLICATE -> L1", [1]), "d3": ("UNIQUE", [1])}
    cli.main(["remove-duplicates", out, "--out", kept], spark)
    assert {r["dialogue_id"] for r in lines(spark, kept)} == {"d1", "d3"}


def test_scores_and_comparison(spark, data, tmp_path):
    cli.main(["analyze-scores", data, "--out", str(tmp_path / "a"), "--pass-at-k", "1"], spark)
    assert "# Scores" in (tmp_path / "a" / "report.md").read_text()
    assert spark.read.option("header", True).csv(str(tmp_path / "a" / "statistics")).columns[0] == "scope"
    cli.main(["compare-to-ground-truth", data, "--out", str(tmp_path / "g"), "--method", "tfidf"], spark)
    assert json.loads((tmp_path / "g" / "summary.json").read_text())["n"] == 3
    cli.main(["compare-dialogues", "--master", data, "--test", data, "--out", str(tmp_path / "c")], spark)
    assert json.loads((tmp_path / "c" / "summary.json").read_text())["mean"] == 1.0


def test_lines(spark, data, tmp_path):
    cli.main(["combine", data, "--out", str(tmp_path / "c"), "--skip-invalid"], spark)
    assert len(lines(spark, str(tmp_path / "c"))) == 3
    with pytest.raises(Exception, match="no JSON"):
        cli.main(["combine", data, "--out", str(tmp_path / "d")], spark)
    cli.main(["add-id", str(tmp_path / "c"), "--out", str(tmp_path / "i"), "--prefix", "p"], spark)
    assert {r["id"] for r in lines(spark, str(tmp_path / "i"))} <= {"p_0", "p_1", "p_2"}
    cli.main(["sample", data, "--int", "2", "--out", str(tmp_path / "s")], spark)
    assert spark.read.text(str(tmp_path / "s")).count() == 2
    cli.main(["separate", data, "--out", str(tmp_path / "t")], spark)
    assert (tmp_path / "t" / "task=SCR").is_dir()
    cli.main(["process-data", data, "--out", str(tmp_path / "p")], spark)
    assert len(lines(spark, str(tmp_path / "p"))) == 3


def test_flags_in_place_keep_a_backup_and_one_field(spark, data, tmp_path):
    folder = str(tmp_path / "flat")
    spark.read.text(data).coalesce(1).write.text(folder)
    for _ in range(2):
        cli.main(["check-duplicates", folder, "--inplace"], spark)
    got = [r.value for r in spark.read.text(folder).collect()]
    assert len(got) == 3 and all(x.count("duplicate_flag") == 1 for x in got)
    assert spark.read.text(folder + ".backup").count() == spark.read.text(data).count()
    cli.main(["remove-duplicates", folder, "--inplace"], spark)
    assert spark.read.text(folder).count() == 2
    with pytest.raises(SystemExit):
        cli.main(["remove-duplicates", folder], spark)


def test_ids_at_a_dotted_path(spark, data, tmp_path):
    out = str(tmp_path / "ids")
    cli.main(["add-id", data, "--out", out, "--json-path", "metadata.id", "--prefix", "x"], spark)
    got = [json.loads(r.value) for r in spark.read.text(out).collect() if r.value.startswith("{\"d")]
    assert [(r["metadata"]["id"], "metadata.id" in r) for r in got] == [("x_0", False), ("x_1", False), ("x_2", False)]


def test_rewrap_extract_and_batches(spark, data, tmp_path):
    simple = tmp_path / "simple.jsonl"
    simple.write_text(json.dumps({"dialogue_id": "d1", "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}, {"role": "user", "content": "r"}]}) + "\n")
    cli.main(["rewrap", data, "--simple", str(simple), "--out", str(tmp_path / "re")], spark)
    (one,) = lines(spark, str(tmp_path / "re"))
    assert one["kept"] == [1] and [[m["content"] for m in t["messages"]] for t in one["turns"]] == [["q", "a"], ["r"]]
    cli.main(["extract-code", str(tmp_path), "--out", str(tmp_path / "code")], spark)
    assert {p.name for p in (tmp_path / "code").iterdir() if p.is_dir()} == {"source=in.jsonl", "source=simple.jsonl"}
    prompts = tmp_path / "prompts.txt"
    prompts.write_text("one\n\ntwo\n")
    cli.main(["prep-batch", str(prompts), "--model", "m", "--header", "H", "--copies", "2", "--out", str(tmp_path / "b")], spark)
    assert {(r["custom_id"], r["body"]["messages"][0]["content"]) for r in lines(spark, str(tmp_path / "b"))} == {("id_0", "H\none"), ("id_1", "H\none"), ("id_2", "H\ntwo"), ("id_3", "H\ntwo")}
