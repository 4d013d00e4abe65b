"""Command line: ``python -m dialogforge.cli COMMAND ...``, one command for each data tool, on JSON-lines files."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogforge.functions import tasks
from dialogforge.functions.text import json_valid, parse_k_values
from dialogforge.operators import codeeval, dedup, records, requests, scores, similarity, turns
from dialogforge.session import clear_cuts, ship
from dialogforge.sources import jsonl

#: What the tools read of a dialogue; records keep their other fields as text.
DIALOGUE = (
    "dialogue_id string, metadata struct<primary_task:string>, turns array<struct<messages:array<struct<role:string,content:string,code_snippet:string>>>>, "
    "final_ground_truth struct<expected_nl_output:string>, scores map<string,array<struct<score:double,verdict:string,passed:boolean>>>"
)


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return jsonl.scan_lines(spark, paths)


def _records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Valid lines with the dialogue's fields beside the text."""
    return jsonl.validated(_lines(spark, paths)).withColumn("d", F.from_json("raw", DIALOGUE)).select("file", "line_no", "raw", "d.*")


def _write(lines: DataFrame, a: argparse.Namespace) -> None:
    """Lines to ``--out``, or in the place of the input, of which the first version is kept as a backup."""
    if a.inplace:
        jsonl.replace(lines.select(F.col("raw").alias("value")), a.inputs[0], backup=True, text=True)
    elif a.out:
        jsonl.write_lines(lines, a.out)
    else:
        raise SystemExit("--out or --inplace is needed")


def check_duplicates(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.inplace and (a.out or len(a.inputs) > 1):
        raise SystemExit("--inplace takes one input and no --out")
    found = _records(spark, a.inputs).select(F.col("file").alias("scope"), F.col("line_no").alias("line"), turns.opening_key(F.col("turns")).alias("key"), "raw")
    flagged = dedup.flags(dedup.near_groups(found.drop("raw"), a.threshold))
    dedup.totals(flagged).show(truncate=False)
    if a.out or a.inplace:
        listed = dedup.list_duplicates(flagged)
        marked = found.join(listed, ["scope", "line"]).select("scope", "line", records.with_json_field(F.col("raw"), a.field, F.col("flag")).alias("raw"))
        _write(marked.orderBy("scope", "line"), a)


def remove_duplicates(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = _lines(spark, a.inputs).withColumn("flag", F.get_json_object("raw", f"$.{a.field}"))
    _write(dedup.remove_duplicates(lines).orderBy("file", "line_no"), a)


def analyze_scores(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _records(spark, a.inputs).withColumn("record_id", F.monotonically_increasing_id()).withColumn("task", F.get_json_object("raw", f"$.{a.task_key}"))
    long = scores.long_scores(rows, task="task")
    counted = scores.zeroed(long, not a.no_zero_failed_code_scores)
    statistics = scores.score_statistics(counted)
    jsonl.write_csv(scores.csv_rows(statistics).orderBy("scope", "metric"), f"{a.out}/statistics", "overwrite")
    jsonl.write_csv(scores.pass_rates(rows, parse_k_values(a.pass_at_k), task="task").orderBy("task", "k"), f"{a.out}/pass_at_k", "overwrite")
    jsonl.write_text(spark, f"{a.out}/report.md", scores.report(statistics, scores.task_ranking(counted), scores.verdicts(long)))


def _compared(details: DataFrame, out: str) -> None:
    jsonl.write_jsonl(details, f"{out}/details", "overwrite")
    jsonl.write_summary(similarity.summary(details), f"{out}/summary.json")


def compare_dialogues(spark: SparkSession, a: argparse.Namespace) -> None:
    def answers(paths: list[str], name: str) -> DataFrame:
        rows = _records(spark, paths).select("dialogue_id", "file", "line_no", turns.final_assistant(F.col("turns")).alias(name))
        return records.last_wins(rows, "dialogue_id", ["file", "line_no"])

    matched = similarity.match_outcomes(answers(a.test, "actual"), answers(a.master, "expected"))
    _compared(similarity.compare(matched.filter("outcome = 'compared'"), "expected", "actual", a.method), a.out)
    skipped = matched.filter("outcome <> 'compared'").orderBy("file", "line_no")
    jsonl.write_jsonl(skipped.select("dialogue_id", "outcome"), f"{a.out}/skipped", "overwrite")


def rewrap(spark: SparkSession, a: argparse.Namespace) -> None:
    """Records of the inputs with their turns replaced by the messages of ``--simple``, rewrapped; other fields stay."""
    container = requests.message_container(F.col("raw"))
    flat = jsonl.validated(_lines(spark, a.simple)).select(F.get_json_object("raw", "$.dialogue_id").alias("dialogue_id"), F.posexplode(container).alias("msg_index", "m"))
    simple = turns.wrapped(flat.select("dialogue_id", F.col("msg_index").cast("bigint").alias("msg_id"), "msg_index", "m.role", "m.content", "m.code_snippet"))
    detailed = jsonl.validated(_lines(spark, a.inputs)).withColumn("dialogue_id", F.get_json_object("raw", "$.dialogue_id"))
    made = turns.replace_turns(detailed, simple)
    _write(made.withColumn("raw", records.with_json_field(F.col("raw"), "turns", F.to_json("turns"), parse=True)).orderBy("file", "line_no"), a)


def extract_code(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = jsonl.validated(jsonl.scan_records(spark, [f"{x.rstrip('/')}/*.jsonl" for x in a.inputs]))
    jsonl.write_same_names(lines.withColumn("raw", requests.split_records(F.col("raw"))).filter("raw is not null"), a.out)


def prep_batch(spark: SparkSession, a: argparse.Namespace) -> None:
    prompts = _lines(spark, a.inputs).filter(F.trim("raw") != "").select("file", "line_no", F.col("raw").alias("prompt"))
    jsonl.write_jsonl(requests.batch_requests(prompts, ["file", "line_no"], a.model, a.header, a.copies, a.limit, a.max_tokens), a.out)


def compare_to_ground_truth(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _records(spark, a.inputs).select("dialogue_id", "file", "line_no", turns.final_assistant(F.col("turns")).alias("actual"), turns.expected_text(F.col("final_ground_truth")).alias("expected"))
    _compared(similarity.compare(records.last_wins(rows, "dialogue_id", ["file", "line_no"]), "expected", "actual", a.method), a.out)


def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = _lines(spark, a.inputs).filter(F.trim("raw") != "")
    key = ["file", "line_no"]
    chosen = records.sample_exact(lines, a.count, key, a.seed) if a.count is not None else records.sample_percent(lines, a.percent, key, a.seed)
    jsonl.write_lines(chosen.filter(json_valid(F.col("raw"))) if a.validate_json else chosen, a.out)


def combine(spark: SparkSession, a: argparse.Namespace) -> None:
    kept = jsonl.validated(_lines(spark, a.inputs), on_bad="skip" if a.skip_invalid else "error")
    jsonl.write_lines(kept.orderBy("file", "line_no"), a.out)


def add_id(spark: SparkSession, a: argparse.Namespace) -> None:
    lines = records.add_ids(_lines(spark, a.inputs), a.prefix, name="_id")
    marked = F.when(F.trim("raw") == "", F.col("raw")).otherwise(records.with_json_field(F.col("raw"), a.json_path, F.col("_id")))
    jsonl.write_lines(lines.withColumn("raw", marked).orderBy("file", "line_no"), a.out)


def match_id(spark: SparkSession, a: argparse.Namespace) -> None:
    inputs = jsonl.validated(_lines(spark, [a.inputs[0]])).select((F.col("line_no") - 1).alias("line_index"), F.col("raw").alias("input"))
    outputs = jsonl.validated(_lines(spark, [a.inputs[1]])).select(F.get_json_object("raw", "$.custom_id").alias("custom_id"), F.col("line_no").alias("out_order"), F.col("raw").alias("output"))
    paired = records.pair_by_index(inputs, outputs, a.prefix)
    jsonl.write_jsonl(paired.select("line_index", "custom_id", "input", "output", records.envelope_text(F.col("output")).alias("response_text")), a.out)


def separate(spark: SparkSession, a: argparse.Namespace) -> None:
    code = F.coalesce(tasks.loose_task_code(F.col("metadata.primary_task")), F.lit(scores.UNKNOWN))
    _records(spark, a.inputs).select(code.alias("task"), F.col("raw").alias("value")).write.partitionBy("task").text(a.out)


def process_data(spark: SparkSession, a: argparse.Namespace) -> None:
    jsonl.write_lines(records.open_envelopes(jsonl.validated(_lines(spark, a.inputs))), a.out, "payload")


def convert_csv(spark: SparkSession, a: argparse.Namespace) -> None:
    jsonl.write_jsonl(jsonl.read_csv(spark, a.inputs), a.out)


def run_code(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = jsonl.validated(_lines(spark, a.inputs)).select(records.get_path(F.col("raw"), a.id_path).alias(a.id_path.rsplit(".", 1)[-1]), records.get_path(F.col("raw"), a.code_path).alias("code"), records.get_path(F.col("raw"), a.test_path).alias("tests"), F.lit(None).cast("string").alias("expected"))
    jsonl.write_jsonl(codeeval.evaluate(rows, a.timeout).drop("code"), a.out)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="dialogforge", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(function: object, *options: tuple[list[str], dict], inputs: bool = True, out: bool = True) -> None:
        p = commands.add_parser(function.__name__.replace("_", "-"))
        if inputs:
            p.add_argument("inputs", nargs="+")
        p.add_argument("--out", "-o", required=out)
        for names, kind in options:
            p.add_argument(*names, **kind)
        p.set_defaults(run=function)

    method = (["--method"], {"choices": sorted(similarity.METHODS), "default": "difflib"})
    flag = lambda name: ([name], {"action": "store_true"})
    command(check_duplicates, (["--threshold"], {"type": float, "default": dedup.THRESHOLD}), (["--field"], {"default": "duplicate_flag"}), flag("--inplace"), out=False)
    command(remove_duplicates, (["--field"], {"default": "duplicate_flag"}), flag("--inplace"), out=False)
    command(analyze_scores, (["--task-key"], {"default": "metadata.primary_task"}), (["--pass-at-k"], {"default": "1"}), flag("--no-zero-failed-code-scores"))
    command(compare_dialogues, (["--master"], {"nargs": "+", "required": True}), (["--test"], {"nargs": "+", "required": True}), method, inputs=False)
    command(compare_to_ground_truth, method)
    command(rewrap, (["--simple"], {"nargs": "+", "required": True}), flag("--inplace"), out=False)
    command(extract_code)
    command(prep_batch, (["--model"], {"required": True}), (["--header"], {"default": ""}), (["--copies"], {"type": int, "default": 1}), (["--limit"], {"type": int}), (["--max-tokens"], {"type": int, "default": requests.MAX_TOKENS}))
    command(sample, (["--int"], {"type": int, "dest": "count"}), (["--percent"], {"type": float, "default": 10.0}), (["--seed"], {"type": int, "default": 0}), flag("--validate-json"))
    command(combine, flag("--skip-invalid"))
    command(add_id, (["--json-path"], {"default": "id"}), (["--prefix"], {"default": ""}))
    command(match_id, (["--prefix", "-p"], {"default": "id_0"}))
    command(separate)
    command(process_data)
    command(convert_csv)
    command(run_code, (["--code-path"], {"required": True}), (["--test-path"], {"required": True}), (["--id-path"], {"required": True}), (["--timeout"], {"type": float, "default": 2.0}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = _parser().parse_args(argv)
    session = spark or SparkSession.builder.appName("dialogforge").getOrCreate()
    ship(session)
    try:
        a.run(session, a)
    finally:
        clear_cuts(session)


if __name__ == "__main__":
    main()
