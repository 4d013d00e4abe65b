import json

import pytest
from pyspark.sql import functions as F

from dialogforge.operators import drift

SCHEMA = "feed string, file_name string, file_seq int, line_no int, raw string, rescued string"


def lines(spark, files):
    rows = []
    for seq, records in enumerate(files, 1):
        for n, r in enumerate(records, 1):
            rows.append(("f", f"f/{seq}", seq, n, r if r is None or isinstance(r, str) else json.dumps(r), "clash"))
    return spark.createDataFrame(rows, SCHEMA)


def changes(spark, *files):
    return {(r.file_name, r.change_kind, r.old_field, r.new_field) for r in drift.layout_changes(lines(spark, files)).collect()}


def record(k, **more):
    return {"dialogue_id": f"d{k}", "metadata": {"lang": f"l{k}", "tier": k}, "messages": [{"role": "user", "content": f"c{k}"}, {"role": "assistant", "content": f"a{k}"}]} | more


def test_added_removed_and_bad_lines(spark):
    a = [record(1), "", "{bad", None, "[1]"]
    b = [record(1, extra=5), record(1, extra=5)]
    c = [{k: v for k, v in record(2).items() if k != "metadata"}]
    assert changes(spark, a, b, c) == {("f/2", "added", "", "extra"), ("f/3", "removed", "extra", ""), ("f/3", "removed", "metadata", "")}


def test_container_renamed_with_a_change_within(spark):
    a = [record(k) for k in range(3)]
    b = []
    for k in range(3):
        r = record(k)
        r["conversation"] = [{"role": m["role"], "text": m["content"], "n": 1} for m in r.pop("messages")]
        b.append(r)
    assert changes(spark, a, b) == {("f/2", "renamed", "messages", "conversation"), ("f/2", "renamed", "messages[].content", "conversation[].text"), ("f/2", "added", "", "conversation[].n")}


def test_rename_needs_equal_values_of_records_in_both(spark):
    a = [record(k, old=f"v{k}", other=f"x{k}") for k in range(4)]
    b = [record(k, new=f"v{k}", different=f"y{k}") for k in range(2, 6)]
    assert changes(spark, a, b) == {("f/2", "renamed", "old", "new"), ("f/2", "removed", "other", ""), ("f/2", "added", "", "different")}


def test_types_against_the_last_known(spark):
    def with_tier(value):
        r = record(1)
        r["metadata"]["tier"] = value
        return [r]

    got = changes(spark, with_tier(1), with_tier(None), with_tier("1"), with_tier("2"), with_tier({"a": 1}))
    assert got == {("f/3", "type_changed", "metadata.tier", "metadata.tier"), ("f/5", "type_changed", "metadata.tier", "metadata.tier")}


def test_retyped_container_says_nothing_of_its_fields(spark):
    a, b = record(1), record(1)
    b["metadata"] = [b["metadata"] | {"new": 1}]
    assert changes(spark, [a], [b]) == {("f/2", "type_changed", "metadata", "metadata")}


def test_feeds_are_apart_and_empty_tables_have_no_changes(spark):
    df = lines(spark, [[record(1)]])
    assert drift.layout_changes(df).count() == 0
    assert drift.layout_changes(df.limit(0)).count() == 0


def test_ingest_promote(spark):
    raw = [
        {"dialogue_id": "d", "meta": {"lang": "py", "complexity_score": "7", "topics": ["a"], "budget": "12"}, "conversation": [{"role": "user", "content": [{"t": 1}], "ground_truth_valid": 1}, 5]},
        "{bad",
        None,
        {"dialogue_id": 9},
    ]
    rows = drift.promote(drift.ingest(lines(spark, [raw])), "meta.budget", "bigint", "budget").orderBy("line_no").collect()
    first = rows[0]
    assert first.dialogue_id == "d" and first.metadata.language == "py" and first.metadata.complexity_score == 7 and first.budget == 12
    assert first.messages[0].content is None and first.messages[0].ground_truth_valid is True and first.messages[1] is None
    assert json.loads(first.rescued) == {"meta": {"budget": "12"}, "conversation": [{"content": [{"t": 1}]}, 5]}
    assert [r.parse_error for r in rows] == [False, True, True, False]
    assert json.loads(rows[3].rescued) == {"dialogue_id": 9} and rows[3].dialogue_id is None


@pytest.mark.parametrize(("value", "kind", "want"), [("7", "bigint", (7, True)), (7.5, "bigint", (None, False)), (True, "bigint", (None, False)), ("yes", "boolean", (None, False)), (None, "string", (None, True)), (3, "string", (None, False))])
def test_casts_lose_nothing(value, kind, want):
    assert drift.cast_json(value, kind) == want


def test_replay_fills_from_rescued_values(spark):
    raw = [
        {"dialogue_id": "d", "metadata": {"primary_task": {"code": "ISR"}, "topics": "one", "tier": {"a": "x", "b": "y"}}, "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}], "code_snippet": {"value": "c"}}, {"speaker": "assistant"}]},
        {"dialogue_id": "e"},
        "{bad",
    ]
    rows = drift.replay(drift.ingest(lines(spark, [raw])), {"messages[].role": ["speaker"]}).orderBy("line_no").collect()
    first = rows[0]
    assert first.metadata.primary_task == "ISR" and first.metadata.topics == ["one"] and first.metadata.tier is None
    assert first.messages[0].content == "ab" and first.messages[0].code_snippet == "c"
    assert json.loads(first.rescued)["metadata"] == {"tier": {"a": "x", "b": "y"}}
    assert (rows[1].metadata, rows[1].rescued) == (None, None) and rows[2].parse_error and rows[2].rescued == "{bad"


def test_a_container_within_a_string_is_read(spark):
    raw = [{"dialogue_id": "d", "metadata": json.dumps({"tier": "t", "more": 1}), "messages": json.dumps([{"role": "user", "content": "c"}])}, {"dialogue_id": "e", "metadata": "no json"}]
    first, second = drift.ingest(lines(spark, [raw])).orderBy("line_no").collect()
    assert first.metadata.tier == "t" and first.messages[0].content == "c" and json.loads(first.rescued) == {"metadata": {"more": 1}}
    assert second.metadata is None and json.loads(second.rescued) == {"metadata": "no json"}


def test_aliases_follow_renames(spark):
    pairs = [("metadata.language", "metadata.code_language"), ("metadata.code_language", "info.idiom"), ("messages[].content", "messages[].text"), ("metadata", "info"), ("other", "else")]
    df = spark.createDataFrame([("f", "renamed", a, b) for a, b in pairs] + [("f", "added", "", "x")], "file_name string, change_kind string, old_field string, new_field string")
    got = {(r.level, r.field, r.target) for r in drift.aliases_of(df).collect()}
    assert got == {("object", "code_language", "metadata.language"), ("object", "idiom", "metadata.language"), ("array", "text", "messages[].content"), ("", "info", "metadata")}
    assert drift.aliases_of(df.limit(0)).count() == 0


def test_aliases_are_those_that_a_file_uses(spark):
    df = lines(spark, [[{"dialogue_id": "a", "info": {"idiom": "py"}}], [{"dialogue_id": "b", "metadata": {"language": "go"}}]])
    aliases = spark.createDataFrame([("", "info", "metadata"), ("object", "idiom", "metadata.language"), ("object", "other", "metadata.language")], "level string, field string, target string")
    named = drift.with_aliases(df, aliases, drift.field_inventory(drift.layouts(df)))
    rows = {r.dialogue_id: r for r in drift.ingest(named, F.col("aliases")).collect()}
    assert json.loads(rows["a"].aliases) == {"metadata": ["info"], "metadata.language": ["idiom"]} and rows["b"].aliases is None
    assert {k: r.metadata.language for k, r in rows.items()} == {"a": "py", "b": "go"}


def test_inventory_says_what_was_kept_and_rescued(spark):
    df = lines(spark, [[record(1, extra=5), record("x", extra=None), "{bad"], [record(1) | {"metadata": {"tier": "a"}}]])
    got = {(r.file_name, r.container, r.field, r.kind, r.jtype): (r.n, r.rescued) for r in drift.field_inventory(drift.layouts(df)).collect()}
    assert got["f/1", "", "extra", "", "number"] == (1, 1) and got["f/1", "", "extra", "", None] == (1, 1)
    assert got["f/1", "metadata", "tier", "object", "number"] == (1, 1) and got["f/2", "metadata", "tier", "object", "string"] == (1, 0)
    assert got["f/1", "messages", "content", "array", "string"] == (2, 0) and got["f/1", "", "metadata", "", "object"] == (2, 1)
    # The rows of the report come from the ingestion: fields are what was kept and what was rescued.
    kept = {f"{c}.{f}" for (file, c, f, k, t), (n, r) in got.items() if file == "f/1" and n > r}
    assert kept >= {"messages.content", "messages.role", ".dialogue_id"}
