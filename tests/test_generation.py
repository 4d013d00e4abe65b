from dialogforge.operators.judging import EchoClient
from dialogforge.streaming import generation

M = "dialogue_id string, msg_id bigint, msg_index int, role string, content string, code_snippet string, contains_code boolean"
ROWS = [("d", 1, 0, "user", "q1", None, None), ("d", 2, 1, "assistant", "a", None, None), ("d", 3, 2, "user", "q2", None, None), ("e", 4, 0, "user", "only", None, None)]


class Failing:
    def complete(self, system, prompt):
        if prompt.startswith("q1"):
            raise KeyError("no")
        return "fine"


def test_rounds(spark):
    df = spark.createDataFrame(ROWS, M)
    got = {(r.dialogue_id, r.turn_index): (r.state, r.reply[:19]) for r in generation.generate(df, EchoClient).collect()}
    assert got == {("d", 0): ("WAITING", "Mock output for: q1"), ("d", 1): ("DONE", "Mock output for: q2"), ("e", 0): ("DONE", "Mock output for: on")}
    assert generation.mock_generation(df).count() == 3


def test_an_error_ends_its_dialogue(spark):
    got = {(r.dialogue_id, r.turn_index): r.state for r in generation.generate(spark.createDataFrame(ROWS, M), Failing).collect()}
    assert got == {("d", 0): "ERROR", ("e", 0): "DONE"}
    assert generation.generate(spark.createDataFrame([], M), EchoClient).count() == 0


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame(ROWS, M).coalesce(1).write.parquet(str(source))
    generation.follow_table(spark, str(source), str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.dialogue_id: (r.user_turns, r.answers, r.state) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"d": (2, 1, "PROCESSING"), "e": (1, 0, "PROCESSING")}


def test_a_message_that_comes_again_in_a_later_batch_counts_once(spark, tmp_path):
    schema = "dialogue_id string, msg_id bigint, role string"
    source, out, marks = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "marks")
    for rows in ([("d", 1, "user"), ("d", 2, "user"), ("d", 3, "assistant")], [("d", 3, "assistant"), ("d", 1, "user")], [("d", 4, "assistant"), ("d", None, "user")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        generation.follow_table(spark, source, out, marks)
    got = [(r.user_turns, r.answers, r.state) for r in spark.read.parquet(out).orderBy("batch").collect()]
    assert got == [(2, 1, "PROCESSING"), (2, 1, "PROCESSING"), (2, 2, "DONE")]
