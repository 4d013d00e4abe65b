from pyspark.sql import functions as F

from dialogforge.operators import turns

M = "dialogue_id string, msg_id bigint, msg_index int, role string, content string, code_snippet string, contains_code boolean"


def messages(spark, rows):
    return spark.createDataFrame(rows, M)


ROWS = [
    ("d", 1, 0, "system", "s", None, None),
    ("d", 2, 1, "User", "q1", "x", True),
    ("d", 2, 1, "User", "q1", "x", True),  # delivered twice
    ("d", 3, 2, "model", "a1", None, None),
    ("d", 4, 3, "human", "q2", None, False),
    ("e", 5, 0, "user", None, None, None),
    (None, 6, 0, "user", "lost", None, None),
]


def test_rewrap(spark):
    got = {r.msg_id: (r.role, r.turn_group) for r in turns.rewrap(messages(spark, ROWS)).collect()}
    assert got == {1: ("system", 1), 2: ("user", 2), 3: ("assistant", 2), 4: ("user", 3), 5: ("user", 1)}


def test_rewrap_empty(spark):
    assert turns.rewrap(messages(spark, [])).collect() == []


def test_prefixes(spark):
    got = {r.msg_id: (r.prior_messages, r.prior_users, r.prior_chars) for r in turns.prefixes(messages(spark, ROWS)).collect()}
    assert got[4] == (3, 1, 5) and got[1] == (0, 0, 0)


def test_requests(spark):
    got = {r.msg_id: r for r in turns.requests(messages(spark, ROWS)).collect()}
    assert got[2].prompt == "q1\nx" and not got[2].is_final and got[2].turn_index == 0
    assert got[4].is_final and got[4].prompt.endswith(turns.FINAL_PROMPT)
    assert got[5].prompt == "\n" + turns.FINAL_PROMPT


def test_request_body(spark):
    history = F.from_json(F.lit('[{"role":"user","content":"p"}]'), "array<struct<role:string,content:string>>")
    body = lambda dup: spark.range(1).select(turns.request_body("sys", history, F.lit("p"), dup).alias("b")).first().b
    assert [m.role for m in body(False)] == ["system", "user"]
    assert [m.role for m in body(True)] == ["system", "user", "user"]


def test_nested(spark):
    t = "array<struct<turn_id:bigint,messages:array<struct<role:string,content:string,code_snippet:string>>>>"
    user, answer = {"role": "user", "content": "Q!", "code_snippet": "c"}, {"role": "assistant", "content": "A", "code_snippet": None}
    rows = [
        (1, [{"turn_id": 1, "messages": [user, answer]}]),
        (2, []),
        (3, None),
        (4, [None]),
        (5, [{"turn_id": 1, "messages": []}]),
        (6, [{"turn_id": 1, "messages": [answer]}, {"turn_id": 2, "messages": [user]}]),
    ]
    df = spark.createDataFrame(rows, f"i int, turns {t}")
    got = {r.i: (r.a, r.c, r.k) for r in df.select("i", turns.final_assistant(F.col("turns")).alias("a"), turns.final_code(F.col("turns")).alias("c"), turns.opening_key(F.col("turns")).alias("k")).collect()}
    assert got[1] == ("A", None, "q  c")
    assert got[2] == got[3] == got[4] == got[5] == (None, None, "")
    assert got[6] == (None, "c", "a")


def test_records_take_the_turns_of_the_flat_export(spark):
    rows = [("d", 3, 2, "human", "q2", None), ("d", 1, 0, "user", "q1", "x = 1"), ("d", 2, 1, "model", "a1", None), ("d", 2, 1, "model", "a1", None), ("e", 4, 0, "user", None, None), (None, 5, 0, "user", "z", None)]
    flat = spark.createDataFrame(rows, "dialogue_id string, msg_id bigint, msg_index int, role string, content string, code_snippet string")
    detailed = spark.createDataFrame([(1, "d", "old"), (2, "d", "old"), (3, "f", "old")], "record_id int, dialogue_id string, turns string")
    got = {r.record_id: [(t.turn_id, [(m.role, m.content, m.code_snippet) for m in t.messages]) for t in r.turns] for r in turns.replace_turns(detailed, turns.wrapped(flat)).collect()}
    whole = [(1, [("user", "q1", "x = 1"), ("assistant", "a1", None)]), (2, [("user", "q2", None)])]
    assert got == {1: whole, 2: whole}
