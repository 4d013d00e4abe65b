import pytest

from dialogforge.operators import nested

SCHEMA = (
    "record_id bigint, metadata struct<topics:array<string>>, "
    "turns array<struct<turn_id:bigint,messages:array<struct<role:string,content:string>>>>, "
    "final_ground_truth struct<constraints_to_check:array<string>>, "
    "scores map<string,array<struct<score:double,strengths:array<string>,weaknesses:array<string>>>>, pre string"
)
M = {"role": "user", "content": "x"}
ROWS = [
    (1, {"topics": ["a", None, "b"]}, [{"turn_id": 7, "messages": [M, None, M]}, None, {"turn_id": None, "messages": None}], {"constraints_to_check": ["c"]}, {"j.x": [None, {"score": 1.0, "strengths": ["s", None], "weaknesses": None}], "k": []}, "clash"),
    (2, None, None, None, None, None),
    (3, {"topics": None}, [], {"constraints_to_check": []}, {}, "x"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_children_count_nulls_as_positions(rows):
    got = {(r.record_id, r.child, r.child_path) for r in nested.children(rows).collect()}
    assert got == {
        (1, "turn", "turns[0]"), (1, "message", "turns[0].messages[0]"), (1, "message", "turns[0].messages[2]"), (1, "turn", "turns[2]"),
        (1, "topic", "metadata.topics[0]"), (1, "topic", "metadata.topics[2]"), (1, "constraint", "final_ground_truth.constraints_to_check[0]"),
        (1, "score", "scores.j.x[1]"), (1, "strength", "scores.j.x[1].strengths[0]"),
    }


def test_intervals_nest_as_the_paths_do(rows):
    nodes = [r for r in nested.label(rows).collect() if r.record_id == 1]
    assert sorted(n.pre for n in nodes) == sorted(n.post for n in nodes) == list(range(len(nodes)))
    for a in nodes:
        for b in nodes:
            inside = a.pre < b.pre and a.post > b.post
            below = a is not b and (a.kind == "record" or b.path.startswith(a.path + "."))
            assert inside == below, (a.path, b.path)


def test_tables_and_links(rows):
    messages, turns = nested.node_table(rows, "message"), nested.node_table(rows, "turn")
    linked = nested.link(turns, messages).collect()
    assert sorted((r.pos_1, r.pos_2, r.role) for r in linked) == [(0, 0, "user"), (0, 2, "user")]
    assert {r.turn_id for r in turns.collect()} == {7, None}
    score = nested.node_table(rows, "score").first()
    assert (score.score_key, score.pos_1, score.score) == ("j.x", 1, 1.0)
    assert nested.node_table(rows, "strength").first().strength == "s"
    assert [r.topic for r in nested.node_table(rows, "topic").orderBy("pos_1").collect()] == ["a", "b"]
    assert nested.node_table(rows, "record").count() == 3


def test_empty(spark, rows):
    assert nested.children(rows.limit(0)).count() == 0
    for kind in nested.CHILDREN:
        assert nested.node_table(rows.limit(0), kind).count() == 0
