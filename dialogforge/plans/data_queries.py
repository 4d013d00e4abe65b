"""Queries of the core operators for training data: layout changes and nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogforge.operators import drift, nested, records
from dialogforge.session import table


#: Labels need to know which elements are null, not what they say; node tables read the fields they show besides.
_MESSAGES = nested.LABEL_SCHEMA.replace("turns array<struct<messages:array<struct<ground_truth_valid:boolean>>>>", "turns array<struct<turn_id:bigint,messages:array<struct<role:string,content:string,code_snippet:string>>>>")
_SCORES = nested.LABEL_SCHEMA.replace("array<struct<strengths:", "array<struct<index:int,score:double,verdict:string,passed:boolean,strengths:")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.layout_changes(table(spark, sf_dir, "raw_records"))


def p2_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines in the target schema; two approved fields are promoted from the rescued JSON to typed columns."""
    rows = drift.ingest(table(spark, sf_dir, "raw_records"))
    rows = drift.promote(rows, "metadata.batch_label", "string", "batch_label")
    return drift.promote(rows, "metadata.word_budget", "bigint", "word_budget")


def p2_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the target schema kept and rescued of each file: records with each field and JSON type, and how many were rescued."""
    found = drift.field_inventory(drift.layouts(table(spark, sf_dir, "raw_records"))).filter("container is not null")
    return found.select("file_name", "container", "field", "jtype", F.col("n").alias("records"), "rescued")


def p2_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One consistent table of all dialogues: names as the renames show them, rescued values replayed, the last record of each."""
    lines = table(spark, sf_dir, "raw_records")
    aliases = drift.aliases_of(drift.layout_changes(lines))
    named = drift.with_aliases(lines, aliases, drift.field_inventory(drift.layouts(lines)))
    rows = drift.replay(drift.ingest(named, F.col("aliases")), F.col("aliases")).filter("not parse_error")
    return records.last_wins(rows, "dialogue_id", ["file_seq", "file_name", "line_no"]).select("dialogue_id", "feed", "file_name", "metadata", "messages", "rescued")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.children(table(spark, sf_dir, "dialogues", nested.LABEL_SCHEMA))


def p4_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval labels of every node."""
    return nested.label(table(spark, sf_dir, "dialogues", nested.LABEL_SCHEMA)).select("record_id", "pre", "post", "depth", "kind", "path")


def p4_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat message table, each row linked to its turn by interval containment."""
    rows = table(spark, sf_dir, "dialogues", _MESSAGES)
    linked = nested.link(nested.node_table(rows, "turn"), nested.node_table(rows, "message"))
    return linked.select("record_id", "parent_pre", "pre", "post", "pos_1", "pos_2", "role", "content", "code_snippet")


def p4_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat score table, each row linked to its record by interval containment."""
    rows = table(spark, sf_dir, "dialogues", _SCORES)
    scores = nested.link(nested.node_table(rows, "record"), nested.node_table(rows, "score"))
    return scores.select("record_id", "parent_pre", "pre", "post", "score_key", "pos_1", F.col("index").alias("sample_index"), "score", "verdict", "passed")


def p4_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat turn table, linked to the record."""
    rows = table(spark, sf_dir, "dialogues", _MESSAGES)
    return nested.link(nested.node_table(rows, "record"), nested.node_table(rows, "turn")).select("record_id", "parent_pre", "pre", "post", "pos_1", F.col("turn_id").cast("bigint").alias("turn_id"))


def p4_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "dialogues", nested.LABEL_SCHEMA)
    return nested.link(nested.node_table(rows, "record"), nested.node_table(rows, "topic")).select("record_id", "parent_pre", "pre", "post", "pos_1", "topic")


def p4_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "dialogues", nested.LABEL_SCHEMA)
    return nested.link(nested.node_table(rows, "record"), nested.node_table(rows, "constraint")).select("record_id", "parent_pre", "pre", "post", "pos_1", "constraint_text")


def p4_remarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths and weaknesses, each row linked to its score by interval containment."""
    rows = table(spark, sf_dir, "dialogues", _SCORES)
    both = [nested.node_table(rows, kind).withColumnRenamed(kind, "remark").withColumn("kind", F.lit(kind)) for kind in ("strength", "weakness")]
    linked = nested.link(nested.node_table(rows, "score"), both[0].unionByName(both[1]))
    return linked.select("record_id", "parent_pre", "pre", "post", "kind", "score_key", "pos_1", "pos_2", "remark")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_found, p2_fields, p2_table, p2_dialogues, p4_found, p4_labels, p4_messages, p4_scores, p4_turns, p4_topics, p4_constraints, p4_remarks)}


_UNNESTED = """
turn AS (SELECT record_id, i - 1 AS i, turns[i] AS t FROM dialogues, unnest(generate_series(1, len(turns))) AS u(i) WHERE turns[i] IS NOT NULL),
message AS (SELECT record_id, i, j - 1 AS j, t.messages[j] AS m FROM turn, unnest(generate_series(1, len(t.messages))) AS u(j) WHERE t.messages[j] IS NOT NULL),
entry AS (SELECT record_id, e.key AS k, e.value AS v FROM (SELECT record_id, unnest(map_entries(scores)) AS e FROM dialogues)),
score AS (SELECT record_id, k, i - 1 AS i, v[i] AS s FROM entry, unnest(generate_series(1, len(v))) AS u(i) WHERE v[i] IS NOT NULL)
"""


_NODES = f"""
{_UNNESTED},
entries AS (SELECT record_id, generate_subscripts(map_keys(scores), 1) AS e, unnest(map_keys(scores)) AS k FROM dialogues),
nodes AS (
SELECT record_id, 'record' AS kind, 0 AS depth, 0 AS a, 0 AS b, 0 AS c, 0 AS d, 0 AS f, '' AS path FROM dialogues
UNION ALL SELECT record_id, 'turn', 1, 1, i, -1, 0, 0, 'turns[' || i || ']' FROM turn
UNION ALL SELECT record_id, 'message', 2, 1, i, j, 0, 0, 'turns[' || i || '].messages[' || j || ']' FROM message
UNION ALL SELECT record_id, 'topic', 1, 2, i, 0, 0, 0, 'metadata.topics[' || (i - 1) || ']' FROM dialogues, unnest(generate_series(1, len(metadata.topics))) AS u(i) WHERE metadata.topics[i] IS NOT NULL
UNION ALL SELECT record_id, 'constraint', 1, 3, i, 0, 0, 0, 'final_ground_truth.constraints_to_check[' || (i - 1) || ']' FROM dialogues, unnest(generate_series(1, len(final_ground_truth.constraints_to_check))) AS u(i) WHERE final_ground_truth.constraints_to_check[i] IS NOT NULL
UNION ALL SELECT record_id, 'score', 1, 4, e, i, -1, 0, 'scores.' || k || '[' || i || ']' FROM score JOIN entries USING (record_id, k)
UNION ALL SELECT record_id, 'strength', 2, 4, e, i, 0, j, 'scores.' || k || '[' || i || '].strengths[' || (j - 1) || ']' FROM score JOIN entries USING (record_id, k), unnest(generate_series(1, len(s.strengths))) AS u(j) WHERE s.strengths[j] IS NOT NULL
UNION ALL SELECT record_id, 'weakness', 2, 4, e, i, 1, j, 'scores.' || k || '[' || i || '].weaknesses[' || (j - 1) || ']' FROM score JOIN entries USING (record_id, k), unnest(generate_series(1, len(s.weaknesses))) AS u(j) WHERE s.weaknesses[j] IS NOT NULL
),
sized AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY a, b, c, d, f) - 1 AS pre,
CASE kind WHEN 'record' THEN count(*) OVER (PARTITION BY record_id) WHEN 'turn' THEN count(*) OVER (PARTITION BY record_id, a, b) WHEN 'score' THEN count(*) OVER (PARTITION BY record_id, a, b, c) ELSE 1 END AS size FROM nodes),
labels AS (SELECT record_id, CAST(pre AS INTEGER) AS pre, CAST(pre + size - 1 - depth AS INTEGER) AS post, CAST(depth AS INTEGER) AS depth, kind, path, a, b, c FROM sized)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": f"""
WITH {_UNNESTED}
SELECT record_id, 'turn' AS child, 'turns[' || i || ']' AS child_path FROM turn
UNION ALL SELECT record_id, 'message', 'turns[' || i || '].messages[' || j || ']' FROM message
UNION ALL SELECT record_id, 'topic', 'metadata.topics[' || (i - 1) || ']' FROM dialogues, unnest(generate_series(1, len(metadata.topics))) AS u(i) WHERE metadata.topics[i] IS NOT NULL
UNION ALL SELECT record_id, 'constraint', 'final_ground_truth.constraints_to_check[' || (i - 1) || ']' FROM dialogues, unnest(generate_series(1, len(final_ground_truth.constraints_to_check))) AS u(i) WHERE final_ground_truth.constraints_to_check[i] IS NOT NULL
UNION ALL SELECT record_id, 'score', 'scores.' || k || '[' || i || ']' FROM score
UNION ALL SELECT record_id, 'strength', 'scores.' || k || '[' || i || '].strengths[' || (j - 1) || ']' FROM score, unnest(generate_series(1, len(s.strengths))) AS u(j) WHERE s.strengths[j] IS NOT NULL
UNION ALL SELECT record_id, 'weakness', 'scores.' || k || '[' || i || '].weaknesses[' || (j - 1) || ']' FROM score, unnest(generate_series(1, len(s.weaknesses))) AS u(j) WHERE s.weaknesses[j] IS NOT NULL
""",
        "p4_scores": f"""
WITH {_NODES}
SELECT s.record_id AS record_id, 0 AS parent_pre, l.pre AS pre, l.post AS post, s.k AS score_key, CAST(s.i AS INTEGER) AS pos_1, s.s.index AS sample_index, s.s.score AS score, s.s.verdict AS verdict, s.s.passed AS passed
FROM score s JOIN labels l ON l.record_id = s.record_id AND l.kind = 'score' AND l.path = 'scores.' || s.k || '[' || s.i || ']'
""",
        "p4_turns": f"""
WITH {_NODES}
SELECT t.record_id AS record_id, 0 AS parent_pre, l.pre AS pre, l.post AS post, CAST(t.i AS INTEGER) AS pos_1, CAST(t.t.turn_id AS BIGINT) AS turn_id
FROM turn t JOIN labels l ON l.record_id = t.record_id AND l.kind = 'turn' AND l.b = t.i
""",
        "p4_topics": f"""
WITH {_NODES}
SELECT l.record_id AS record_id, 0 AS parent_pre, l.pre AS pre, l.post AS post, CAST(l.b - 1 AS INTEGER) AS pos_1, d.metadata.topics[l.b] AS topic FROM labels l JOIN dialogues d USING (record_id) WHERE l.kind = 'topic'
""",
        "p4_constraints": f"""
WITH {_NODES}
SELECT l.record_id AS record_id, 0 AS parent_pre, l.pre AS pre, l.post AS post, CAST(l.b - 1 AS INTEGER) AS pos_1, d.final_ground_truth.constraints_to_check[l.b] AS constraint_text FROM labels l JOIN dialogues d USING (record_id) WHERE l.kind = 'constraint'
""",
        "p4_remarks": f"""
WITH {_NODES},
remark AS (
SELECT record_id, k, i, 'strength' AS kind, j - 1 AS j, s.strengths[j] AS remark, 'strengths' AS field FROM score, unnest(generate_series(1, len(s.strengths))) AS u(j) WHERE s.strengths[j] IS NOT NULL
UNION ALL SELECT record_id, k, i, 'weakness', j - 1, s.weaknesses[j], 'weaknesses' FROM score, unnest(generate_series(1, len(s.weaknesses))) AS u(j) WHERE s.weaknesses[j] IS NOT NULL)
SELECT r.record_id AS record_id, p.pre AS parent_pre, l.pre AS pre, l.post AS post, r.kind AS kind, r.k AS score_key, CAST(r.i AS INTEGER) AS pos_1, CAST(r.j AS INTEGER) AS pos_2, r.remark AS remark
FROM remark r JOIN labels p ON p.record_id = r.record_id AND p.kind = 'score' AND p.path = 'scores.' || r.k || '[' || r.i || ']'
JOIN labels l ON l.record_id = r.record_id AND l.kind = r.kind AND l.path = 'scores.' || r.k || '[' || r.i || '].' || r.field || '[' || r.j || ']'
""",
        "p4_labels": f"WITH {_NODES} SELECT record_id, pre, post, depth, kind, path FROM labels",
        "p4_messages": f"""
WITH {_NODES}
SELECT m.record_id AS record_id, t.pre AS parent_pre, l.pre AS pre, l.post AS post, CAST(m.i AS INTEGER) AS pos_1, CAST(m.j AS INTEGER) AS pos_2, m.m.role AS role, m.m.content AS content, m.m.code_snippet AS code_snippet
FROM message m JOIN labels l ON l.record_id = m.record_id AND l.kind = 'message' AND l.b = m.i AND l.c = m.j JOIN labels t ON t.record_id = m.record_id AND t.kind = 'turn' AND t.b = m.i
""",
    }
