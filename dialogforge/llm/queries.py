"""Queries of the operators for training text, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogforge.llm import leaks, mixing, neardup, pairs, source_files, stuffing
from dialogforge.session import cut, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.find_defects(table(spark, sf_dir, "messages"))


def p1_defect_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of turns by defect."""
    return p1_found(spark, sf_dir).groupBy("defect").agg(F.count("*").alias("turns"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files.invalid_files(table(spark, sf_dir, "messages")).select("msg_id")


def p3_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every error of every invalid snippet with its place, and the snippet's first cause."""
    found = source_files.invalid_files(table(spark, sf_dir, "messages"))
    return found.select("msg_id", "language", "cause", F.inline("errors"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files.invalid_rates(table(spark, sf_dir, "messages"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = cut(neardup.group(neardup.openings(table(spark, sf_dir, "messages"))), "openings")
    return neardup.pairs_within(grouped)


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per opening: its group and its number of links."""
    grouped = neardup.group_links(neardup.openings(table(spark, sf_dir, "messages")))
    return grouped.select(F.col("id").alias("msg_id"), F.col("group").alias("group_id"), "links")


def p6_edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item with a passage in common, with the least number of edited words in one of its windows."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def _unedited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_edited(spark, sf_dir).filter("distance = 0")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unedited(spark, sf_dir).select("doc_id", "item_id")


def p6_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(_unedited(spark, sf_dir), table(spark, sf_dir, "eval_items"))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffing.find_stuffed(table(spark, sf_dir, "documents")).select("doc_id")


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cases with their list density, share of replicated phrases and score."""
    return stuffing.find_stuffed(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_defect_counts, p3_found, p3_errors, p3_rates, p5_found, p5_groups, p6_found, p6_edited, p6_leaked_items, p7_mix, p7_shares, p8_found, p8_scores)}


_RUNS = r"""
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL),
v AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 19], ' ') AS g FROM w, unnest(generate_series(1, len(w) - 19)) AS u(i)),
h AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 19], ' ') AS g FROM v, unnest(generate_series(1, len(w) - 19)) AS u(i)),
leaks AS (SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (g))
"""


_OPENINGS = r"""
o AS (SELECT arg_min({'id': msg_id, 'text': concat_ws(' ', content, code_snippet)}, (coalesce(turn_id, 2147483647), coalesce(msg_index, 2147483647), msg_id)) AS o FROM messages WHERE role IN ('user', 'User', 'human') AND dialogue_id IS NOT NULL AND msg_id IS NOT NULL GROUP BY dialogue_id),
t AS (SELECT DISTINCT o.id AS id, list_sort(regexp_extract_all(lower(o.text), '[\p{L}\p{N}_]+')) AS w FROM o),
u AS (SELECT id, md5(array_to_string(w, ' ')) AS fp, len(w) AS n, w FROM t WHERE len(w) > 0),
c AS (SELECT id, x AS w, count(*) AS n FROM (SELECT id, unnest(w) AS x FROM u) GROUP BY ALL),
s AS (SELECT a.id AS a, b.id AS b, sum(least(a.n, b.n)) AS overlap FROM c a JOIN c b ON a.w = b.w AND a.id <> b.id GROUP BY ALL),
e AS (SELECT s.a AS a, s.b AS b FROM s JOIN u x ON x.id = s.a JOIN u y ON y.id = s.b WHERE s.overlap * 5 >= greatest(x.n, y.n) * 4),
r(id, m) AS (SELECT id, id FROM u UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id),
g AS (SELECT id, min(m) AS group_id FROM r GROUP BY id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": f"WITH RECURSIVE {_OPENINGS} SELECT a.id AS msg_id_a, b.id AS msg_id_b FROM g a JOIN g b ON a.group_id = b.group_id AND a.id < b.id",
        "p5_groups": f"""
WITH RECURSIVE {_OPENINGS},
k AS (SELECT e.a AS id, count(DISTINCT y.fp) AS links FROM e JOIN u x ON x.id = e.a JOIN u y ON y.id = e.b WHERE x.fp <> y.fp GROUP BY e.a)
SELECT g.id AS msg_id, group_id, coalesce(links, 0) AS links FROM g LEFT JOIN k ON k.id = g.id
""",
        "p6_found": f"WITH {_RUNS} SELECT doc_id, item_id FROM leaks",
        "p6_leaked_items": f"""
WITH {_RUNS},
p AS (SELECT doc_id, array_to_string(w[i:i + 19], ' ') AS g FROM w, unnest(generate_series(1, len(w) - 19)) AS u(i)),
n AS (SELECT doc_id, item_id, count(*) AS runs FROM p JOIN h USING (g) GROUP BY ALL),
k AS (SELECT item_id, count(*) AS documents, max(runs) AS most_runs FROM n GROUP BY item_id)
SELECT item_id, suite, coalesce(documents, 0) AS documents, coalesce(most_runs, 0) AS most_runs FROM (SELECT DISTINCT item_id, suite FROM eval_items WHERE item_id IS NOT NULL) LEFT JOIN k USING (item_id)
""",
    }
