"""Queries of the data-set operators, each over whole tables, with the same result in SQL where SQL can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogforge.functions import tasks, text
from dialogforge.operators import codeeval, dedup, judging, records, requests, scores, similarity, turns
from dialogforge.session import shared_dir, table
from dialogforge.sources import jsonl
from dialogforge.streaming import generation

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


_ROLE = "CASE lower(trim(role)) WHEN 'human' THEN 'user' WHEN 'model' THEN 'assistant' ELSE lower(trim(role)) END"
_NORM = r"trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+', ' ', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' ')"
_ONCE = f"SELECT DISTINCT dialogue_id, msg_id, msg_index, {_ROLE} AS role FROM messages WHERE dialogue_id IS NOT NULL AND msg_id IS NOT NULL"


#: What the queries read of nested columns: fields within arrays and maps aren't pruned by themselves.
_SPOKEN = "record_id bigint, dialogue_id string, exported_at timestamp, final_ground_truth struct<expected_nl_output:string>, turns array<struct<messages:array<struct<role:string,content:string>>>>"
_OPENED = "record_id bigint, turns array<struct<messages:array<struct<role:string,content:string,code_snippet:string>>>>"
_CODED = "record_id bigint, final_ground_truth struct<expected_output_code:string,test_cases_to_pass:string,constraints_to_check:array<string>>, turns array<struct<messages:array<struct<code_snippet:string>>>>"
_SCORED = "record_id bigint, metadata struct<primary_task:string>, scores map<string,array<struct<score:double,verdict:string,passed:boolean>>>"


# Turns.


@query(f"""
WITH m AS ({_ONCE}),
o AS (SELECT *, CASE WHEN role = 'user' AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS opens FROM m WINDOW w AS (PARTITION BY dialogue_id ORDER BY msg_index, msg_id))
SELECT dialogue_id, msg_id, msg_index, role, CAST(1 + sum(opens) OVER (PARTITION BY dialogue_id ORDER BY msg_index, msg_id) AS BIGINT) AS turn_group FROM o
""")
def rewrap_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.rewrap(table(spark, sf_dir, "messages"))


@query(f"""
WITH m AS ({_ONCE}),
o AS (SELECT *, CASE WHEN role = 'user' AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS opens FROM m WINDOW w AS (PARTITION BY dialogue_id ORDER BY msg_index, msg_id)),
g AS (SELECT *, 1 + sum(opens) OVER (PARTITION BY dialogue_id ORDER BY msg_index, msg_id) AS turn_group FROM o)
SELECT turn_group, count(*) AS messages, count(DISTINCT dialogue_id) AS dialogues FROM (SELECT CAST(turn_group AS BIGINT) AS turn_group, dialogue_id FROM g) GROUP BY turn_group
""")
def turn_group_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.rewrap(table(spark, sf_dir, "messages")).groupBy("turn_group").agg(F.count("*").alias("messages"), F.count_distinct("dialogue_id").alias("dialogues"))


@query(f"""
WITH m AS (SELECT DISTINCT dialogue_id, msg_id, msg_index, {_ROLE} AS role, coalesce(length(content), 0) AS chars FROM messages WHERE dialogue_id IS NOT NULL AND msg_id IS NOT NULL)
SELECT dialogue_id, msg_id, count(*) OVER w AS prior_messages, CAST(coalesce(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS prior_users, CAST(coalesce(sum(chars) OVER w, 0) AS BIGINT) AS prior_chars
FROM m WINDOW w AS (PARTITION BY dialogue_id ORDER BY msg_index, msg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def conversation_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.prefixes(table(spark, sf_dir, "messages"))


_FINAL = turns.FINAL_PROMPT.replace("'", "''")
_ASKED = f"""
WITH u AS (SELECT DISTINCT dialogue_id, msg_id, msg_index, content, code_snippet, contains_code FROM messages WHERE {_ROLE} = 'user' AND dialogue_id IS NOT NULL AND msg_id IS NOT NULL),
a AS (SELECT *, row_number() OVER w - 1 AS turn_index, lead(msg_id) OVER w IS NULL AS is_final, coalesce(content, '') || chr(10) || CASE WHEN contains_code THEN coalesce(code_snippet, '') ELSE '' END AS prompt
FROM u WINDOW w AS (PARTITION BY dialogue_id ORDER BY msg_index, msg_id))
"""


@query(f"{_ASKED} SELECT dialogue_id, msg_id, CAST(turn_index AS INTEGER) AS turn_index, is_final, md5(prompt || CASE WHEN is_final THEN '{_FINAL}' ELSE '' END) AS prompt_md5 FROM a")
def request_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = turns.requests(table(spark, sf_dir, "messages"))
    return asked.select("dialogue_id", "msg_id", "turn_index", "is_final", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query("SELECT record_id, list_filter(turns[-1].messages, lambda m: m.role = 'assistant')[-1].content AS content FROM dialogues")
def final_assistant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dialogues", _SPOKEN).select("record_id", turns.final_assistant(F.col("turns")).alias("content"))


@query("SELECT record_id, turns[-1].messages[-1].code_snippet AS code FROM dialogues")
def final_message_any_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dialogues", _CODED).select("record_id", turns.final_code(F.col("turns")).alias("code"))


_OPENING = """
SELECT record_id, dialogue_id, coalesce(list_filter(turns[1].messages, lambda m: m.role = 'user')[1].content, CASE WHEN list_filter(turns[1].messages, lambda m: m.role = 'user')[1] IS NULL THEN turns[1].messages[1].content END, '')
|| CASE WHEN coalesce(list_filter(turns[1].messages, lambda m: m.role = 'user')[1].code_snippet, '') <> '' THEN ' ' || list_filter(turns[1].messages, lambda m: m.role = 'user')[1].code_snippet ELSE '' END AS opening FROM dialogues
"""


@query(f"SELECT record_id, md5({_NORM.format('opening')}) AS key_md5 FROM ({_OPENING})")
def opening_user_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dialogues", _OPENED).select("record_id", F.md5(turns.opening_key(F.col("turns")).cast("binary")).alias("key_md5"))


@query(f"{_ASKED} SELECT dialogue_id, msg_id, CAST(turn_index AS INTEGER) AS turn_index, CASE WHEN is_final THEN 'DONE' ELSE 'WAITING' END AS state, 'Mock output for: ' || left(prompt, 20) AS output FROM a")
def mock_generation_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generation.mock_generation(table(spark, sf_dir, "messages"))


@query(f"{_ASKED}, s AS (SELECT CASE WHEN is_final THEN 'DONE' ELSE 'WAITING' END AS state FROM a WHERE turn_index = 0) SELECT state, count(*) AS dialogues FROM s GROUP BY state")
def mock_generation_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first round through the client interface."""
    done = generation.generate(table(spark, sf_dir, "messages"), judging.EchoClient, rounds=1)
    return done.groupBy("state").agg(F.count("*").alias("dialogues"))


@query(f"""
WITH c AS (SELECT dialogue_id, count(DISTINCT msg_id) FILTER ({_ROLE} = 'user') AS user_turns, count(DISTINCT msg_id) FILTER ({_ROLE} = 'assistant') AS answers FROM messages WHERE dialogue_id IS NOT NULL GROUP BY 1)
SELECT *, CASE WHEN user_turns = 0 THEN 'STARTING' WHEN answers >= user_turns THEN 'DONE' ELSE 'PROCESSING' END AS state FROM c
""")
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogue progress from the stateful stream: the last state of every dialogue."""
    folder = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    generation.follow_table(spark, f"{sf_dir}/messages.parquet", f"{folder}/out", f"{folder}/checkpoint")
    seen = spark.read.parquet(f"{folder}/out")
    return records.last_wins(seen, "dialogue_id", ["batch"]).drop("batch")


@query(f"SELECT CAST(floor(epoch(created_at) / 86400) AS BIGINT) AS day, count(*) AS messages, count(*) FILTER ({_ROLE} = 'assistant') AS answers FROM messages WHERE created_at IS NOT NULL GROUP BY 1")
def daily_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and answers by day since 1970 (UTC)."""
    counts = generation.windowed_counts(table(spark, sf_dir, "messages"))
    return counts.select(F.floor(F.unix_timestamp("begins") / 86_400).alias("day"), "messages", "answers")


# Text.


@query(f"SELECT doc_id, md5({_NORM.format('text')}) AS norm_md5 FROM documents")
def norm_text_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.norm_text(F.col("text")).cast("binary")).alias("norm_md5"))


_CODES = [c for c, *_ in tasks.TASKS]
_STRICT = "CASE " + " ".join(f"WHEN contains(t, '{c}') THEN '{c}'" for c in _CODES) + " " + " ".join(f"WHEN contains(t, '{n}') THEN '{c}'" for c, n, *_ in tasks.TASKS) + " END"
_LOOSE = "CASE " + " ".join(f"WHEN contains(u, '{c}') THEN '{c}'" for c in _CODES) + " " + " ".join(f"WHEN contains(u, '{n.upper()}') THEN '{c}'" for c, n, *_ in tasks.TASKS) + " END"


@query(f"SELECT msg_id, {_STRICT} AS code FROM (SELECT msg_id, primary_task AS t FROM messages)")
def normalize_task_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages").select("msg_id", tasks.strict_task_code(F.col("primary_task")).alias("code"))


@query(f"SELECT code, count(*) AS messages FROM (SELECT {_LOOSE} AS code FROM (SELECT regexp_replace(upper(primary_task), '[ _-]', ' ', 'g') AS u FROM messages)) GROUP BY code")
def normalize_task_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages").select(tasks.loose_task_code(F.col("primary_task")).alias("code")).groupBy("code").agg(F.count("*").alias("messages"))


_WHOLE_WORD = "CASE " + " ".join(f"WHEN regexp_matches(p, '\\b{c}\\b') THEN '{c}'" for c in _CODES) + " " + " ".join(f"WHEN contains(p, '{' '.join(n.upper().replace('&', ' AND ').replace('-', ' ').split())}') THEN '{c}'" for c, n, *_ in tasks.TASKS) + " END"
_PLAIN = "trim(regexp_replace(replace(upper(metadata.primary_task), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g'))"


@query(f"SELECT coalesce(code, 'UNKNOWN') AS task, count(*) AS dialogues FROM (SELECT {_WHOLE_WORD} AS code FROM (SELECT {_PLAIN} AS p FROM dialogues)) GROUP BY 1")
def split_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.coalesce(tasks.task_code(F.col("metadata.primary_task")), F.lit(scores.UNKNOWN))
    return table(spark, sf_dir, "dialogues").groupBy(code.alias("task")).agg(F.count("*").alias("dialogues"))


@query(f"""
WITH d AS (SELECT record_id, {_WHOLE_WORD} AS code FROM (SELECT record_id, {_PLAIN} AS p FROM dialogues))
SELECT record_id, code, unnest(CASE WHEN code IN ('SCR', 'SCF', 'DRC', 'ISR') THEN ['code', 'judge'] ELSE ['judge'] END) AS evaluator FROM d WHERE code IS NOT NULL
""")
def evaluator_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "dialogues").select("record_id", tasks.task_code(F.col("metadata.primary_task")).alias("code")).filter("code is not null")
    return rows.select("record_id", "code", F.explode(tasks.evaluators_of(F.col("code"))).alias("evaluator"))


@query(r"""
WITH f AS (SELECT doc_id, regexp_extract_all(text, '(?s)```([a-zA-Z0-9_+\-]*)\n(.*?)```', 2) AS blocks FROM documents)
SELECT doc_id, CAST(len(blocks) AS INTEGER) AS fences, md5(array_to_string(blocks, chr(10))) AS code_md5 FROM f WHERE len(blocks) > 0
""")
def fence_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.fenced_blocks(F.col("text")).alias("blocks")).filter(F.size("blocks") > 0)
    return rows.select("doc_id", F.size("blocks").alias("fences"), F.md5(F.array_join("blocks", "\n").cast("binary")).alias("code_md5"))


@query()
def text_code_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose and code of every message text (the sequential splitter)."""
    rows = table(spark, sf_dir, "messages").filter("content is not null").select("msg_id", text.text_and_code(F.col("content")).alias("p"))
    return rows.select("msg_id", F.length("p.text").alias("text_chars"), F.length("p.code").alias("code_chars")).distinct()


_PYTESTS = r"(?m)^\s*(import pytest\b|from pytest\b|@pytest\.|class\s+Test\w*\s*[:(])"


@query(f"""
WITH s AS (SELECT DISTINCT msg_id, code_snippet AS c, regexp_matches(code_snippet, '{_PYTESTS}') AS p FROM messages WHERE code_snippet <> '')
SELECT msg_id, p AS pytest_style, md5(CASE WHEN p THEN c ELSE 'def check():' || chr(10) || '    ' || replace(c, chr(10), chr(10) || '    ') END) AS script_md5 FROM s
""")
def wrap_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "messages").filter("code_snippet <> ''").select("msg_id", F.col("code_snippet").alias("c")).distinct()
    return rows.select("msg_id", text.is_pytest_style(F.col("c")).alias("pytest_style"), F.md5(text.wrap_test(F.col("c")).cast("binary")).alias("script_md5"))


# Scores.

_SAMPLES = """
e AS (SELECT record_id, coalesce(metadata.primary_task, 'UNKNOWN') AS task, scores, list_filter(scores['code_tests'], lambda s: s IS NOT NULL) AS runs, unnest(map_entries(scores)) AS entry FROM dialogues),
l AS (SELECT record_id, task, entry.key AS judge, CAST(i - 1 AS INTEGER) AS idx, entry.value[i] AS s, runs FROM e, unnest(generate_series(1, len(entry.value))) AS u(i) WHERE entry.value[i] IS NOT NULL),
long AS (SELECT record_id, task, judge, idx, s.score AS score, s.verdict AS verdict, s.passed AS passed, coalesce(judge <> 'code_tests' AND runs[idx + 1].passed IS NOT DISTINCT FROM false AND idx < len(runs), false) AS failed_code FROM l),
z AS (SELECT record_id, task, judge, idx, CASE WHEN failed_code THEN 0.0::DOUBLE ELSE score END AS score FROM long WHERE score IS NOT NULL)
"""


@query(f"WITH {_SAMPLES} SELECT * FROM long")
def score_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.long_scores(table(spark, sf_dir, "dialogues", _SCORED))


@query(f"WITH {_SAMPLES} SELECT record_id, judge, idx, score FROM z")
def zero_failed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.zeroed(scores.long_scores(table(spark, sf_dir, "dialogues", _SCORED))).select("record_id", "judge", "idx", "score")


_QUARTILE = "CASE WHEN n = 1 THEN lo ELSE (xs[least(greatest((n + 1) * {q} // 4, 1), n - 1)] * (4 - ((n + 1) * {q} - 4 * least(greatest((n + 1) * {q} // 4, 1), n - 1))) + xs[least(greatest((n + 1) * {q} // 4, 1), n - 1) + 1] * ((n + 1) * {q} - 4 * least(greatest((n + 1) * {q} // 4, 1), n - 1))) / 4 END"


@query(f"""
WITH {_SAMPLES},
b AS (SELECT 'task:' || task AS scope, judge AS metric, score FROM z UNION ALL SELECT 'GLOBAL', judge, score FROM z),
g AS (SELECT scope, metric, count(*) AS n, avg(score) AS mean, median(score) AS median, coalesce(stddev_samp(score), 0.0) AS stdev, min(score) AS lo, max(score) AS hi, list_sort(list(score)) AS xs FROM b GROUP BY scope, metric)
SELECT scope, metric, n, round(mean, 6) AS mean, median, round(stdev, 6) AS stdev, lo AS min, hi AS max, {_QUARTILE.format(q=1)} AS q1, {_QUARTILE.format(q=3)} AS q3 FROM g
""")
def score_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = scores.score_statistics(scores.zeroed(scores.long_scores(table(spark, sf_dir, "dialogues", _SCORED))))
    return stats.withColumn("mean", F.round("mean", 6)).withColumn("stdev", F.round("stdev", 6))


@query()
def score_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics as written to the CSV file (rounded as Python rounds)."""
    return scores.csv_rows(scores.score_statistics(scores.zeroed(scores.long_scores(table(spark, sf_dir, "dialogues", _SCORED)))))


@query(f"""
WITH {_SAMPLES}, c AS (SELECT judge AS metric, lower(verdict) AS verdict, count(*) AS samples FROM long WHERE verdict IS NOT NULL GROUP BY 1, 2)
SELECT metric, verdict, samples, samples / sum(samples) OVER (PARTITION BY metric)::DOUBLE AS share FROM c
""")
def verdict_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores.verdicts(scores.long_scores(table(spark, sf_dir, "dialogues", _SCORED)))


@query(f"""
WITH {_SAMPLES}, m AS (SELECT judge AS metric, task, avg(score) AS mean, count(score) AS n FROM z GROUP BY 1, 2)
SELECT metric, task, round(mean, 6) AS mean, n, CAST(row_number() OVER (PARTITION BY metric ORDER BY round(mean, 9) DESC, task) AS INTEGER) AS place FROM m
""")
def task_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = scores.task_ranking(scores.zeroed(scores.long_scores(table(spark, sf_dir, "dialogues", _SCORED))))
    return ranked.withColumn("mean", F.round("mean", 6))


@query("""
WITH r AS (SELECT coalesce(metadata.primary_task, 'UNKNOWN') AS task, list_filter(scores['code_tests'], lambda s: s IS NOT NULL) AS runs FROM dialogues WHERE scores['code_tests'] IS NOT NULL),
c AS (SELECT task, len(runs) AS n, len(list_filter(runs, lambda s: s.passed IS NOT DISTINCT FROM true)) AS c FROM r WHERE len(runs) > 0),
k AS (SELECT task, n, c, k FROM c, unnest([1, 2, 3]) AS u(k)),
p AS (SELECT task, k, n, CASE WHEN n < k THEN NULL WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1.0 - list_product(list_transform(generate_series(n - c + 1, n), lambda i: 1.0::DOUBLE - k::DOUBLE / i)) END AS p FROM k)
SELECT task, CAST(k AS INTEGER) AS k, count(*) FILTER (n >= k) AS records, count(*) FILTER (n < k) AS skipped, round(avg(p), 6) AS pass_at_k FROM p GROUP BY task, k
""")
def pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = scores.pass_rates(table(spark, sf_dir, "dialogues", _SCORED), text.parse_k_values("1,2,3"))
    return rates.withColumn("pass_at_k", F.round("pass_at_k", 6))


@query("""
WITH s AS (SELECT record_id, unnest(v) AS s FROM (SELECT record_id, e.value AS v FROM (SELECT record_id, unnest(map_entries(scores)) AS e FROM dialogues)))
SELECT verdict, count(*) AS samples, CAST(sum(score) AS BIGINT) AS score FROM (
SELECT CASE WHEN s.score IS NULL OR floor(s.score) < 1 OR floor(s.score) > 10 THEN 'error' WHEN floor(s.score) >= 6 THEN 'pass' ELSE 'fail' END AS verdict, CASE WHEN floor(s.score) BETWEEN 1 AND 10 THEN floor(s.score) ELSE 0 END AS score FROM s WHERE s IS NOT NULL) GROUP BY verdict
""")
def judge_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies in fences, as the samples would have come, parsed again."""
    samples = table(spark, sf_dir, "dialogues").select(F.explode("scores").alias("judge", "v")).select(F.explode("v").alias("s")).filter("s is not null")
    reply = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.col("s.score").alias("score"), F.col("s.reasoning").alias("reasoning"), F.col("s.strengths").alias("strengths"))), F.lit("\n```"))
    parsed = samples.select(judging.parse_judgement(reply).alias("p"))
    return parsed.groupBy(F.col("p.verdict").alias("verdict")).agg(F.count("*").alias("samples"), F.sum("p.score").alias("score"))


# Records.


@query("SELECT dialogue_id, max_by(record_id, (exported_at, record_id)) AS record_id FROM dialogues WHERE dialogue_id IS NOT NULL GROUP BY dialogue_id")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "dialogues").select("dialogue_id", "record_id", "exported_at")
    return records.last_wins(rows, "dialogue_id", ["exported_at", "record_id"]).select("dialogue_id", "record_id")


@query("SELECT dialogue_id, count(*) AS records FROM dialogues WHERE dialogue_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def repeated_dialogue_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.repeated_keys(table(spark, sf_dir, "dialogues"), "dialogue_id")


@query("""
WITH simple AS (SELECT dialogue_id, count(DISTINCT msg_id) AS simple_messages FROM messages WHERE dialogue_id IS NOT NULL AND msg_id IS NOT NULL GROUP BY dialogue_id)
SELECT d.record_id, dialogue_id, coalesce(len(d.turns), -1) AS detailed_turns, simple_messages FROM dialogues d JOIN simple USING (dialogue_id)
""")
def detailed_simple_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated dialogues with their flat export; every evaluated record is kept."""
    simple = turns.delivered_once(table(spark, sf_dir, "messages"), "dialogue_id", "msg_id").groupBy("dialogue_id").agg(F.count("*").alias("simple_messages"))
    detailed = table(spark, sf_dir, "dialogues").select("record_id", "dialogue_id", F.coalesce(F.size("turns.turn_id"), F.lit(-1)).cast("bigint").alias("detailed_turns"))
    return detailed.join(simple, "dialogue_id")


@query("""
WITH f AS (SELECT DISTINCT dialogue_id, msg_id, msg_index, CASE lower(trim(role)) WHEN 'human' THEN 'user' WHEN 'model' THEN 'assistant' ELSE lower(trim(role)) END AS role, content FROM messages WHERE dialogue_id IS NOT NULL AND msg_id IS NOT NULL),
o AS (SELECT *, row_number() OVER w AS place, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w AS users FROM f WINDOW w AS (PARTITION BY dialogue_id ORDER BY msg_index, msg_id)),
g AS (SELECT dialogue_id, place, role, content, 1 + users - first_value(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY dialogue_id ORDER BY place) AS turn FROM o),
s AS (SELECT dialogue_id, max(turn) AS turns, count(*) AS messages, md5(string_agg(turn || chr(31) || role || chr(31) || coalesce(content, ''), chr(30) ORDER BY place)) AS content_md5 FROM g GROUP BY dialogue_id)
SELECT d.record_id AS record_id, d.dialogue_id AS dialogue_id, CAST(s.turns AS INTEGER) AS turns, s.messages AS messages, s.content_md5 AS content_md5 FROM dialogues d JOIN s ON s.dialogue_id = d.dialogue_id
""")
def rewrapped_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evaluated records with their turns replaced by the flat export's, rewrapped; the turns are shown as a digest of all they hold."""
    made = turns.replace_turns(table(spark, sf_dir, "dialogues").select("record_id", "dialogue_id", "turns"), turns.wrapped(table(spark, sf_dir, "messages")))
    said = F.flatten(F.transform("turns", lambda t: F.transform(t["messages"], lambda m: F.concat_ws("\x1f", t["turn_id"].cast("string"), m["role"], F.coalesce(m["content"], F.lit(""))))))
    return made.select("record_id", "dialogue_id", F.size("turns").alias("turns"), F.size(said).cast("bigint").alias("messages"), F.md5(F.array_join(said, "\x1e").cast("binary")).alias("content_md5"))


@query("""
WITH master AS (SELECT dialogue_id, max_by(list_filter(turns[-1].messages, lambda m: m.role = 'assistant')[-1].content, (exported_at, record_id)) FILTER (true) AS a, arg_max({'c': list_filter(turns[-1].messages, lambda m: m.role = 'assistant')[-1].content}, (exported_at, record_id)) AS s FROM dialogues WHERE dialogue_id IS NOT NULL GROUP BY 1),
test AS (SELECT dialogue_id, arg_max({'c': content}, (msg_index, msg_id)) AS t FROM messages WHERE dialogue_id IS NOT NULL AND msg_id IS NOT NULL AND CASE lower(trim(role)) WHEN 'model' THEN 'assistant' ELSE lower(trim(role)) END = 'assistant' GROUP BY 1)
SELECT CASE WHEN m.dialogue_id IS NULL THEN 'not in master' WHEN m.s.c IS NULL OR t.t.c IS NULL THEN 'missing content' ELSE 'compared' END AS outcome, count(*) AS dialogues FROM test t LEFT JOIN master m USING (dialogue_id) GROUP BY 1
""")
def master_test_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What comparing the flat export's last answers with the evaluated dialogues can compare."""
    d = table(spark, sf_dir, "dialogues", _SPOKEN).select("dialogue_id", "record_id", "exported_at", turns.final_assistant(F.col("turns")).alias("master"))
    master = records.last_wins(d, "dialogue_id", ["exported_at", "record_id"]).select("dialogue_id", "master", F.lit(True).alias("known"))
    answers = turns.delivered_once(table(spark, sf_dir, "messages").filter(turns.role_of(F.col("role")) == "assistant"), "dialogue_id", "msg_id", "msg_index", "content")
    test = records.last_wins(answers, "dialogue_id", ["msg_index", "msg_id"])
    outcome = F.when(F.col("known").isNull(), "not in master").when(F.col("master").isNull() | F.col("content").isNull(), "missing content").otherwise("compared")
    return test.join(master, "dialogue_id", "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("dialogues"))


@query("""
WITH master AS (SELECT dialogue_id, arg_max({'c': list_filter(turns[-1].messages, lambda m: m.role = 'assistant')[-1].content}, (exported_at, record_id)) AS s FROM dialogues WHERE dialogue_id IS NOT NULL GROUP BY 1),
test AS (SELECT dialogue_id, arg_max({'c': content}, (msg_index, msg_id)) AS t FROM messages WHERE dialogue_id IS NOT NULL AND msg_id IS NOT NULL AND CASE lower(trim(role)) WHEN 'model' THEN 'assistant' ELSE lower(trim(role)) END = 'assistant' GROUP BY 1)
SELECT dialogue_id, CASE WHEN m.dialogue_id IS NULL THEN 'not in master' ELSE 'missing content' END AS outcome FROM test t LEFT JOIN master m USING (dialogue_id) WHERE m.dialogue_id IS NULL OR m.s.c IS NULL OR t.t.c IS NULL
""")
def skipped_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialogues of the flat export that can't be compared with the evaluated ones, and why."""
    d = table(spark, sf_dir, "dialogues", _SPOKEN).select("dialogue_id", "record_id", "exported_at", turns.final_assistant(F.col("turns")).alias("expected"))
    answers = turns.delivered_once(table(spark, sf_dir, "messages").filter(turns.role_of(F.col("role")) == "assistant"), "dialogue_id", "msg_id", "msg_index", "content")
    test = records.last_wins(answers, "dialogue_id", ["msg_index", "msg_id"]).withColumnRenamed("content", "actual")
    matched = similarity.match_outcomes(test, records.last_wins(d, "dialogue_id", ["exported_at", "record_id"]))
    return matched.filter("outcome <> 'compared'").select("dialogue_id", "outcome")


@query("SELECT doc_id AS line_index, event_id, event_type FROM documents JOIN (SELECT event_id + 1 AS doc_id, event_id, event_type FROM events) USING (doc_id)")
def pair_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as request lines, events as replies named after them."""
    inputs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_index"))
    outputs = table(spark, sf_dir, "events").select(F.concat(F.lit("id_"), F.col("event_id").cast("string")).alias("custom_id"), F.col("event_id").alias("out_order"), "event_id", "event_type")
    return records.pair_by_index(inputs, outputs, prefix="id_").select("line_index", "event_id", "event_type")


@query("SELECT doc_id AS line_index FROM documents WHERE doc_id IS NOT NULL AND doc_id NOT IN (SELECT event_id + 1 FROM events WHERE event_type <> 'error')")
def missing_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.col("doc_id").alias("line_index"))
    outputs = table(spark, sf_dir, "events").filter("event_type <> 'error'").select(F.concat(F.lit("id_"), F.col("event_id").cast("string")).alias("custom_id"))
    return records.missing_outputs(inputs, outputs, prefix="id_")


_KIND = "CASE event_type WHEN 'error' THEN 'errored' WHEN 'signup' THEN 'canceled' ELSE 'succeeded' END"


@query(f"SELECT output, count(*) AS results FROM (SELECT CASE {_KIND} WHEN 'succeeded' THEN 'success' WHEN 'errored' THEN 'error' END AS output FROM events) WHERE output IS NOT NULL GROUP BY 1")
def batch_result_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "errored").when(F.col("event_type") == "signup", "canceled").otherwise("succeeded")
    return records.split_results(table(spark, sf_dir, "events"), kind).groupBy("output").agg(F.count("*").alias("results"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", records.get_path(F.col("props"), "k").try_cast("bigint").alias("k"))


_CUT = "CASE WHEN contains(string_split(text, '```json')[2], '```') THEN regexp_extract(string_split(text, '```json')[2], '(?s)^(.*)```', 1) ELSE string_split(text, '```json')[2] END"


@query(f"SELECT doc_id, md5(CASE WHEN contains(text, '```json') THEN trim({_CUT}, ' ' || chr(9) || chr(10) || chr(13)) ELSE text END) AS payload_md5 FROM documents WHERE text IS NOT NULL AND coalesce(lang, '') <> 'fr'")
def normalize_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the two providers' envelopes (French ones as cut off), opened again."""
    limit, text_ = F.when(F.coalesce("lang", F.lit("")) == "fr", "max_tokens").otherwise("end_turn"), F.col("text")
    first = F.to_json(F.struct(F.struct(F.lit("succeeded").alias("type"), F.struct(limit.alias("stop_reason"), F.array(F.struct(F.lit("text").alias("type"), text_.alias("text"))).alias("content")).alias("message")).alias("result")))
    finish = F.when(limit == "max_tokens", "length").otherwise("stop")
    second = F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(finish.alias("finish_reason"), F.struct(text_.alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response")))
    rows = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.when(F.col("n_chars") % 2 == 0, first).otherwise(second).alias("raw"))
    return records.open_envelopes(rows).select("doc_id", F.md5(F.col("payload").cast("binary")).alias("payload_md5"))


@query("SELECT feed, file_name, line_no, 'rec_' || (line_no - 1) AS id FROM raw_records")
def add_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.add_ids(table(spark, sf_dir, "raw_records").select("feed", "file_name", "line_no"), "rec")


@query("""
SELECT feed, count(*) AS lines, count(*) FILTER (trim(coalesce(raw, ''), ' ' || chr(9) || chr(10) || chr(13)) = '') AS blank, count(*) FILTER (trim(coalesce(raw, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' AND json_valid(raw)) AS valid,
count(*) FILTER (trim(coalesce(raw, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' AND NOT json_valid(raw)) AS invalid FROM raw_records GROUP BY feed
""")
def line_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.line_counts(table(spark, sf_dir, "raw_records"), text.json_valid(F.col("raw")), ["feed"])


@query("SELECT file_name, line_no, left(raw, 200) AS snippet FROM raw_records WHERE trim(coalesce(raw, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' AND NOT json_valid(raw)")
def malformed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "raw_records").select(F.col("file_name").alias("file"), "line_no", "raw")
    return jsonl.malformed(lines).withColumnRenamed("file", "file_name")


@query("""
WITH v AS (SELECT json_extract_string(raw, '$.dialogue_id') AS key, feed, file_seq, line_no, file_name FROM raw_records WHERE trim(coalesce(raw, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' AND json_valid(raw))
SELECT key, max(struct_pack(a := file_seq, b := line_no)).a AS file_seq, max(struct_pack(a := file_seq, b := line_no)).b AS line_no FROM v WHERE key IS NOT NULL GROUP BY key
""")
def keyed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last record of each dialogue over all feeds' files."""
    lines = table(spark, sf_dir, "raw_records").select("raw", "file_seq", "line_no")
    return jsonl.keyed(lines, "dialogue_id", ["file_seq", "line_no"]).select("key", "file_seq", "line_no")


@query("SELECT least(100, count(DISTINCT msg_id)) AS sampled FROM messages WHERE msg_id IS NOT NULL")
def sample_exact_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of a hundred messages; its size."""
    rows = turns.delivered_once(table(spark, sf_dir, "messages"), "dialogue_id", "msg_id")
    return records.sample_exact(rows, 100, ["msg_id"], seed=7).agg(F.count("*").alias("sampled"))


@query()
def sample_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the messages."""
    return records.sample_percent(turns.delivered_once(table(spark, sf_dir, "messages"), "dialogue_id", "msg_id"), 10.0, ["msg_id"], seed=7)


@query("SELECT record_id, copy, 'id_' || record_id || '_' || copy AS custom_id, md5(coalesce(metadata.downstream_application, '') || chr(10) || coalesce(metadata.language, '')) AS prompt_md5 FROM dialogues, unnest([0, 1, 2]) AS u(copy)")
def cross_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three requests for every dialogue's prompt."""
    prompt = F.concat(F.coalesce("metadata.downstream_application", F.lit("")), F.lit("\n"), F.coalesce("metadata.language", F.lit("")))
    rows = table(spark, sf_dir, "dialogues").select("record_id", prompt.alias("prompt"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("copy"))
    return rows.select("record_id", "copy", F.concat(F.lit("id_"), F.col("record_id").cast("string"), F.lit("_"), F.col("copy").cast("string")).alias("custom_id"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@query("SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers written as CSV and read again."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    path = f"{shared_dir(spark)}/csv-{uuid.uuid4().hex}"
    rows.write.option("header", True).csv(path)
    return jsonl.read_csv(spark, path, schema=", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields))


# Duplicates.


def _document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id is not null").select(F.coalesce(F.lower(F.trim("source")), F.lit("")).alias("scope"), F.col("doc_id").alias("line"), text.norm_text(F.col("text")).alias("key"))


_FLAGGED = f"""
WITH k AS (SELECT coalesce(lower(trim(source, ' ')), '') AS scope, doc_id AS line, {_NORM.format('text')} AS key FROM documents WHERE doc_id IS NOT NULL),
g AS (SELECT scope, line, CASE WHEN key = '' THEN line ELSE min(line) OVER (PARTITION BY scope, key) END AS first_line, CASE WHEN key = '' THEN 1 ELSE count(*) OVER (PARTITION BY scope, key) END AS copies FROM k),
f AS (SELECT *, CASE WHEN copies = 1 THEN 'UNIQUE' WHEN line = first_line THEN 'ORIGINAL' ELSE 'DUPLICATE -> L' || first_line END AS flag FROM g)
"""


@query(f"{_FLAGGED} SELECT * FROM f")
def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.flags(dedup.exact_groups(_document_keys(spark, sf_dir)))


@query(f"{_FLAGGED} SELECT scope, line FROM f WHERE NOT starts_with(flag, 'DUPLICATE')")
def remove_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.remove_duplicates(dedup.flags(dedup.exact_groups(_document_keys(spark, sf_dir)))).select("scope", "line")


@query(f"{_FLAGGED} SELECT scope, count(*) FILTER (flag = 'UNIQUE') AS uniques, count(*) FILTER (flag = 'ORIGINAL') AS originals, count(*) FILTER (starts_with(flag, 'DUPLICATE')) AS duplicates, count(*) FILTER (NOT starts_with(flag, 'DUPLICATE')) AS distinct_rows FROM f GROUP BY scope")
def duplicate_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.totals(dedup.flags(dedup.exact_groups(_document_keys(spark, sf_dir))))


@query()
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Openings of evaluated dialogues whose sequence ratio is 0.97 or more, in one scope."""
    rows = table(spark, sf_dir, "dialogues", _OPENED).filter("record_id is not null").select(F.lit("all").alias("scope"), F.col("record_id").alias("line"), turns.opening_key(F.col("turns")).alias("key"))
    return dedup.flags(dedup.near_groups(rows))


# Similarity.


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "dialogues", _SPOKEN).select("record_id", turns.expected_text(F.col("final_ground_truth")).alias("expected"), turns.final_assistant(F.col("turns")).alias("actual")).filter("expected is not null and actual is not null")


_TFIDF = r"""
WITH p AS (SELECT record_id, final_ground_truth.expected_nl_output AS a, list_filter(turns[-1].messages, lambda m: m.role = 'assistant')[-1].content AS b FROM dialogues),
q AS (SELECT record_id, a, b, regexp_extract_all(lower(a), '[\p{L}\p{N}_][\p{L}\p{N}_]+') AS ta, regexp_extract_all(lower(b), '[\p{L}\p{N}_][\p{L}\p{N}_]+') AS tb FROM p WHERE trim(a) <> '' AND b IS NOT NULL),
w AS (SELECT record_id, t, count(*) FILTER (side = 0) AS ca, count(*) FILTER (side = 1) AS cb FROM (SELECT record_id, unnest(ta) AS t, 0 AS side FROM q UNION ALL SELECT record_id, unnest(tb), 1 FROM q) GROUP BY record_id, t),
s AS (SELECT record_id, sum(ca * cb)::DOUBLE AS dot, sqrt(sum(ca * ca * CASE WHEN cb > 0 THEN 1.0::DOUBLE ELSE power(1 + ln(1.5::DOUBLE), 2) END)) AS na, sqrt(sum(cb * cb * CASE WHEN ca > 0 THEN 1.0::DOUBLE ELSE power(1 + ln(1.5::DOUBLE), 2) END)) AS nb FROM w GROUP BY record_id),
r AS (SELECT record_id, length(a) AS expected_chars, length(b) AS actual_chars, round(coalesce(CASE WHEN na * nb > 0 THEN dot / (na * nb) END, 0.0), 6) AS similarity FROM q LEFT JOIN s USING (record_id))
"""


@query(f"{_TFIDF} SELECT record_id, similarity, CAST(expected_chars AS INTEGER) AS expected_chars, CAST(actual_chars AS INTEGER) AS actual_chars FROM r")
def tfidf_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final answers against the expected ones."""
    return similarity.compare(_answers(spark, sf_dir), "expected", "actual", "tfidf", "record_id").drop("method")


@query(f"{_TFIDF} SELECT count(*) AS n, round(avg(similarity), 6) AS mean, round(median(similarity), 6) AS median, min(similarity) AS min, max(similarity) AS max, round(stddev_samp(similarity), 6) AS stdev FROM r")
def similarity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = similarity.summary(tfidf_similarity(spark, sf_dir))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "median")], "min", "max", F.round("stdev", 6).alias("stdev"))


@query()
def difflib_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.compare(_answers(spark, sf_dir), "expected", "actual", "difflib", "record_id")


@query("""
WITH p AS (SELECT a.vec_id AS vec_id, list_transform(a.embedding, lambda x: x::DOUBLE) AS x, list_transform(b.embedding, lambda x: x::DOUBLE) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(greatest(0.0, least(1.0, list_cosine_similarity(x, y))), 6) AS similarity FROM p
""")
def embedding_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the next."""
    v = table(spark, sf_dir, "embeddings").filter("embedding is not null")
    following = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.select("vec_id", "embedding").join(following, "vec_id").select("vec_id", F.round(similarity.embedding_similarity(F.col("embedding"), F.col("other")), 6).alias("similarity"))


# Code.


def _python_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "dialogues", _CODED)
    return d.select("record_id", turns.final_code(F.col("turns")).alias("code"), F.col("final_ground_truth.test_cases_to_pass").alias("tests"), F.col("final_ground_truth.expected_output_code").alias("reference"), F.try_element_at(F.col("final_ground_truth.constraints_to_check"), F.lit(1)).alias("expected"))


@query()
def code_eval_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dialogue's final code run against its tests, in processes of their own."""
    samples = _python_answers(spark, sf_dir).select("record_id", "code", "tests", F.lit(None).cast("string").alias("expected"))
    return codeeval.evaluate(samples).select("record_id", "passed", "result", "completion_id", "vacuous")


@query()
def candidate_pass_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues as problems, the final code of each of their records as a candidate: runs, passes and pass@1 and pass@2."""
    code = _python_answers(spark, sf_dir).drop("reference", "expected").withColumn("expected", F.lit(None).cast("string"))
    runs = codeeval.evaluate(table(spark, sf_dir, "dialogues").filter("dialogue_id is not null").select("record_id", "dialogue_id").join(code, "record_id"))
    return codeeval.candidate_rates(runs, "dialogue_id", [1, 2])


@query()
def entry_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _python_answers(spark, sf_dir).filter("reference is not null")
    return rows.select("record_id", codeeval.entry_column(F.col("reference"), F.col("expected")).alias("e")).select("record_id", "e.*")


@query()
def code_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each kind of token occurs in the Python snippets."""
    snippets = table(spark, sf_dir, "messages").filter(F.lower("file_path").endswith(".py") & (F.col("code_snippet") != "")).select("msg_id", "code_snippet").distinct()
    kinds = snippets.select("msg_id", F.explode(F.transform(codeeval.token_column(F.col("code_snippet")), lambda t: F.left(t, F.lit(2)))).alias("kind"))
    return kinds.groupBy("kind").agg(F.count("*").alias("tokens"), F.count_distinct("msg_id").alias("snippets"))


@query()
def codebleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _python_answers(spark, sf_dir).filter("reference is not null and code is not null")
    return rows.select("record_id", codeeval.code_bleu_column(F.col("code"), F.col("reference")).alias("b")).select("record_id", "b.*")


# Requests.


@query("SELECT 'id_' || (row_number() OVER (ORDER BY doc_id) - 1) AS custom_id, md5('Answer in one paragraph.' || chr(10) || text) AS content_md5, 3000 AS max_tokens FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL")
def batch_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a prompt of a batch request."""
    prompts = table(spark, sf_dir, "documents").filter("doc_id is not null and text is not null").select("doc_id", F.col("text").alias("prompt"))
    rows = requests.batch_requests(prompts, ["doc_id"], "model", header="Answer in one paragraph.")
    return rows.select("custom_id", F.md5(F.element_at("body.messages", 1)["content"].cast("binary")).alias("content_md5"), F.col("body.max_tokens").alias("max_tokens"))


@query()
def split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The received records with prose and code of their messages apart, all other fields as they came."""
    lines = table(spark, sf_dir, "raw_records").select("file_name", "line_no", requests.split_records(F.col("raw")).alias("raw"))
    return lines.filter("raw is not null")


@query()
def transformed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of evaluated dialogues rebuilt with prose and code apart, per record."""
    rows = table(spark, sf_dir, "dialogues").select("record_id", F.explode(requests.split_turns(F.col("turns"))).alias("t")).select("record_id", F.explode("t.messages").alias("m"))
    return rows.groupBy("record_id").agg(F.count("m").alias("messages"), F.count_if("m.metadata.contains_code").alias("with_code"))


@query("SELECT json_extract_string(raw, '$.dialogue_id') IS NOT NULL AS has_id, count(*) AS lines, CAST(sum(coalesce(CASE WHEN json_extract(raw, '$.conversation') IS NOT NULL THEN json_array_length(raw, '$.conversation') WHEN json_extract(raw, '$.messages') IS NOT NULL THEN json_array_length(raw, '$.messages') ELSE json_array_length(raw, '$.turns') END, 0)) AS BIGINT) AS messages FROM raw_records WHERE trim(coalesce(raw, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' AND json_valid(raw) GROUP BY 1")
def message_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of the received lines, wherever a record keeps them."""
    lines = jsonl.validated(table(spark, sf_dir, "raw_records").select("raw"))
    size = F.greatest(F.coalesce(F.size(requests.message_container(F.col("raw"))), F.lit(0)), F.lit(0))
    return lines.groupBy(F.get_json_object("raw", "$.dialogue_id").isNotNull().alias("has_id")).agg(F.count("*").alias("lines"), F.sum(size).alias("messages"))


@query("SELECT record_id, md5(final_ground_truth.expected_nl_output) AS expected_md5 FROM dialogues WHERE trim(final_ground_truth.expected_nl_output, ' ') <> ''")
def expected_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.answer_pairs(table(spark, sf_dir, "dialogues")).select("record_id", F.md5(F.col("expected").cast("binary")).alias("expected_md5"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
