"""Multi-turn generation: a dialogue's user turns are answered round by round, as batch rounds or as a stream.

States: STARTING, PROCESSING, WAITING, FINISHING, DONE, ERROR. A round answers every open dialogue once; the last turn gets
the final prompt. The stream keeps each dialogue's progress in Spark's state store and recovers from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from dialogforge.operators.judging import Client, complete, mock_output
from dialogforge.operators.turns import requests, role_of
from dialogforge.session import cut

STATES = ["STARTING", "PROCESSING", "WAITING", "FINISHING", "DONE", "ERROR"]


def mock_generation(messages: DataFrame) -> DataFrame:
    """``dialogue_id, msg_id, turn_index, state, output`` with the deterministic stand-in for a model: all rounds at once."""
    asked = requests(messages, final_prompt="")
    return asked.select("dialogue_id", "msg_id", "turn_index", F.when(F.col("is_final"), "DONE").otherwise("WAITING").alias("state"), mock_output(F.col("prompt")).alias("output"))


def save_progress(done: DataFrame, path: str) -> None:
    """Keeps the answered turns, so that a later run can go on with them."""
    done.write.mode("overwrite").parquet(path)


def restore_progress(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def generate(messages: DataFrame, factory: Callable[[], Client], rounds: int | None = None, parallel: int | None = None, done: DataFrame | None = None) -> DataFrame:
    """``dialogue_id, turn_index, state, prompt, reply`` of all answered turns; each round is written before the next begins.

    A dialogue whose call failed is in state ERROR with the error as its reply and gets no further turns.
    rounds: how many to run; None for as many as the longest dialogue has turns. done: turns answered by an earlier run,
    which are not asked again.
    """
    asked = cut(requests(messages), "requests")
    last = asked.agg(F.max("turn_index")).first()[0]
    count = 0 if last is None else last + 1
    if done is not None:
        asked = cut(asked.join(done.select("dialogue_id", "turn_index"), ["dialogue_id", "turn_index"], "left_anti"), "open")
    failed = done.filter("state = 'ERROR'").select("dialogue_id") if done is not None else None
    for k in range(count if rounds is None else min(rounds, count)):
        now = asked.filter(F.col("turn_index") == k)
        if failed is not None:
            now = now.join(failed, "dialogue_id", "left_anti")
        replies = complete(now, factory, parallel=parallel)
        error = F.startswith("reply", F.lit("error: "))
        state = F.when(error, "ERROR").when(F.col("is_final"), "DONE").otherwise("WAITING")
        result = cut(replies.select("dialogue_id", "turn_index", state.alias("state"), "prompt", "reply"), "round")
        failed = result.filter("state = 'ERROR'").select("dialogue_id") if failed is None else failed.unionByName(result.filter("state = 'ERROR'").select("dialogue_id"))
        done = result if done is None else done.unionByName(result)
    return done if done is not None else asked.select("dialogue_id", "turn_index", F.lit("STARTING").alias("state"), "prompt", F.lit(None).cast("string").alias("reply")).limit(0)


def _progress(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Counts a dialogue's turns as they arrive; a message counts once, in whatever batch it is delivered again.

    The state holds the totals and the ids of the dialogue's messages.
    """
    users, answers, known = state.get if state.exists else (0, 0, [])
    seen = set(known)
    for batch in batches:
        for msg_id, role in zip(batch.msg_id, batch.role):
            if msg_id not in seen:
                seen.add(msg_id)
                users += role == "user"
                answers += role == "assistant"
    state.update((int(users), int(answers), sorted(int(x) for x in seen)))
    name = "STARTING" if not users else "DONE" if answers >= users else "PROCESSING"
    yield pd.DataFrame({"dialogue_id": [key[0]], "user_turns": [users], "answers": [answers], "state": [name]})


def follow(messages: DataFrame) -> DataFrame:
    """A stream of messages -> a stream of ``dialogue_id, user_turns, answers, state``, updated with every batch."""
    rows = messages.filter("dialogue_id is not null and msg_id is not null").select("dialogue_id", "msg_id", role_of(F.col("role")).alias("role"))
    return rows.groupBy("dialogue_id").applyInPandasWithState(_progress, "dialogue_id string, user_turns bigint, answers bigint, state string", "users bigint, answers bigint, seen array<bigint>", "update", GroupStateTimeout.NoTimeout)


def follow_table(spark: SparkSession, path: str, out: str, checkpoint: str) -> None:
    """Runs the stream over what lies at ``path`` and stops; run again, it takes up where it stopped."""
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    source = spark.readStream.schema(schema)
    if status.isDirectory():
        files = source.parquet(path)
    else:  # a stream reads folders: take the one file out of its folder
        files = source.option("pathGlobFilter", place.getName()).parquet(place.getParent().toString())
    stream = follow(files)

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed_counts(messages: DataFrame, late: str = "7 days", size: str = "1 day") -> DataFrame:
    """A stream or table of messages -> messages and answers per window of ``created_at``; rows later than ``late`` are dropped from a stream."""
    timed = messages.withWatermark("created_at", late) if messages.isStreaming else messages
    counts = timed.groupBy(F.window("created_at", size).alias("w")).agg(F.count("*").alias("messages"), F.count_if(role_of(F.col("role")) == "assistant").alias("answers"))
    return counts.select(F.col("w.start").alias("begins"), "messages", "answers")
