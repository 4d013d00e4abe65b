"""Judging answers by a model: prompts, replies and batches through a pluggable client."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dialogforge.functions.text import unfence_judgement

THRESHOLD = 6
JUDGEMENT = "score variant, reasoning string, strengths array<string>, weaknesses array<string>"
SYSTEM = "You compare a candidate answer with a reference and reply with one JSON object: score (1 to 10), reasoning, strengths, weaknesses."


class Client(Protocol):
    """What answers prompts; made on the worker by a factory that is sent with the job."""

    def complete(self, system: str, prompt: str) -> str: ...


class EchoClient:
    """The deterministic stand-in: repeats the beginning of the prompt."""

    def complete(self, system: str, prompt: str) -> str:
        return "Mock output for: " + prompt[:20]


def mock_output(prompt: Column) -> Column:
    """What the deterministic stand-in answers, as an expression."""
    return F.concat(F.lit("Mock output for: "), F.left(prompt, F.lit(20)))


def retryable(error: Exception) -> bool:
    """Whether a failed call may be tried again: rate limits, server errors, lost connections."""
    status = getattr(error, "status_code", None) or getattr(error, "status", None)
    if isinstance(status, int):
        return status == 429 or status >= 500
    name = type(error).__name__.lower()
    return any(word in name for word in ("timeout", "connection", "ratelimit", "overloaded", "unavailable"))


def with_retries(call: Callable[[], str], attempts: int = 3, base: float = 1.0, most: float = 20.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """The call's result; failures that may pass are tried again after a doubling delay with jitter."""
    for attempt in range(1, attempts + 1):
        try:
            return call()
        except Exception as error:
            if attempt == attempts or not retryable(error):
                raise
            sleep(min(most, base * 2 ** (attempt - 1)) + random.uniform(0, 0.5))
    raise AssertionError


def judge_prompt(guideline: Column, reference: Column, candidate: Column) -> Column:
    """The user prompt of a judge call."""
    return F.concat(F.lit("## Task Description\n"), guideline, F.lit("\n\n## Reference\n"), reference, F.lit("\n\n## Candidate\n"), candidate)


def parse_judgement(reply: Column, threshold: int = THRESHOLD) -> Column:
    """``struct<score, verdict, reasoning, strengths, weaknesses>`` of a reply.

    Scores given as text or with a fraction are cut to whole numbers; replies that are no JSON object or whose score is
    missing or outside 1..10 get score 0 and the verdict "error". A row-level error never fails the job.
    """
    text = unfence_judgement(reply)
    body = F.try_parse_json(text)
    number = F.try_variant_get(body, "$.score", "string")
    score = F.floor(number.try_cast("double")).cast("int")
    good = F.startswith(F.coalesce(text, F.lit("")), F.lit("{")) & score.between(1, 10)
    good = F.coalesce(good, F.lit(False))
    verdict = F.when(~good, "error").when(score >= threshold, "pass").otherwise("fail")
    return F.struct(
        F.when(good, score).otherwise(F.lit(0)).alias("score"),
        verdict.alias("verdict"),
        F.when(good, F.try_variant_get(body, "$.reasoning", "string")).alias("reasoning"),
        F.when(good, F.try_variant_get(body, "$.strengths", "array<string>")).alias("strengths"),
        F.when(good, F.try_variant_get(body, "$.weaknesses", "array<string>")).alias("weaknesses"),
    )


def complete(prompts: DataFrame, factory: Callable[[], Client], system: str = SYSTEM, parallel: int | None = None, attempts: int = 3) -> DataFrame:
    """``prompts`` with a ``reply`` for each ``prompt``; errors become ``error: ...``.

    parallel: at most so many calls at once, for a service that limits them; None for a task per partition of the prompts.

    Write the result before using it twice: a lost task would call the model again.
    """
    names = prompts.columns

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for batch in batches:
            replies = []
            for prompt in batch["prompt"]:
                try:
                    replies.append(with_retries(lambda p=prompt: client.complete(system, p), attempts))
                except Exception as error:
                    replies.append(f"error: {error}"[:500])
            yield batch.assign(reply=replies)[[*names, "reply"]]

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema.fields) + ", reply string"
    return (prompts.repartition(parallel) if parallel else prompts).mapInPandas(answer, schema)


def judge(pairs: DataFrame, factory: Callable[[], Client], threshold: int = THRESHOLD, parallel: int | None = None) -> DataFrame:
    """``pairs`` (``guideline, reference, candidate`` and ids) with the parsed judgement."""
    if not 1 <= threshold <= 10:
        raise ValueError("threshold must lie in 1..10")
    replies = complete(pairs.withColumn("prompt", judge_prompt(F.col("guideline"), F.col("reference"), F.col("candidate"))), factory, parallel=parallel)
    return replies.withColumn("judgement", parse_judgement(F.col("reply"), threshold)).drop("prompt", "reply")
