"""Preparing requests: prompt libraries, batch requests, judge pairs and messages split into prose and code."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogforge.functions.text import split_text_and_code
from dialogforge.operators.records import numbered
from dialogforge.operators.turns import expected_text, last_turn

MAX_TOKENS = 3_000
_MESSAGE = "struct<role:string,content:string,code_snippet:string,metadata:struct<contains_code:boolean,intent:string>>"


def prompt_library(spark: SparkSession, folder: str, name: str = "PROMPT.md") -> DataFrame:
    """``tier, task, prompt`` of the files ``<folder>/<tier>/<task>/<name>``."""
    files = spark.read.text(f"{folder}/*/*/{name}", wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return files.select(F.element_at(parts, -3).alias("tier"), F.element_at(parts, -2).alias("task"), F.col("value").alias("prompt"))


def batch_requests(
    prompts: DataFrame, order: list[str], model: str, header: str = "", copies: int = 1, limit: int | None = None, max_tokens: int = MAX_TOKENS, temperature: float | None = None, tools: list[str] | None = None, start: int = 0, prefix: str = "id_"
) -> DataFrame:
    """``custom_id, body``: every prompt ``copies`` times under the header, ids numbered in ``order``; at most ``limit`` prompts."""
    chosen = prompts.orderBy(*order).limit(limit) if limit is not None else prompts
    each = chosen.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    rows = numbered(each, [*order, "_copy"], "_i", start)
    text = F.concat(F.lit(header + "\n" if header else ""), F.col("prompt"))
    tool = F.array(*[F.struct(F.lit("function").alias("type"), F.lit(t).alias("name")) for t in tools]) if tools else F.lit(None).cast("array<struct<type:string,name:string>>")
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"), tool.alias("tools"), F.lit(max_tokens).alias("max_tokens"), F.lit(temperature).cast("double").alias("temperature"))
    return rows.select(F.concat(F.lit(prefix), F.col("_i").cast("string")).alias("custom_id"), body.alias("body"))


def judge_pairs(dialogues: DataFrame, id_column: str = "record_id") -> DataFrame:
    """``id, guideline, reference, candidate``: the whole ground truth and the whole last turn as JSON, the guideline empty."""
    pairs = dialogues.filter("final_ground_truth is not null").select(id_column, "final_ground_truth", "turns")
    return pairs.select(id_column, F.lit("").alias("guideline"), F.to_json("final_ground_truth").alias("reference"), F.coalesce(F.to_json(last_turn(F.col("turns"))), F.lit("{}")).alias("candidate"))


def judged_candidates(references: DataFrame, id_column: str = "record_id") -> DataFrame:
    """One row per candidate of ``candidates`` (array<string>) with its place, for judging several against one reference."""
    return references.select(id_column, "guideline", "reference", F.posexplode("candidates").alias("index", "candidate"))


def answer_pairs(dialogues: DataFrame, id_column: str = "record_id") -> DataFrame:
    """``id, expected`` where an expected answer is there."""
    return dialogues.select(id_column, expected_text(F.col("final_ground_truth")).alias("expected")).filter("expected is not null")


def split_turns(turns: Column) -> Column:
    """Turns with their messages rebuilt as role, content (prose), code_snippet and metadata; other fields are dropped.

    A record's messages are split in one call; null turns and messages stay null, content that is null stays null.
    """

    @F.pandas_udf(f"array<struct<turn_id:bigint,messages:array<{_MESSAGE}>>>")
    def rebuilt(column: pd.Series) -> pd.Series:
        def message(m: dict | None) -> dict | None:
            if m is None:
                return None
            prose, code = split_text_and_code(m["content"]) if m["content"] is not None else (None, "")
            return {"role": m["role"], "content": prose, "code_snippet": code, "metadata": {"contains_code": bool(code), "intent": ""}}

        def turn(t: dict | None) -> dict | None:
            return None if t is None else {"turn_id": None if pd.isna(t["turn_id"]) else int(t["turn_id"]), "messages": None if t["messages"] is None else [message(m) for m in t["messages"]]}

        return pd.Series([None if ts is None else [turn(t) for t in ts] for ts in column], dtype=object)

    narrow = F.transform(turns, lambda t: F.when(t.isNotNull(), F.struct(t["turn_id"].alias("turn_id"), F.transform(t["messages"], lambda m: F.when(m.isNotNull(), F.struct(m["role"].alias("role"), m["content"].alias("content")))).alias("messages"))))
    return rebuilt(narrow)


_FLAT = "array<struct<role:string,content:string,code_snippet:string>>"


def message_container(raw: Column) -> Column:
    """The messages of a JSON record: under ``conversation``, else ``messages``, else those of all ``turns`` (or the turns themselves)."""
    direct = lambda name: F.from_json(F.get_json_object(raw, f"$.{name}"), _FLAT)
    turns = F.get_json_object(raw, "$.turns")
    nested = F.from_json(turns, f"array<struct<messages:{_FLAT}>>")
    inner = F.flatten(F.filter(F.transform(nested, lambda t: t["messages"]), lambda m: m.isNotNull()))
    return F.coalesce(direct("conversation"), direct("messages"), F.when(F.size(inner) > 0, inner), F.from_json(turns, _FLAT))


def split_record(record: dict) -> dict:
    """A record whose messages are rebuilt with prose and code apart, wherever it keeps them; all its other fields stay.

    The first of ``conversation``, ``messages`` and ``turns`` that holds a list counts. Messages that are no objects stay as they
    are, and so does content that is no text.
    """

    def message(m: object) -> object:
        if not isinstance(m, dict):
            return m
        content = m.get("content")
        prose, code = split_text_and_code(content) if isinstance(content, str) else (content, "")
        return {"role": m.get("role"), "content": prose, "code_snippet": code, "metadata": {"contains_code": bool(code), "intent": ""}}

    place = next((k for k in ("conversation", "messages", "turns") if isinstance(record.get(k), list)), None)
    if place is None:
        return record
    if place != "turns":
        return record | {place: [message(m) for m in record[place]]}
    whole = lambda t: t | {"messages": [message(m) for m in t["messages"]]} if isinstance(t, dict) and isinstance(t.get("messages"), list) else t
    return record | {"turns": [whole(t) for t in record["turns"]]}


def split_records(raw: Column) -> Column:
    """JSON texts of records with their messages rebuilt by ``split_record``; null for text that is no JSON object."""

    @F.pandas_udf("string")
    def rebuilt(lines: pd.Series) -> pd.Series:
        def one(line: str | None) -> str | None:
            try:
                record = json.loads(line)
            except (TypeError, ValueError, RecursionError):
                return None
            return json.dumps(split_record(record), ensure_ascii=False) if isinstance(record, dict) else None

        return pd.Series([one(x) for x in lines], dtype=object)

    return rebuilt(raw)
