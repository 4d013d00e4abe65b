"""Source files that do not parse, per file and as rates per repository and language.

Each code snippet is parsed by the language its file's extension claims; all errors are kept with their places, the first
of them (or a merge conflict) is the cause. Parsing is a narrow step in Arrow batches over every message; rates are one
aggregation in which every message counts once, however often it was delivered.

Defined results: blank and null snippets, null paths and extensions of other languages are not judged; null ids are left
out; a null repository is a group of its own; text that is nested deeper than the parsers follow (20,000
levels; JSON has no such bound) and has no error before is not judged: ``valid`` is null and the cause says so; columns other than those named are ignored.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialogforge.llm.syntax import LANGUAGES, UNJUDGED, errors_of

_RESULT = "struct<cause:string,errors:array<struct<place:int,message:string>>>"


def parsed_files(messages: DataFrame) -> DataFrame:
    """``msg_id, repo, file_path, language, valid, cause, errors`` of every judged snippet, repeated deliveries included."""

    @F.pandas_udf(_RESULT)
    def parsed(extension: pd.Series, code: pd.Series) -> pd.DataFrame:
        rows = [errors_of(e, c) for e, c in zip(extension, code)]
        return pd.DataFrame({"cause": [cause for _, cause in rows], "errors": [[{"place": p, "message": m} for p, m in errors] for errors, _ in rows]})

    extension = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1))
    names = F.create_map(*[F.lit(x) for e, (name, _) in LANGUAGES.items() for x in (e, name)])
    judged = messages.filter("msg_id is not null and file_path is not null").filter(F.regexp_like("code_snippet", F.lit(r"\S"))).select("msg_id", "repo", "file_path", extension.alias("extension"), "code_snippet").filter(F.col("extension").isin(*LANGUAGES))
    out = judged.withColumn("p", parsed("extension", "code_snippet"))
    return out.select("msg_id", "repo", "file_path", names[F.col("extension")].alias("language"), F.when(F.coalesce("p.cause", F.lit("")) != UNJUDGED, F.size("p.errors") == 0).alias("valid"), F.nullif(F.col("p.cause"), F.lit("")).alias("cause"), F.col("p.errors").alias("errors"))


def invalid_files(messages: DataFrame) -> DataFrame:
    """``msg_id, language, cause, errors`` of the snippets that do not parse, once for each message."""
    return parsed_files(messages).filter("not valid").select("msg_id", "language", "cause", "errors").dropDuplicates(["msg_id"])


def invalid_rates(messages: DataFrame) -> DataFrame:
    """``repo, language, files, invalid, rate, acceptance``; ``grouped`` tells the level: by repo and language, repo, or language."""
    once = parsed_files(messages).filter("valid is not null").select("msg_id", "repo", "language", "valid").dropDuplicates(["msg_id"])
    base = once.groupBy("repo", "language").agg(F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"))
    by = base.groupingSets([["repo", "language"], ["repo"], ["language"]], "repo", "language")
    level = F.when(F.grouping("language") == 1, "repo").when(F.grouping("repo") == 1, "language").otherwise("repo, language")
    rates = by.agg(level.alias("grouped"), F.sum("files").alias("files"), F.sum("invalid").alias("invalid"))
    rate = F.col("invalid") / F.col("files")
    return rates.select("grouped", "repo", "language", "files", "invalid", rate.alias("rate"), (1 - rate).alias("acceptance"))
