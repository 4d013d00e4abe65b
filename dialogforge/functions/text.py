"""Text expressions; all stay in the JVM except where a step is sequential (those are pandas UDFs at the end).

Null in, null out, unless said otherwise.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python sees it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
_FENCE = "```"


def norm_text(text: Column) -> Column:
    """Lower case, runs of white space to one blank, then other characters to blanks (not collapsed again), trimmed; null gives ""."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, SPACE + "+", " "), "[^a-z0-9 ]", " "))


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def unwrap_fenced_json(content: Column) -> Column:
    """What stands between the first and second json fence mark, cut at its last fence; other text as it is."""
    part = F.element_at(F.split(content, _FENCE + "json", -1), 2)
    cut = F.when(part.contains(_FENCE), F.regexp_extract(part, r"(?s)^(.*)```", 1)).otherwise(part)
    return F.when(content.contains(_FENCE + "json"), strip(cut)).otherwise(content)


def strip_code_fence(text: Column) -> Column:
    """Without an opening fence at the start and a closing one at the end."""
    return F.regexp_replace(strip(text), r"^```(?:json)?\s*|\s*```$", "")


def unfence_judgement(text: Column) -> Column:
    """A judge's reply without the fences around it, if it begins with one."""
    t = strip(text)
    return F.when(t.startswith(_FENCE), F.regexp_replace(F.regexp_replace(t, r"^```[a-z]*\n?", ""), r"\n?```$", "")).otherwise(t)


def fenced_blocks(text: Column) -> Column:
    """The contents of all closed code fences."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```([a-zA-Z0-9_+\-]*)\n(.*?)```"), F.lit(2))


def wrap_test(body: Column) -> Column:
    """Test statements as the body of ``check()``; tests in the style of pytest stay as they are."""
    wrapped = F.concat(F.lit("def check():\n    "), F.replace(body, F.lit("\n"), F.lit("\n    ")))
    return F.when(is_pytest_style(body), body).otherwise(wrapped)


def is_pytest_style(body: Column) -> Column:
    return F.regexp_like(body, F.lit(r"(?m)^\s*(import pytest\b|from pytest\b|@pytest\.|class\s+Test\w*\s*[:(])"))


def score_bar(score: Column, width: int = 10) -> Column:
    """A bar of ``width`` signs, filled up to the score."""
    filled = F.least(F.greatest(score.cast("int"), F.lit(0)), F.lit(width))
    return F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), F.lit(width) - filled))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """A share as text such as 12.5%."""
    return F.format_string(f"%.{digits}f%%", F.lit(100.0) * part / whole)


def run_stamp(moment: Column) -> Column:
    """The time in the form that names result files."""
    return F.date_format(moment, "dd-MM-yyyy-HH-mm-ss")


def custom_id_index(custom_id: Column, prefix: str = "id_0", offset: int = 1) -> Column:
    """The line a request id stands for: the bare prefix is line 0, a number behind it is itself plus ``offset``; null if it is neither."""
    rest = F.substring(custom_id, len(prefix) + 1, 2**31 - 1 - len(prefix))
    number = F.when(F.regexp_like(rest, F.lit(r"^\d+$")), rest.try_cast("bigint"))
    return F.when(custom_id == prefix, F.lit(0).cast("bigint")).when(custom_id.startswith(prefix), number + offset)


def parse_k_values(text: str) -> list[int]:
    """Distinct positive integers of a comma-separated list, ascending."""
    values = sorted({int(x) for x in text.split(",") if x.strip()})
    if not values or values[0] < 1:
        raise ValueError("k values must be positive")
    return values


#: How a line begins that is code (fixed value).
_CODE_START = re.compile(r"^\s*(?:import\s+\w|from\s+\w+\s+import|def\s+\w|class\s+\w|@\w)")
_BLOCK = re.compile(r"```[a-zA-Z0-9_+\-]*\n(.*?)```", re.S)


def split_text_and_code(content: str) -> tuple[str, str]:
    """Prose and code of a message: closed fences are code; outside them the first line that looks like Python begins code."""
    prose, code, at = [], [], 0

    def outside(chunk: str) -> None:
        lines = chunk.split("\n")
        begin = next((k for k, line in enumerate(lines) if _CODE_START.match(line)), len(lines))
        for target, part in ((prose, lines[:begin]), (code, lines[begin:])):
            joined = "\n".join(part).strip()
            if joined:
                target.append(joined)

    for block in _BLOCK.finditer(content):
        outside(content[at : block.start()])
        if body := block.group(1).strip():
            code.append(body)
        at = block.end()
    outside(content[at:])
    return "\n\n".join(prose), "\n\n".join(code)


def text_and_code(content: Column) -> Column:
    """``struct<text, code>`` of a message; sequential, so a pandas UDF."""

    @F.pandas_udf("struct<text:string,code:string>")
    def split(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([split_text_and_code(t) if t is not None else (None, None) for t in texts], columns=["text", "code"])

    return split(content)


def json_valid(raw: Column) -> Column:
    """Whether a line is JSON by Python's reading (the last of equal keys wins, NaN is a number, nothing may follow)."""

    @F.pandas_udf("boolean")
    def valid(lines: pd.Series) -> pd.Series:
        def one(line: str | None) -> bool | None:
            if line is None:
                return None
            try:
                json.loads(line)
            except (ValueError, RecursionError):
                return False
            return True

        return pd.Series([one(x) for x in lines], dtype=object)

    return valid(raw)


def py_round(value: Column, digits: int) -> Column:
    """Python's rounding (half to even on the exact binary value)."""

    @F.pandas_udf("double")
    def rounded(values: pd.Series) -> pd.Series:
        return values.map(lambda x: round(x, digits), na_action="ignore")

    return rounded(value.cast("double"))
