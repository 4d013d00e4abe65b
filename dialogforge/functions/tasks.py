"""The task dimension: codes, names, tiers and evaluators, and the ways to find a task's code in free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values, in matching order: code, name, tier, evaluators.
TASKS = [
    ("CCM", "Code Context Memory", "Code State Awareness", ["judge"]),
    ("CRR", "Code Reference Resolution", "Code State Awareness", ["judge"]),
    ("CIM", "Code Interference Management", "Code State Awareness", ["judge"]),
    ("CCA", "Code Comprehension & Analysis", "Code State Awareness", ["judge"]),
    ("SCR", "Semantic Code Rewriting", "Iterative Code Evolution", ["code", "judge"]),
    ("SCF", "Structural Code Reformatting", "Iterative Code Evolution", ["code", "judge"]),
    ("DRC", "Debugging Reflection & Correction", "Iterative Code Evolution", ["code", "judge"]),
    ("ISR", "Incremental Specification Refinement", "Iterative Code Evolution", ["code", "judge"]),
    ("PEG", "Proactive Engineering Guidance", "Interaction & Analysis", ["judge"]),
    ("CD", "Correctness Defense", "Interaction & Analysis", ["judge"]),
    ("MPR", "Multi-Turn Program Reasoning", "Interaction & Analysis", ["judge"]),
]


def task_table(spark: SparkSession) -> DataFrame:
    """``ord, code, name, tier, evaluators``: eleven rows."""
    return spark.createDataFrame([(k + 1, *t) for k, t in enumerate(TASKS)], "ord int, code string, name string, tier string, evaluators array<string>")


def _first(*tests: tuple[Column, str]) -> Column:
    return F.coalesce(*[F.when(test, F.lit(code)) for test, code in tests])


def strict_task_code(text: Column) -> Column:
    """The first code, then the first name, that the text holds, letter for letter; null if none."""
    return _first(*[(text.contains(code), code) for code, *_ in TASKS], *[(text.contains(name), code) for code, name, *_ in TASKS])


def loose_task_code(text: Column) -> Column:
    """As the strict one on upper-cased text with blanks for underscores and hyphens.

    A code inside a word counts (COMPREHENSION holds MPR) and a name with a hyphen never matches: this is the loose rule as it is defined.
    """
    upper = F.regexp_replace(F.upper(text), "[ _-]", " ")
    return _first(*[(upper.contains(code), code) for code, *_ in TASKS], *[(upper.contains(name.upper()), code) for code, name, *_ in TASKS])


def task_code(text: Column) -> Column:
    """The intended reading: a code as a whole word in any case, or a name with "and" for "&" and any separators."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.upper(text), "&", " AND "), "[^A-Z0-9]+", " "))
    names = [(" ".join(name.upper().replace("&", " AND ").replace("-", " ").split()), code) for code, name, *_ in TASKS]
    return _first(*[(F.regexp_like(plain, F.lit(rf"\b{code}\b")), code) for code, *_ in TASKS], *[(plain.contains(name), code) for name, code in names])


def evaluators_of(code: Column, code_only: bool = False) -> Column:
    """The evaluators of a task, null for an unknown one; ``code_only`` leaves out the judge."""
    lists = [([e for e in ev if e == "code"] if code_only else ev, c) for c, _, _, ev in TASKS]
    return F.coalesce(*[F.when(code == c, F.array(*[F.lit(e) for e in ev]).cast("array<string>")) for ev, c in lists])
