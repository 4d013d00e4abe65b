"""Recursive-descent parsers with precedence-climbing expressions and panic-mode recovery, one for each language.

Each has ``parse(text)``, which returns all errors as (place, message), none for a valid text.
"""

from __future__ import annotations

import sys

from dialogforge.llm.syntax import go_file, java_unit, javascript, json_text, python_module, shell_script, sql_script
from dialogforge.llm.syntax.base import Unjudged, cause_of

UNJUDGED = "nested too deeply to judge"
#: File extension -> (language, parser).
LANGUAGES = {
    "py": ("python", python_module.parse),
    "js": ("javascript", javascript.parse),
    "java": ("java", java_unit.parse),
    "go": ("go", go_file.parse),
    "sql": ("sql", sql_script.parse),
    "json": ("json", json_text.parse),
    "sh": ("shell", shell_script.parse),
}


def errors_of(extension: str, text: str) -> tuple[list[tuple[int, str]], str]:
    """All errors of a text and the first cause: "" for a valid text, ``UNJUDGED`` without errors for one that is nested too deeply."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 2_000_000))
    try:
        errors = LANGUAGES[extension][1](text)
    except Unjudged as deep:
        errors = deep.args[0]
        if not errors:
            return [], UNJUDGED
    return errors, cause_of(text, errors) if errors else ""
