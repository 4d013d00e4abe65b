"""JSON texts."""

from __future__ import annotations

import re

from dialogforge.llm.syntax.base import Cursor

_TOKEN = re.compile(r'(?P<space>[ \t\r\n]+)|(?P<string>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<number>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<word>true|false|null)\b|(?P<mark>[\[\]{},:])', re.A)


def lex(c: Cursor) -> None:
    text, at, end = c.text, 0, len(c.text)
    if text.startswith("﻿"):
        at = 1
    while at < end:
        m = _TOKEN.match(text, at)
        if m is None:
            c.add("bad", text[at], at)
            at += 1
            continue
        if m.lastgroup != "space":
            c.add(m.group() if m.lastgroup == "mark" else m.lastgroup, m.group(), at)
        at = m.end()
    c.add("eof", "", end)


def parse(text: str) -> list[tuple[int, str]]:
    """All errors. Containers are kept on a stack of their own, so that nesting of any depth is followed."""
    c = Cursor(text)
    lex(c)
    open_: list[str] = []  # "[" or "{" of the containers around
    wanted = "value"  # what must come: value, first (a value or the end of an array), key, first key, colon, or after (a value)
    while True:
        k = c.kind
        if k == "eof":
            if open_ or wanted != "after":
                c.note("unclosed container" if open_ else "expected a value")
            return c.errors
        if not open_ and wanted == "after":
            c.note("text after the value")
            return c.errors
        if wanted in ("value", "first") and k in ("string", "number", "word"):
            c.i, wanted = c.i + 1, "after"
        elif wanted in ("value", "first") and k in ("[", "{"):
            open_.append(k)
            c.i, wanted = c.i + 1, "first" if k == "[" else "first key"
        elif open_ and k == {"[": "]", "{": "}"}[open_[-1]] and wanted in ("first", "first key", "after"):
            open_.pop()
            c.i, wanted = c.i + 1, "after"
        elif wanted in ("key", "first key") and k == "string":
            c.i, wanted = c.i + 1, "colon"
        elif wanted == "colon" and k == ":":
            c.i, wanted = c.i + 1, "value"
        elif wanted == "after" and k == ",":
            c.i, wanted = c.i + 1, "value" if open_[-1] == "[" else "key"
        else:
            c.fail({"first": "expected a value", "first key": "expected a key", "after": "expected ',' or the end"}.get(wanted, f"expected a {wanted}"))
            wanted = _resume(c, open_)


def _resume(c: Cursor, open_: list[str]) -> str:
    """Panic mode: skip to behind the next comma of the container, or to its end; what must come there."""
    level = 0
    while c.kind != "eof":
        k = c.kind
        if k in ("[", "{"):
            level += 1
        elif k in ("]", "}"):
            if not level:
                if open_ and k == {"[": "]", "{": "}"}[open_[-1]]:
                    return "after"  # the end is taken by the loop
            else:
                level -= 1
        elif k == "," and not level and open_:
            c.i += 1
            return "value" if open_[-1] == "[" else "key"
        c.i += 1
    return "after"
