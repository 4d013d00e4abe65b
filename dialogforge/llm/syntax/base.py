"""What the recursive-descent parsers share: a token cursor, error records and panic-mode recovery."""

from __future__ import annotations

import re

#: Nesting that a parser follows. What lies deeper is not judged; the errors found before it count.
MAX_DEPTH = 20_000
_AHEAD = 8  # ends of the text that parsers may look at behind the last token
CONFLICT = re.compile(r"^(?:<{7}|>{7}|\|{7})(?: |$)", re.M)


class Stop(Exception):
    """Leaves the construct in which an error was found; the statement loop recovers."""


class Unjudged(Exception):
    """A text is nested deeper than the parsers follow; ``args[0]`` holds the errors found before."""


class Cursor:
    """Tokens as parallel lists: ``kinds`` (a keyword's or operator's own text, or a class such as "name"), ``values``, ``places``.

    Parsers advance ``i``; every list ends with some "eof".
    """

    def __init__(self, text: str) -> None:
        self.text = text
        self.kinds: list[str] = []
        self.values: list[str] = []
        self.places: list[int] = []
        self.errors: list[tuple[int, str]] = []
        self.i = 0
        self.depth = 0

    def add(self, kind: str, value: str, place: int) -> None:
        for _ in range(_AHEAD if kind == "eof" else 1):
            self.kinds.append(kind)
            self.values.append(value)
            self.places.append(place)

    @property
    def kind(self) -> str:
        return self.kinds[self.i]

    def note(self, message: str, place: int | None = None) -> None:
        self.errors.append((self.places[min(self.i, len(self.places) - 1)] if place is None else place, message))

    def fail(self, message: str) -> Stop:
        """Record an error here; the caller raises what this returns."""
        self.note(f"{message} at {self.kind!r}")
        return Stop()

    def take(self, kind: str) -> bool:
        if self.kinds[self.i] == kind:
            self.i += 1
            return True
        return False

    def need(self, kind: str) -> None:
        if self.kinds[self.i] != kind:
            raise self.fail(f"expected {kind!r}")
        self.i += 1

    def enter(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Unjudged(self.errors)

    def leave(self) -> None:
        self.depth -= 1

    def recover(self, begin: int, stops: tuple[str, ...]) -> None:
        """Panic mode: skip to behind the next token in ``stops``, at least one token further than ``begin``."""
        self.depth = 0
        if self.i <= begin:
            self.i = begin
            if self.kind != "eof":
                self.i += 1
        while self.kind != "eof":
            k = self.kind
            self.i += 1
            if k in stops:
                break


def cause_of(text: str, errors: list[tuple[int, str]]) -> str:
    """The first cause: a merge conflict if its marks begin a line, else the first error's message."""
    if CONFLICT.search(text):
        return "merge conflict"
    return errors[0][1] if errors else ""
