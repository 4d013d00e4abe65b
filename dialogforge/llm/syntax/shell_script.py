"""Bash scripts; words are scanned where the grammar asks for them, as quoting and substitutions nest."""

from __future__ import annotations

import re

from dialogforge.llm.syntax.base import MAX_DEPTH, Stop, Unjudged

_OPERATOR = re.compile(r"&&|\|\||;;&|;;|;&|\|&|<<<|<<-|<<|&>>|&>|>>|>&|<&|<>|>\||[;&|()<>]")
_REDIRECT = frozenset(["<", ">", ">>", "<<", "<<-", "<<<", ">&", "<&", "<>", ">|", "&>", "&>>"])
_RESERVED = frozenset("if then elif else fi for while until do done case esac select function time { } ! [[ in".split())
_CLOSING = frozenset(["then", "elif", "else", "fi", "do", "done", "esac", "}"])
_PLAIN = re.compile(r"[^\s\"'`$\;&|()<>]+")
_ASSIGNMENT = re.compile(r"[^\W\d]\w*(?:\[[^\]]*\])?\+?=$")
_DESCRIPTOR = re.compile(r"\d+|\{\w+\}")
_NAME = re.compile(r"[^\W\d][\w-]*$")


class _Parser:
    def __init__(self, text: str) -> None:
        self.text, self.end = text.replace("\r\n", "\n"), len(text.replace("\r\n", "\n"))
        self.at = 0
        self.errors: list[tuple[int, str]] = []
        self.heredocs: list[tuple[str, bool]] = []
        self.depth = 0
        # The token ahead: kind "word", "newline", "eof" or the operator; a reserved word is a plain word at a command's place.
        self.kind = self.value = ""
        self.plain = False
        self.start = 0
        self.advance()

    def fail(self, message: str) -> Stop:
        self.errors.append((self.start, f"{message} at {self.value or self.kind!r}"))
        return Stop()

    # Scanning.

    def advance(self) -> None:
        text, end = self.text, self.end
        while self.at < end:
            ch = text[self.at]
            if ch in " \t\r":
                self.at += 1
            elif ch == "\\" and text[self.at + 1 : self.at + 2] == "\n":
                self.at += 2
            elif ch == "#":
                stop = text.find("\n", self.at)
                self.at = end if stop < 0 else stop
            else:
                break
        self.start = self.at
        if self.at >= end:
            self.kind, self.value, self.plain = "eof", "", False
            return
        if text[self.at] == "\n":
            self.at += 1
            self.skip_heredocs()
            self.kind, self.value, self.plain = "newline", "", False
            return
        m = _OPERATOR.match(text, self.at)
        if m is not None and not (m.group() in ("<", ">") and text[self.at + 1 : self.at + 2] == "("):
            self.at = m.end()
            self.kind, self.value, self.plain = m.group(), m.group(), False
            return
        self.plain = True
        self.word()
        self.kind, self.value = "word", text[self.start : self.at]

    def skip_heredocs(self) -> None:
        for delimiter, dashed in self.heredocs:
            while self.at < self.end:
                stop = self.text.find("\n", self.at)
                stop = self.end if stop < 0 else stop
                line = self.text[self.at : stop]
                self.at = min(self.end, stop + 1)
                if (line.lstrip("\t") if dashed else line) == delimiter:
                    break
        self.heredocs = []

    def word(self) -> None:
        text, end = self.text, self.end
        begin = self.at
        while self.at < end:
            ch = text[self.at]
            if (m := _PLAIN.match(text, self.at)) is not None:
                self.at = m.end()
            elif ch == "\\":
                self.plain = False
                self.at += 2
            elif ch == "'":
                self.plain = False
                self.single()
            elif ch == '"':
                self.plain = False
                self.double()
            elif ch == "`":
                self.plain = False
                self.backquoted()
            elif ch == "$":
                self.dollar(False)
            elif ch in "<>" and text[self.at + 1 : self.at + 2] == "(" and (self.at == begin or text[self.at - 1] not in "<>"):
                self.at += 2
                self.substitution()
            elif ch == "(" and _ASSIGNMENT.match(text[begin : self.at]):
                self.at += 1
                self.array()
            elif ch == "(" and self.at > begin and text[self.at - 1] in "?*+@!" and self.plain:
                self.at += 1
                self.extended()
            else:
                break
        self.at = min(self.at, end)

    def single(self) -> None:
        stop = self.text.find("'", self.at + 1)
        if stop < 0:
            self.at = self.end
            raise self.fail("unclosed quote")
        self.at = stop + 1

    def double(self) -> None:
        self.at += 1
        while self.at < self.end:
            ch = self.text[self.at]
            if ch == '"':
                self.at += 1
                return
            if ch == "\\":
                self.at += 2
            elif ch == "$":
                self.dollar(True)
            elif ch == "`":
                self.backquoted()
            else:
                self.at += 1
        self.at = self.end
        raise self.fail("unclosed quote")

    def backquoted(self) -> None:
        self.at += 1
        while self.at < self.end:  # what is within is read when it runs, as bash does
            ch = self.text[self.at]
            self.at += 2 if ch == "\\" else 1
            if ch == "`":
                return
        self.at = self.end
        raise self.fail("unclosed back quote")

    def dollar(self, quoted: bool) -> None:
        follow = self.text[self.at + 1 : self.at + 2]
        if follow == "(":
            self.plain = False
            if self.text[self.at + 2 : self.at + 3] == "(" and self.arithmetic(self.at + 1):
                return
            self.at += 2
            self.substitution()
        elif follow == "{":
            self.plain = False
            self.at += 2
            self.braced()
        elif follow == "'" and not quoted:
            self.plain = False
            self.at += 2
            while self.at < self.end and self.text[self.at] != "'":
                self.at += 2 if self.text[self.at] == "\\" else 1
            if self.at >= self.end:
                raise self.fail("unclosed quote")
            self.at += 1
        else:
            self.at += 1

    def arithmetic(self, at: int) -> bool:
        """((...)) from ``at``, whose brackets must close together."""
        level, j = 0, at
        while j < self.end:
            ch = self.text[j]
            if ch == "(":
                level += 1
            elif ch == ")":
                level -= 1
                if level == 1 and self.text[j + 1 : j + 2] == ")":
                    self.at = j + 2
                    return True
                if level < 1:
                    return False
            elif ch == "\n" and level == 0:
                return False
            j += 1
        return False

    def braced(self) -> None:
        while self.at < self.end:
            ch = self.text[self.at]
            if ch == "}":
                self.at += 1
                return
            if ch == "\\":
                self.at += 2
            elif ch == "'":
                stop = self.text.find("'", self.at + 1)
                self.at = stop + 1 if stop > 0 else self.at + 1
            elif ch == '"':
                self.double()
            elif ch == "`":
                self.backquoted()
            elif ch == "$":
                self.dollar(True)
            else:
                self.at += 1
        raise self.fail("unclosed '${'")

    def substitution(self) -> None:
        """A command list up to ")"; the token ahead and the word in hand are kept."""
        kept = self.kind, self.value, self.start, self.heredocs, self.plain
        self.heredocs = []
        self.enter()
        self.advance()
        self.list(frozenset([")"]))
        if self.kind != ")":
            raise self.fail("expected ')'")
        self.depth -= 1
        self.kind, self.value, self.start, self.heredocs, _ = kept
        self.plain = False

    def array(self) -> None:
        kept = self.kind, self.value, self.start
        self.advance()
        while self.kind in ("word", "newline"):
            self.advance()
        if self.kind != ")":
            raise self.fail("expected ')'")
        self.kind, self.value, self.start = kept
        self.plain = False

    def extended(self) -> None:
        level = 1
        while self.at < self.end and level:
            ch = self.text[self.at]
            level += (ch == "(") - (ch == ")")
            self.at += 1
        if level:
            raise self.fail("expected ')'")

    def enter(self) -> None:
        self.depth += 1
        if self.depth > MAX_DEPTH:
            raise Unjudged(self.errors)

    # Grammar.

    def reserved(self) -> str:
        return self.value if self.kind == "word" and self.plain and self.value in _RESERVED else ""

    def need_word(self, word: str) -> None:
        if self.reserved() != word:
            raise self.fail(f"expected {word!r}")
        self.advance()

    def newlines(self) -> None:
        while self.kind == "newline":
            self.advance()

    def script(self) -> None:
        while True:
            self.newlines()
            if self.kind == "eof":
                return
            begin = self.at
            try:
                self.list(frozenset(), one=True)
                if self.kind not in ("newline", "eof"):
                    raise self.fail("unexpected token")
            except Stop:  # panic mode: take up on the next line
                self.depth, self.heredocs = 0, []
                self.at = max(self.at, begin)
                stop = self.text.find("\n", self.at)
                self.at = self.end if stop < 0 else stop
                self.kind = ""
                while True:
                    try:
                        self.advance()
                        break
                    except Stop:
                        continue

    def list(self, ends: frozenset[str], one: bool = False) -> None:
        """Pipelines up to an operator in ``ends`` or a closing reserved word; at least one."""
        count = 0
        while True:
            if not one or count == 0:
                self.newlines()
            if self.kind in ends or self.kind == "eof" or self.reserved() in _CLOSING:
                break
            self.and_or()
            count += 1
            if self.kind in (";", "&"):
                self.advance()
                if one and self.kind in ("newline", "eof"):
                    return
            elif self.kind == "newline":
                if one:
                    return
            else:
                break
        if not count and ")" not in ends:
            raise self.fail("expected a command")

    def and_or(self) -> None:
        self.pipeline()
        while self.kind in ("&&", "||"):
            self.advance()
            self.newlines()
            self.pipeline()

    def pipeline(self) -> None:
        while self.reserved() in ("!", "time"):
            self.advance()
        self.command()
        while self.kind in ("|", "|&"):
            self.advance()
            self.newlines()
            self.command()

    def command(self) -> None:
        self.enter()
        word = self.reserved()
        compound = True
        if word == "if":
            self.advance()
            self.list(frozenset())
            self.need_word("then")
            self.list(frozenset())
            while self.reserved() == "elif":
                self.advance()
                self.list(frozenset())
                self.need_word("then")
                self.list(frozenset())
            if self.reserved() == "else":
                self.advance()
                self.list(frozenset())
            self.need_word("fi")
        elif word in ("while", "until"):
            self.advance()
            self.list(frozenset())
            self.do()
        elif word in ("for", "select"):
            self.for_()
        elif word == "case":
            self.case()
        elif word == "{":
            self.advance()
            self.list(frozenset())
            self.need_word("}")
        elif word == "[[":
            self.test()
        elif self.kind == "word" and self.plain and self.value == "coproc":
            self.advance()
            if self.kind == "word" and self.plain and not self.reserved() and _NAME.match(self.value) and self.text[self.at :].lstrip(" \t")[:1] in ("{", "("):
                self.advance()
            self.command()
            compound = False
        elif word == "function":
            self.advance()
            if self.kind != "word":
                raise self.fail("expected a name")
            self.advance()
            if self.kind == "(":
                self.advance()
                self.need_operator(")")
            self.newlines()
            self.command()
            compound = False
        elif self.kind == "(":
            if self.text[self.at : self.at + 1] == "(" and self.arithmetic(self.at - 1):
                self.advance()
            else:
                self.advance()
                self.list(frozenset([")"]))
                self.need_operator(")")
        elif word in _CLOSING:
            raise self.fail("unexpected word")
        else:
            compound = False
            self.simple()
        if compound:
            self.redirects()
        self.depth -= 1

    def need_operator(self, operator: str) -> None:
        if self.kind != operator:
            raise self.fail(f"expected {operator!r}")
        self.advance()

    def do(self) -> None:
        self.need_word("do")
        self.list(frozenset())
        self.need_word("done")

    def for_(self) -> None:
        self.advance()
        if self.kind == "(" and self.text[self.at : self.at + 1] == "(" and self.arithmetic(self.at - 1):
            self.advance()
        else:
            if self.kind != "word":  # whether it is a name is found out when it runs
                raise self.fail("expected a name")
            self.advance()
            self.newlines()
            if self.kind == "word" and self.value == "in":
                self.advance()
                while self.kind == "word":
                    self.advance()
                if self.kind not in (";", "newline"):
                    raise self.fail("expected ';'")
        if self.kind == ";":
            self.advance()
        self.newlines()
        if self.reserved() == "{":
            self.command()
        else:
            self.do()

    def case(self) -> None:
        self.advance()
        if self.kind != "word":
            raise self.fail("expected a word")
        self.advance()
        self.newlines()
        self.need_word("in")
        self.newlines()
        while self.reserved() != "esac":
            if self.kind == "(":
                self.advance()
            while True:
                if self.kind != "word":
                    raise self.fail("expected a pattern")
                self.advance()
                if self.kind != "|":
                    break
                self.advance()
            self.need_operator(")")
            self.newlines()
            if self.kind not in (";;", ";&", ";;&") and self.reserved() != "esac":
                self.list(frozenset([";;", ";&", ";;&"]))
            if self.kind in (";;", ";&", ";;&"):
                self.advance()
                self.newlines()
            elif self.reserved() != "esac":
                raise self.fail("expected ';;'")
        self.advance()

    def test(self) -> None:
        self.advance()
        count = 0
        while not (self.kind == "word" and self.value == "]]"):
            if self.kind in ("eof", ";", "&"):
                raise self.fail("expected ']]'")
            self.advance()
            count += 1
        if not count:
            raise self.fail("expected a condition")
        self.advance()

    def redirect(self) -> bool:
        if self.kind not in _REDIRECT:
            return False
        operator = self.kind
        self.advance()
        if self.kind != "word":
            raise self.fail("expected a word")
        if operator in ("<<", "<<-"):
            self.heredocs.append((re.sub(r"[\"'\\]", "", self.value), operator == "<<-"))

        self.advance()
        return True

    def redirects(self) -> None:
        """Redirections behind a compound command, each perhaps with the number or the name of its descriptor."""
        while True:
            if self.kind == "word" and _DESCRIPTOR.fullmatch(self.value) and self.text[self.at : self.at + 1] in ("<", ">"):
                self.advance()
            if not self.redirect():
                return

    def simple(self) -> None:
        count, first, plain = 0, "", False
        while True:
            if self.kind == "word":
                if count == 0:
                    first, plain = self.value, self.plain
                count += 1
                self.advance()
                if self.kind == "(" and count == 1:
                    if not plain or _ASSIGNMENT.match(first):
                        raise self.fail("unexpected '('")
                    self.advance()
                    self.need_operator(")")
                    self.newlines()
                    if self.reserved() not in ("{", "if", "while", "until", "for", "case", "[[", "select") and self.kind != "(":
                        raise self.fail("expected a body")
                    self.command()
                    return
            elif self.kind in _REDIRECT:
                count += 1
                self.redirect()
            else:
                break
        if not count:
            raise self.fail("expected a command")


def parse(text: str) -> list[tuple[int, str]]:
    try:
        c = _Parser(text)
    except Stop:
        return [(0, "unclosed quote or substitution")]
    try:
        c.script()
    except Stop:
        pass
    return c.errors
