"""Python 3 modules."""

from __future__ import annotations

import re

from dialogforge.llm.syntax.base import Cursor, Stop

_KEYWORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
_TOKEN = re.compile(
    r"""(?P<space>[ \t\f]+|\\\r?\n)|(?P<comment>\#[^\n]*)|(?P<newline>\r?\n|\r)"""
    r"""|(?P<string>(?:[rRuUbBfF]|[bBfF][rR]|[rR][bBfF])?(?:\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?!"")(?:[^"\\\n]|\\.)*"|'(?!'')(?:[^'\\\n]|\\.)*'))"""
    r"""|(?P<number>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))"""
    r"""|(?P<name>[^\W\d]\w*)|(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|\*\*|//|>>|<<|[-+*/%@&|^<>=!]=|[-+*/%@&|^~<>=()\[\]{},:.;])""",
    re.S,
)
_ZEROS = re.compile(r"0[0-9_]*[1-9]")
_AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_BINARY = {"or": 1, "and": 2, "in": 4, "not": 4, "is": 4, "<": 4, ">": 4, "==": 4, ">=": 4, "<=": 4, "!=": 4, "|": 5, "^": 6, "&": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "//": 10, "%": 10, "@": 10}
_ENDS = frozenset(["newline", ";", "eof", ")", "]", "}", ":", "=", ",", "in"])
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")
_AFTER_NUMBER = frozenset(["and", "else", "for", "if", "in", "is", "not", "or"])


_FORMATTED = re.compile(r"""(?:[fF][rR]?|[rR][fF])(\"\"\"|'''|"|')""")
_QUOTED = re.compile(r"""\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?!"")(?:[^"\\\n]|\\.)*"|'(?!'')(?:[^'\\\n]|\\.)*'""", re.S)
_NO_EXPRESSION = re.compile(r"\{\s*[}!:=]")


def _formatted_end(text: str, at: int, fields: list[str] | None = None) -> int:
    """Behind the f-string that begins at ``at``, whose fields may hold quotes of their own; -1 if it is broken.

    fields: takes the expressions of its fields.
    """
    begin = -1
    m = _FORMATTED.match(text, at)
    quote, i, end, depth = m[1], m.end(), len(text), 0
    while i < end:
        ch = text[i]
        if depth == 0:
            if text.startswith(quote, i):
                return i + len(quote)
            if ch == "\\" or text[i : i + 2] in ("{{", "}}"):
                i += 2
                continue
            if ch == "}" or ch == "\n" and len(quote) == 1 or ch == "{" and _NO_EXPRESSION.match(text, i):
                return -1
            if ch == "{":
                depth, begin = 1, i + 1
        elif ch in "([{":
            depth += 1
        elif ch in ")]}":
            depth -= 1
            if not depth and begin >= 0 and fields is not None:
                fields.append(text[begin:i])
        elif ch in "'\"":
            if text[i - 1] in "fF":
                i = _formatted_end(text, i - 1)
                if i < 0:
                    return -1
            elif (inner := _QUOTED.match(text, i)) is not None:
                i = inner.end()
            else:
                return -1
            continue
        elif ch == ":" and depth == 1:  # a format, which may hold fields but no strings
            level = 0
            if begin >= 0 and fields is not None:
                fields.append(text[begin:i])
            begin = -1
            while i < end and not (text[i] == "}" and level == 0):
                if text.startswith(quote, i) or text[i] == "\n" and len(quote) == 1:
                    return -1
                level += (text[i] == "{") - (text[i] == "}")
                i += 1
            continue
        i += 1
    return -1


_PLAIN_FIELD = re.compile(r"\s*[^\W\d]\w*(?:\.[^\W\d]\w*)*\s*")
_FIELD_END = re.compile(r"(?:(?<![=!<>])=\s*)?(?:![rsa]\s*)?\Z")


def _broken_field(expression: str) -> bool:
    """Whether what stands in a field of an f-string, perhaps with ``=`` and a conversion, is no expression."""
    if _PLAIN_FIELD.fullmatch(expression) and expression.strip() not in _KEYWORDS:
        return False
    return bool(parse(f"({_FIELD_END.sub('', expression)}\n)\n"))


def lex(c: Cursor) -> None:
    text, at, end = c.text.removeprefix("﻿"), 0, 0
    end = len(text)
    indents, depth, line_start = [0], 0, True
    add, match = c.add, _TOKEN.match
    while at < end:
        if line_start and depth == 0:
            column, j = 0, at
            while j < end and text[j] in " \t\f":
                column = (column // 8 + 1) * 8 if text[j] == "\t" else column + 1 if text[j] == " " else 0
                j += 1
            if j >= end or text[j] in "\r\n#":
                m = match(text, j) if j < end else None
                at = m.end() if m else end
                if m and m.lastgroup == "comment" and at < end:
                    at = match(text, at).end()
                continue
            line_start = False
            if column > indents[-1]:
                indents.append(column)
                add("indent", "", j)
            while column < indents[-1]:
                indents.pop()
                add("dedent", "", j)
                if column > indents[-1]:
                    add("bad", "dedent", j)
                    indents.append(column)
                    break
            at = j
        if text[at] in "fFrR" and _FORMATTED.match(text, at) is not None:
            fields: list[str] = []
            stop = _formatted_end(text, at, fields)
            add("string" if stop > 0 and not any(map(_broken_field, fields)) else "bad", "f-string", at)
            at = stop if stop > 0 else at + 2
            continue
        m = match(text, at)
        if m is None:
            add("bad", text[at], at)
            at += 1
            continue
        group = m.lastgroup
        if group == "name":
            value = m.group()
            add(value if value in _KEYWORDS else "name", value, at)
        elif group == "op":
            value = m.group()
            if value in _OPEN:
                depth += 1
            elif value in _CLOSE and depth:
                depth -= 1
            add(value, value, at)
        elif group == "newline":
            if depth == 0:
                add("newline", "", at)
                line_start = True
        elif group == "string":
            prefix = m.group()[: re.match(r"\w*", m.group()).end()].lower()
            add("bad" if "b" in prefix and not m.group().isascii() else "string", "b" if "b" in prefix else "", at)
        elif group == "number":
            value = m.group()
            follow = re.match(r"[^\W\d]\w*", text[m.end() : m.end() + 12])
            if _ZEROS.fullmatch(value) or follow and follow.group() not in _AFTER_NUMBER:
                add("bad", value, at)
            else:
                add("number", value, at)
        at = m.end()
    if c.kinds and c.kinds[-1] != "newline":
        add("newline", "", end)
    for _ in indents[1:]:
        add("dedent", "", end)
    add("eof", "", end)


class _Parser(Cursor):
    # Expressions return 2 for a single target (name, attribute, subscript), 1 for a group of targets, 0 for no target.

    def expression(self) -> int:
        """A conditional expression or lambda."""
        self.enter()
        if self.kinds[self.i] == "lambda":
            self.i += 1
            self.parameters(":", annotated=False)
            self.need(":")
            self.expression()
            result = 0
        else:
            result = self.binary(1)
            if self.kinds[self.i] == "if":
                self.i += 1
                self.binary(1)
                self.need("else")
                self.expression()
                result = 0
        self.leave()
        return result

    def named(self) -> int:
        if self.kinds[self.i] == "name" and self.kinds[self.i + 1] == ":=":
            self.i += 2
            self.expression()
            return 0
        return self.expression()

    def binary(self, least: int) -> int:
        """Precedence climbing."""
        k = self.kinds[self.i]
        if k == "not":
            if least > 3:
                raise self.fail("misplaced operator")
            self.i += 1
            self.binary(3)
            left = 0
        else:
            left = self.unary()
        while True:
            k = self.kinds[self.i]
            level = _BINARY.get(k)
            if level is None or level < least:
                return left
            if k == "not":
                if self.kinds[self.i + 1] != "in":
                    return left
                self.i += 1
            elif k == "is" and self.kinds[self.i + 1] == "not":
                self.i += 1
            self.i += 1
            self.binary(level + 1)
            left = 0

    def unary(self) -> int:
        k = self.kinds[self.i]
        if k in ("-", "+", "~"):
            self.enter()
            self.i += 1
            self.unary()
            self.leave()
            return 0
        result = 0
        if k == "await":
            self.i += 1
            self.primary()
        else:
            result = self.primary()
        if self.kinds[self.i] == "**":
            self.i += 1
            self.enter()
            self.unary()
            self.leave()
            return 0
        return result

    def primary(self) -> int:
        result = self.atom()
        kinds = self.kinds
        while True:
            k = kinds[self.i]
            if k == ".":
                self.i += 1
                self.need("name")
                result = 2
            elif k == "(":
                self.i += 1
                self.arguments()
                result = 0
            elif k == "[":
                self.i += 1
                self.slices()
                result = 2
            else:
                return result

    def atom(self) -> int:
        k = self.kinds[self.i]
        if k == "name":
            self.i += 1
            return 2
        if k == "string":
            first = self.values[self.i] == "b"
            while self.kinds[self.i] == "string":
                if (self.values[self.i] == "b") != first:
                    raise self.fail("bytes beside text")
                self.i += 1
            return 0
        if k in ("number", "None", "True", "False", "..."):
            self.i += 1
            return 0
        if k == "(":
            self.i += 1
            if self.take(")"):
                return 1
            if self.kinds[self.i] == "yield":
                self.yielded()
                self.need(")")
                return 0
            result, comma = self.items(")")
            return result if comma else (2 if result == 2 else result)
        if k == "[":
            self.i += 1
            if self.take("]"):
                return 1
            result, _ = self.items("]")
            return 1 if result else 0
        if k == "{":
            self.i += 1
            self.braces()
            return 0
        raise self.fail("expected an expression")

    def items(self, close: str) -> tuple[int, bool]:
        """What stands in parentheses or brackets: a comprehension or a list; (target class, whether a comma was seen)."""
        result = self.starred()
        star = self.was_star
        if self.kinds[self.i] in ("for", "async"):
            if star:
                raise self.fail("unpacking in a comprehension")
            self.comprehension()
            self.need(close)
            return 0, False
        comma = False
        while self.take(","):
            comma = True
            if self.kinds[self.i] == close:
                break
            result = min(1, result, self.starred())
        if star and not comma and close == ")":
            raise self.fail("unpacking without a list")
        self.need(close)
        return (min(1, result) if comma else result), comma

    was_star = False

    def starred(self) -> int:
        self.was_star = False
        if self.kinds[self.i] == "*":
            self.i += 1
            result = min(1, self.binary(5))
            self.was_star = True
            return result
        result = self.named()
        self.was_star = False
        return result

    def comprehension(self) -> None:
        while self.kinds[self.i] in ("for", "async"):
            self.take("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.binary(1)
            while self.take("if"):
                if self.kinds[self.i] == "name" and self.kinds[self.i + 1] == ":=":
                    self.i += 2
                self.binary(1)

    def targets(self) -> None:
        """Targets before ``in``."""
        while True:
            self.take("*")
            if not self.binary(5):
                raise self.fail("no target")
            if not self.take(",") or self.kinds[self.i] == "in":
                return

    def braces(self) -> None:
        if self.take("}"):
            return
        if self.take("**"):
            self.binary(5)
            mapping = True
        else:
            self.starred()
            mapping = self.kinds[self.i] == ":"
            if mapping:
                self.i += 1
                self.expression()
        if self.kinds[self.i] in ("for", "async"):
            self.comprehension()
            self.need("}")
            return
        while self.take(","):
            if self.kinds[self.i] == "}":
                break
            if mapping:
                if self.take("**"):
                    self.binary(5)
                else:
                    self.expression()
                    self.need(":")
                    self.expression()
            else:
                self.starred()
        self.need("}")

    def arguments(self) -> None:
        keyword, unpacked, begin = False, False, self.i
        while not self.take(")"):
            k, at = self.kinds[self.i], self.i
            if k == "*":
                self.i += 1
                self.expression()
                if unpacked:
                    raise self.fail("argument order")
            elif k == "**":
                self.i += 1
                self.expression()
                unpacked = True
            elif k == "name" and self.kinds[self.i + 1] == "=":
                self.i += 2
                self.expression()
                keyword = True
            else:
                self.named()
                if self.kinds[self.i] in ("for", "async"):
                    self.comprehension()
                    if at != begin or self.kinds[self.i] == ",":
                        raise self.fail("generator beside other arguments")
                elif keyword or unpacked:
                    raise self.fail("argument order")
            if not self.take(","):
                self.need(")")
                return

    def slices(self) -> None:
        while True:
            if self.kinds[self.i] == "*":
                self.starred()
            else:
                if self.kinds[self.i] != ":":
                    self.named()
                for _ in range(2):
                    if self.take(":") and self.kinds[self.i] not in (":", ",", "]"):
                        self.expression()
            if not self.take(","):
                break
            if self.kinds[self.i] == "]":
                break
        self.need("]")

    def expressions(self) -> int:
        """A list of expressions without parentheses."""
        result = self.starred()
        star = self.was_star
        comma = False
        while self.take(","):
            comma = True
            if self.kinds[self.i] in _ENDS or self.kinds[self.i] in _AUGMENTED:
                break
            result = min(1, result, self.starred())
        if star and not comma:
            self.lonely_star = True
        return min(1, result) if comma else result

    lonely_star = False

    def yielded(self) -> None:
        self.need("yield")
        if self.take("from"):
            self.expression()
        elif self.kinds[self.i] not in _ENDS:
            self.expressions()

    def value(self) -> int:
        if self.kinds[self.i] == "yield":
            self.yielded()
            return 0
        return self.expressions()

    def parameters(self, close: str, annotated: bool) -> None:
        default = star = False
        first = True
        while self.kinds[self.i] != close:
            if self.take("/"):
                if first or star:
                    raise self.fail("parameter order")
            elif self.take("**"):
                self.need("name")
                if annotated and self.take(":"):
                    self.expression()
                self.take(",")
                if self.kinds[self.i] != close:
                    raise self.fail("parameter order")
                return
            elif self.take("*"):
                if star:
                    raise self.fail("parameter order")
                star = True
                if self.take("name"):
                    if annotated and self.take(":"):
                        self.starred()
                elif self.kinds[self.i] != "," or self.kinds[self.i + 1] in (close, "**"):
                    raise self.fail("parameter order")
            else:
                self.need("name")
                if annotated and self.take(":"):
                    self.expression()
                if self.take("="):
                    self.expression()
                    default = True
                elif default and not star:
                    raise self.fail("parameter without default")
            first = False
            if not self.take(","):
                return

    # Statements.

    def file(self) -> None:
        self.statements(("eof",))

    def statements(self, ends: tuple[str, ...]) -> None:
        while self.kinds[self.i] not in ends:
            begin, depth = self.i, self.depth
            try:
                self.statement()
            except Stop:
                self.depth = depth
                self.skip(begin)
            if self.kinds[self.i] == "eof":
                return

    def skip(self, begin: int) -> None:
        """Panic mode: to the next line at this level."""
        if self.i <= begin:
            self.i = begin + (self.kinds[begin] != "eof")
        level = 0
        while self.kinds[self.i] != "eof":
            k = self.kinds[self.i]
            if k == "dedent" and level == 0:
                return
            level += (k == "indent") - (k == "dedent")
            self.i += 1
            if k == "newline" and level == 0 and self.kinds[self.i] != "indent":
                return

    def block(self) -> None:
        self.need(":")
        if self.take("newline"):
            if self.kinds[self.i] != "indent":
                raise self.fail("expected an indented block")
            self.i += 1
            self.enter()
            self.statements(("dedent", "eof"))
            self.leave()
            self.take("dedent")
        else:
            self.simple()

    def simple(self) -> None:
        while True:
            self.small()
            if self.take(";"):
                if self.take("newline"):
                    return
                continue
            self.need("newline")
            return

    def statement(self) -> None:
        k = self.kinds[self.i]
        compound = getattr(self, "do_" + k, None) if k.isalpha() else None
        if compound is not None:
            self.i += 1
            compound()
        elif k == "@":
            while self.take("@"):
                self.named()
                self.need("newline")
            self.take("async")
            if self.kinds[self.i] not in ("def", "class"):
                raise self.fail("expected a definition")
            self.statement()
        elif k == "async":
            self.i += 1
            if self.kinds[self.i] not in ("def", "for", "with"):
                raise self.fail("expected def, for or with")
            self.statement()
        elif k == "indent":
            self.i += 1
            self.note("unexpected indent")
            self.statements(("dedent", "eof"))
            self.take("dedent")
        elif k == "name" and self.values[self.i] == "match" and self.matching():
            return
        else:
            self.simple()

    def do_if(self) -> None:
        self.named()
        self.block()
        while self.take("elif"):
            self.named()
            self.block()
        if self.take("else"):
            self.block()

    def do_while(self) -> None:
        self.named()
        self.block()
        if self.take("else"):
            self.block()

    def do_for(self) -> None:
        self.targets()
        self.need("in")
        self.expressions()
        self.block()
        if self.take("else"):
            self.block()

    def do_try(self) -> None:
        self.block()
        handled = False
        while self.take("except"):
            handled = True
            self.take("*")
            if self.kinds[self.i] != ":":
                self.expression()
                if self.take("as"):
                    self.need("name")
                elif self.kinds[self.i] == ",":
                    raise self.fail("several exceptions need parentheses")
            self.block()
        if handled and self.take("else"):
            self.block()
        if self.take("finally"):
            self.block()
        elif not handled:
            raise self.fail("expected except or finally")

    def do_with(self) -> None:
        begin = self.i
        if self.kinds[self.i] == "(":  # parenthesised items or an expression
            errors = len(self.errors)
            try:
                self.i += 1
                while self.kinds[self.i] != ")":
                    self.with_item()
                    if not self.take(","):
                        break
                self.need(")")
                if self.kinds[self.i] == ":":
                    self.block()
                    return
            except Stop:
                if self.kinds[self.i] == "eof":
                    raise
            del self.errors[errors:]
            self.i = begin
        self.with_item()
        while self.take(","):
            self.with_item()
        self.block()

    def with_item(self) -> None:
        self.expression()
        if self.take("as") and not self.primary():
            raise self.fail("no target")

    def do_def(self) -> None:
        self.need("name")
        self.type_parameters()
        self.need("(")
        self.parameters(")", annotated=True)
        self.need(")")
        if self.take("->"):
            self.expression()
        self.block()

    def do_class(self) -> None:
        self.need("name")
        self.type_parameters()
        if self.take("("):
            self.arguments()
        self.block()

    def type_parameters(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if not self.take("*"):
                    self.take("**")
                self.need("name")
                if self.take(":"):
                    self.expression()
                if self.take("="):
                    self.expression()
                if not self.take(","):
                    self.need("]")
                    return

    def matching(self) -> bool:
        """A match statement, if it is one; else the cursor stays."""
        begin, errors = self.i, len(self.errors)
        self.i += 1
        try:
            self.expressions()
            self.need(":")
            self.need("newline")
            self.need("indent")
            if self.values[self.i] != "case":
                raise Stop
        except Stop:
            del self.errors[errors:]
            self.i = begin
            return False
        while self.kinds[self.i] == "name" and self.values[self.i] == "case":
            self.i += 1
            while True:
                self.take("*")
                self.binary(5)
                if self.take("as"):
                    self.need("name")
                if not self.take(",") or self.kinds[self.i] in (":", "if"):
                    break
            if self.take("if"):
                self.named()
            self.block()
        if not self.take("dedent"):
            raise self.fail("expected case")
        return True

    def small(self) -> None:
        k = self.kinds[self.i]
        if k == "name" and self.kinds[self.i + 1] == ":=":
            raise self.fail("misplaced ':='")
        if k in ("pass", "break", "continue"):
            self.i += 1
        elif k == "return":
            self.i += 1
            if self.kinds[self.i] not in ("newline", ";", "eof"):
                self.expressions()
        elif k == "raise":
            self.i += 1
            if self.kinds[self.i] not in ("newline", ";", "eof"):
                self.expression()
                if self.take("from"):
                    self.expression()
        elif k == "del":
            self.i += 1
            if not self.expressions():
                raise self.fail("no target")
        elif k == "assert":
            self.i += 1
            self.expression()
            if self.take(","):
                self.expression()
        elif k in ("global", "nonlocal"):
            self.i += 1
            self.need("name")
            while self.take(","):
                self.need("name")
        elif k == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.take("as"):
                    self.need("name")
                if not self.take(","):
                    break
        elif k == "from":
            self.i += 1
            dots = False
            while self.take(".") or self.take("..."):
                dots = True
            if not dots or self.kinds[self.i] == "name":
                self.dotted()
            self.need("import")
            if self.take("*"):
                return
            close = self.take("(")
            while True:
                self.need("name")
                if self.take("as"):
                    self.need("name")
                if not self.take(",") or close and self.kinds[self.i] == ")":
                    break
            if close:
                self.need(")")
        elif k == "name" and self.values[self.i] == "type" and self.kinds[self.i + 1] == "name":
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.expression()
        else:
            self.assignment()

    def assignment(self) -> None:
        self.lonely_star = False
        target = self.value()
        k = self.kinds[self.i]
        if k == ":" and target == 2:
            self.i += 1
            self.expression()
            if self.take("="):
                self.value()
        elif k in _AUGMENTED:
            if target != 2:
                raise self.fail("no target")
            self.i += 1
            self.value()
        else:
            while self.take("="):
                if not target or self.lonely_star:
                    raise self.fail("no target")
                target = self.value()
            if self.lonely_star:
                raise self.fail("unpacking without a list")

    def dotted(self) -> None:
        self.need("name")
        while self.take("."):
            self.need("name")


def parse(text: str) -> list[tuple[int, str]]:
    c = _Parser(text)
    lex(c)
    try:
        c.file()
    except Stop:
        pass
    return c.errors
