"""Go source files."""

from __future__ import annotations

import re

from dialogforge.llm.syntax.base import Cursor, Stop

_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>"(?:[^"\\\n]|\\.)*"|`[^`]*`)|(?P<char>'(?:[^'\\\n]|\\(?:[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|.))')"""
    r"""|(?P<number>(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w))|(?P<name>[^\W\d]\w*)"""
    r"""|(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[+\-*/%&|^<>=!()\[\]{},;.:~])""",
    re.S,
)
_ENDS_LINE = frozenset(["name", "string", "char", "number", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_UNARY = frozenset("+ - ! ^ * & <- ~".split())
_TYPES = frozenset(["[", "map", "chan", "func", "struct", "interface", "*", "<-"])


class _Parser(Cursor):
    def __init__(self, text: str) -> None:
        super().__init__(text)
        self.literals = True  # whether a brace behind a type name opens a composite literal
        self.lex()

    def lex(self) -> None:
        text, at, end = self.text.removeprefix("﻿"), 0, 0
        end = len(text)

        def line(place: int) -> None:
            if self.kinds and self.kinds[-1] in _ENDS_LINE:
                self.add(";", "\n", place)

        while at < end:
            m = _TOKEN.match(text, at)
            if m is None:
                self.add("bad", text[at], at)
                at += 1
                continue
            group = m.lastgroup
            if group == "newline" or group == "comment" and "\n" in m.group():
                line(at)
            elif group not in ("space", "comment"):
                value = m.group()
                self.add(value if group == "op" or group == "name" and value in _KEYWORDS else group, value, at)
            at = m.end()
        line(end)
        self.add("eof", "", end)

    def end(self) -> None:
        if self.kind not in (")", "}"):
            self.need(";")

    def file(self) -> None:
        self.need("package")
        self.need("name")
        self.need(";")
        imports = True
        while self.kind != "eof":
            begin = self.i
            try:
                k = self.kind
                if k == "import":
                    if not imports:
                        raise self.fail("import after a declaration")
                    self.i += 1
                    self.group(self.import_)
                else:
                    imports = False
                    self.declaration(top=True)
                self.need(";")
            except Stop:
                self.depth = 0
                self.recover(begin, (";",))
                while self.kind not in ("func", "type", "var", "const", "eof"):
                    self.i += 1

    def group(self, one: object) -> None:
        if self.take("("):
            while not self.take(")"):
                one()
                self.end()
        else:
            one()

    def import_(self) -> None:
        if self.kind in ("name", "."):
            self.i += 1
        self.need("string")

    def declaration(self, top: bool) -> None:
        k = self.kind
        if k == "func" and top:
            self.i += 1
            if self.kind == "(":
                self.parameters()
            self.need("name")
            if self.kind == "[":
                self.type_parameters()
            self.signature()
            if self.kind == "{":
                self.block()
        elif k in ("var", "const", "type"):
            self.i += 1
            self.group({"var": self.var, "const": self.const, "type": self.type_spec}[k])
        else:
            raise self.fail("expected a declaration")

    def names(self) -> None:
        self.need("name")
        while self.take(","):
            self.need("name")

    def var(self) -> None:
        self.names()
        if self.kind != "=":
            self.type()
        if self.take("="):
            self.expressions()

    def const(self) -> None:
        self.names()
        if self.kind not in ("=", ";", ")"):
            self.type()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.need("name")
        if self.kind == "[" and self.kinds[self.i + 1] == "name" and self.kinds[self.i + 2] != "]":
            self.type_parameters()
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.take("]"):
            self.names()
            self.constraint()
            if not self.take(","):
                self.need("]")
                return

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def type(self) -> None:
        self.enter()
        k = self.kind
        if k == "name":
            self.i += 1
            if self.take("."):
                self.need("name")
            if self.kind == "[" and self.kinds[self.i + 1] != "]":
                self.i += 1
                self.type()
                while self.take(","):
                    self.type()
                self.need("]")
        elif k == "*":
            self.i += 1
            self.type()
        elif k == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.i += 1
            if not self.take("]"):
                if not self.take("..."):
                    self.free_expression()
                self.need("]")
            self.type()
        elif k == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif k == "chan":
            self.i += 1
            self.take("<-")
            self.type()
        elif k == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif k == "func":
            self.i += 1
            self.signature()
        elif k == "struct":
            self.i += 1
            self.need("{")
            while not self.take("}"):
                self.field()
                if self.kind == "string":
                    self.i += 1
                self.end()
        elif k == "interface":
            self.i += 1
            self.need("{")
            while not self.take("}"):
                if self.kind == "name" and self.kinds[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.end()
        else:
            raise self.fail("expected a type")
        self.leave()

    def field(self) -> None:
        if self.kind == "*" or self.kind == "name" and self.kinds[self.i + 1] in (";", "}", "string", "."):
            self.type()
            return
        self.names()
        self.type()

    def signature(self) -> None:
        self.parameters()
        if self.kind == "(":
            self.parameters()
        elif self.kind == "name" or self.kind in _TYPES:
            self.type()

    def parameters(self) -> None:
        """Names and types, or types only; a name before a type is taken for a name."""
        self.need("(")
        while not self.take(")"):
            if not self.take("..."):
                self.type()
            else:
                self.type()
            if self.kind not in (",", ")"):
                self.take("...")
                self.type()
            if not self.take(","):
                self.need(")")
                return

    # Statements.

    def block(self) -> None:
        self.need("{")
        kept, self.literals = self.literals, True
        self.enter()
        while self.kind != "}":
            if self.kind == "eof":
                raise self.fail("unclosed block")
            self.statement()
            if self.kind != "}":
                self.need(";")
        self.i += 1
        self.leave()
        self.literals = kept

    def statement(self) -> None:
        k = self.kind
        if k in (";", "}"):
            return
        if k == "{":
            self.block()
        elif k in ("var", "const", "type"):
            self.declaration(top=False)
        elif k == "return":
            self.i += 1
            if self.kind not in (";", "}"):
                self.expressions()
        elif k in ("break", "continue", "goto"):
            self.i += 1
            if not self.take("name") and k == "goto":
                raise self.fail("expected a label")
        elif k == "fallthrough":
            self.i += 1
        elif k in ("go", "defer"):
            self.i += 1
            if self.expression() != "call":
                raise self.fail("expected a call")
        elif k == "if":
            self.if_()
        elif k == "for":
            self.for_()
        elif k in ("switch", "select"):
            self.switch(k == "select")
        elif k == "name" and self.kinds[self.i + 1] == ":":
            self.i += 2
            self.statement()
        else:
            self.simple()

    def simple(self) -> None:
        """An expression statement, send, increment, assignment or range clause."""
        if self.take("range"):
            self.expression()
            return
        kind = self.expressions()
        k = self.kind
        if k in _ASSIGN:
            if kind not in ("target", "targets") and k != ":=" or kind in ("call", "value"):
                raise self.fail("no target")
            self.i += 1
            if self.take("range"):
                self.expression()
            else:
                self.expressions()
        elif k in ("++", "--"):
            self.i += 1
        elif k == "<-":
            self.i += 1
            self.expression()
        elif kind not in ("call", "receive"):
            raise self.fail("a value is no statement")

    def header(self) -> None:
        """What stands between a keyword and its block."""
        kept, self.literals = self.literals, False
        if self.kind == "{":
            self.literals = kept
            return
        self.condition = True
        if self.kind != ";":
            self.clause()
        while self.take(";"):
            if self.kind not in ("{", ";"):
                self.clause()
        self.literals = kept

    def clause(self) -> None:
        begin, errors = self.i, len(self.errors)
        try:
            self.simple()
        except Stop:
            if self.errors[-1][1].startswith("a value is no statement") and self.kind in ("{", ";"):
                del self.errors[errors:]
                return
            self.i = max(begin, self.i)
            raise

    def if_(self) -> None:
        self.need("if")
        if self.kind == "{":
            raise self.fail("missing condition")
        self.header()
        self.block()
        if self.take("else"):
            if self.kind == "if":
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        self.need("for")
        self.header()
        self.block()

    def switch(self, select: bool) -> None:
        self.i += 1
        if not select:
            self.header()
        self.need("{")
        kept, self.literals = self.literals, True
        while not self.take("}"):
            if self.take("case"):
                if select:
                    self.simple()
                else:
                    self.type_or_expression()
                    while self.take(","):
                        self.type_or_expression()
            else:
                self.need("default")
            self.need(":")
            while self.kind not in ("case", "default", "}"):
                if self.kind == "eof":
                    raise self.fail("unclosed switch")
                self.statement()
                if self.kind not in ("case", "default", "}"):
                    self.need(";")
        self.literals = kept

    def type_or_expression(self) -> None:
        if self.kind in ("map", "chan", "struct", "interface", "[", "func"):
            self.type()
        else:
            self.expression()

    # Expressions say what they are: "target", "call", "receive" or "value".

    def free_expression(self) -> str:
        kept, self.literals = self.literals, True
        kind = self.expression()
        self.literals = kept
        return kind

    def expressions(self) -> str:
        kind = self.expression()
        while self.take(","):
            other = self.expression()
            kind = "targets" if kind in ("target", "targets") and other == "target" else "value"
        return kind

    def expression(self, least: int = 1) -> str:
        """Precedence climbing."""
        self.enter()
        kind = self.unary()
        while True:
            level = _BINARY.get(self.kind)
            if level is None or level < least:
                break
            self.i += 1
            self.expression(level + 1)
            kind = "value"
        self.leave()
        return kind

    def unary(self) -> str:
        k = self.kind
        if k in _UNARY:
            self.i += 1
            if k == "<-" and self.kind == "chan":
                self.i -= 1
                self.type()
                return "value"
            self.enter()
            self.unary()
            self.leave()
            return "target" if k == "*" else "receive" if k == "<-" else "value"
        return self.primary()

    def primary(self) -> str:
        kind = self.operand()
        while True:
            k = self.kind
            if k == ".":
                self.i += 1
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                    kind = "value"
                else:
                    self.need("name")
                    kind = "target"
            elif k == "[":
                self.i += 1
                kept, self.literals = self.literals, True
                if self.kind != ":":
                    self.type_or_expression()
                    while self.take(","):
                        if self.kind == "]":
                            break
                        self.type_or_expression()
                while self.take(":"):
                    if self.kind not in (":", "]"):
                        self.expression()
                self.need("]")
                self.literals = kept
                kind = "target"
            elif k == "(":
                self.i += 1
                kept, self.literals = self.literals, True
                while not self.take(")"):
                    self.expression()
                    self.take("...")
                    if not self.take(","):
                        self.need(")")
                        break
                self.literals = kept
                kind = "call"
            elif k == "{" and self.literals and self.named_type:
                self.composite()
                kind = "value"
            else:
                return kind

    named_type = False

    def composite(self) -> None:
        self.need("{")
        kept, self.literals = self.literals, True
        while not self.take("}"):
            self.element()
            if self.take(":"):
                self.element()
            if not self.take(","):
                self.need("}")
                break
        self.literals = kept
        self.named_type = False

    def element(self) -> None:
        if self.kind == "{":
            self.enter()
            self.composite()
            self.leave()
        else:
            self.expression()

    def operand(self) -> str:
        k = self.kind
        self.named_type = k == "name"
        if k == "name":
            self.i += 1
            return "target"
        if k in ("number", "string", "char"):
            self.i += 1
            return "value"
        if k == "(":
            self.i += 1
            kept, self.literals = self.literals, True
            self.type_or_expression()
            self.literals = kept
            self.need(")")
            self.named_type = False
            return "target"
        if k == "func":
            self.i += 1
            self.signature()
            if self.kind == "{":
                self.block()
            return "value"
        if k in ("[", "map", "chan", "struct", "interface"):
            self.type()
            if self.kind == "{":
                self.composite()
            return "value"
        raise self.fail("expected an expression")


def parse(text: str) -> list[tuple[int, str]]:
    c = _Parser(text)
    try:
        c.file()
    except Stop:
        pass
    return c.errors
