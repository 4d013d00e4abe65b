"""JavaScript scripts (no module syntax)."""

from __future__ import annotations

import re

from dialogforge.llm.syntax.base import Cursor, Stop

_KEYWORDS = frozenset("break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split())
_TOKEN = re.compile(
    r"""(?P<space>[^\S\n\r]+)|(?P<newline>[\r\n  ]+)|(?P<comment>//[^\n\r]*|/\*.*?\*/)|(?P<string>"(?:[^"\\\n\r]|\\(?:\r\n|.))*"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')"""
    r"""|(?P<number>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$]))|(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<private>\#[^\W\d][\w$]*)"""
    r"""|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{}()\[\];,<>+\-*/%&|^!~?:=.@])""",
    re.S,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[a-z]*")
_VALUE_ENDS = frozenset(["name", "number", "string", "template", "regex", "private", ")", "]", "}", "this", "super", "true", "false", "null"])
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
_UNARY = frozenset(["!", "~", "+", "-", "typeof", "void", "delete", "++", "--"])


def _template_end(text: str, at: int) -> tuple[int, list[tuple[int, int]]]:
    """Behind the template that begins at ``at``, or -1, and its substitutions, which end with their braces."""
    i, end, braces, fields, begin = at + 1, len(text), [], [], 0
    while i < end:
        ch = text[i]
        if ch == "\\":
            i += 2
            continue
        if not braces or braces[-1] == "`":
            if ch == "`":
                if not braces:
                    return i + 1, fields
                braces.pop()
            elif ch == "$" and text[i + 1 : i + 2] == "{":
                braces.append("{")
                i += 1
                if len(braces) == 1:
                    begin = i + 1
        elif ch == "{":
            braces.append("{")
        elif ch == "}":
            braces.pop()
            if not braces:
                fields.append((begin, i))
        elif ch == "`":
            braces.append("`")
        elif ch in "'\"":
            j = i + 1
            while j < end and text[j] != ch and text[j] != "\n":
                j += 2 if text[j] == "\\" else 1
            i = j
        i += 1
    return -1, []


class _Parser(Cursor):
    def __init__(self, text: str) -> None:
        super().__init__(text)
        self.lines: list[bool] = []  # whether a line break stands before the token
        self.close: dict[int, int] = {}  # place of a "(" token -> that of its ")"
        self.functions = self.loops = 0
        self.is_async = self.is_generator = False
        self.lex()

    def lex(self) -> None:
        text, at, end, line = self.text, 0, len(self.text), False
        if text.startswith("#!"):
            at = text.find("\n") if "\n" in text else end
        stack: list[int] = []
        while at < end:
            ch = text[at]
            last = self.kinds[-1] if self.kinds else ""
            if ch == "`":
                stop, fields = _template_end(text, at)
                if stop < 0:
                    self.put("bad", "`", at, line)
                    at += 1
                else:
                    self.put("template", "", at, line)
                    for a, b in fields:
                        self.errors += [(a + place, message) for place, message in _field_errors(text[a:b])]
                    at = stop
                line = False
                continue
            if ch == "/" and last not in _VALUE_ENDS and (m := _REGEX.match(text, at)):
                self.put("regex", "", at, line)
                at, line = m.end(), False
                continue
            m = _TOKEN.match(text, at)
            if m is None:
                self.put("bad", ch, at, line)
                at, line = at + 1, False
                continue
            group = m.lastgroup
            if group == "newline" or group == "comment" and "\n" in m.group():
                line = True
            elif group not in ("space", "comment"):
                value = m.group()
                kind = value if group == "op" or value in _KEYWORDS and group == "name" else group
                if kind == "(":
                    stack.append(len(self.kinds))
                elif kind == ")" and stack:
                    self.close[stack.pop()] = len(self.kinds)
                self.put(kind, value, at, line)
                line = False
            at = m.end()
        self.put("eof", "", end, True)

    def put(self, kind: str, value: str, place: int, line: bool) -> None:
        self.add(kind, value, place)
        self.lines.append(line)

    def semicolon(self) -> None:
        if not self.take(";") and self.kind not in ("}", "eof") and not self.lines[self.i]:
            raise self.fail("expected ';'")

    # Statements.

    def statements(self, end: str) -> None:
        while self.kind != end:
            begin, depth = self.i, self.depth
            if self.kind == "eof":
                raise self.fail("unclosed block")
            try:
                self.statement()
            except Stop:
                self.recover(begin, (";", "}"))
                self.depth = depth

    def block(self) -> None:
        self.need("{")
        self.enter()
        self.statements("}")
        self.leave()
        self.need("}")

    def statement(self) -> None:
        k = self.kind
        if k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif k in ("var", "const") or self.is_let():
            self.i += 1
            self.declarations(k == "const", True)
            self.semicolon()
        elif k == "function":
            self.function(True)
        elif k == "class":
            self.class_(True)
        elif k == "if":
            self.i += 1
            self.parenthesised()
            self.statement()
            if self.take("else"):
                self.statement()
        elif k == "for":
            self.for_()
        elif k == "while":
            self.i += 1
            self.parenthesised()
            self.body()
        elif k == "do":
            self.i += 1
            self.body()
            self.need("while")
            self.parenthesised()
            self.take(";")
        elif k == "return":
            if not self.functions:
                raise self.fail("return outside of a function")
            self.i += 1
            self.optional_value()
        elif k in ("break", "continue"):
            self.i += 1
            if self.kind == "name" and not self.lines[self.i]:
                self.i += 1
            elif not self.loops:
                raise self.fail("outside of a loop")
            self.semicolon()
        elif k == "throw":
            self.i += 1
            if self.lines[self.i]:
                raise self.fail("line break after throw")
            self.expression()
            self.semicolon()
        elif k == "try":
            self.i += 1
            self.block()
            handled = self.take("catch")
            if handled:
                if self.take("("):
                    self.pattern()
                    self.need(")")
                self.block()
            if self.take("finally"):
                self.block()
            elif not handled:
                raise self.fail("expected catch or finally")
        elif k == "switch":
            self.i += 1
            self.parenthesised()
            self.need("{")
            self.loops += 1
            while not self.take("}"):
                if self.take("case"):
                    self.expression()
                else:
                    self.need("default")
                self.need(":")
                while self.kind not in ("case", "default", "}", "eof"):
                    self.statement()
            self.loops -= 1
        elif k == "debugger":
            self.i += 1
            self.semicolon()
        elif k == "with":
            self.i += 1
            self.parenthesised()
            self.statement()
        elif k == "name" and self.kinds[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif k == "name" and self.values[self.i] == "async" and self.kinds[self.i + 1] == "function" and not self.lines[self.i + 1]:
            self.i += 1
            self.function(True, True)
        elif k == "import" and self.kinds[self.i + 1] not in ("(", ".") or k == "export":
            raise self.fail("module syntax in a script")
        else:
            self.expression()
            self.semicolon()

    def is_let(self) -> bool:
        return self.kind == "name" and self.values[self.i] == "let" and self.kinds[self.i + 1] in ("name", "[", "{")

    def body(self) -> None:
        self.loops += 1
        self.statement()
        self.loops -= 1

    def parenthesised(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def optional_value(self) -> None:
        if self.kind not in (";", "}", "eof") and not self.lines[self.i]:
            self.expression()
        self.semicolon()

    def for_(self) -> None:
        self.i += 1
        if self.kind == "name" and self.values[self.i] == "await":
            self.i += 1
        self.need("(")
        if self.kind != ";":
            if self.kind in ("var", "const") or self.is_let():
                constant = self.kind == "const"
                self.i += 1
                self.pattern()
                if self.kind != "in" and not self.of():
                    if self.take("="):
                        self.assignment(False)
                    elif constant:
                        raise self.fail("const without a value")
                    while self.take(","):
                        self.pattern()
                        if self.take("="):
                            self.assignment(False)
            else:
                left = self.expression(False)
                if (self.kind == "in" or self.of()) and not left:
                    raise self.fail("no target")
            if self.kind == "in" or self.of():
                self.i += 1
                self.expression()
                self.need(")")
                self.body()
                return
        self.need(";")
        if self.kind != ";":
            self.expression()
        self.need(";")
        if self.kind != ")":
            self.expression()
        self.need(")")
        self.body()

    def of(self) -> bool:
        return self.kind == "name" and self.values[self.i] == "of"

    def declarations(self, constant: bool, with_in: bool) -> None:
        while True:
            structured = self.kind in ("[", "{")
            self.pattern()
            if self.take("="):
                self.assignment(with_in)
            elif constant or structured:
                raise self.fail("declaration without a value")
            if not self.take(","):
                return

    def pattern(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.pattern()
                if self.take("="):
                    self.assignment()
                if not self.take(","):
                    self.need("]")
                    return
        elif self.take("{"):
            while not self.take("}"):
                if self.take("..."):
                    self.pattern()
                else:
                    short = self.kind == "name"
                    self.key()
                    if self.take(":"):
                        self.pattern()
                    elif not short:
                        raise self.fail("expected ':'")
                    if self.take("="):
                        self.assignment()
                if not self.take(","):
                    self.need("}")
                    return
        else:
            self.need("name")

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            rest = self.take("...")
            self.pattern()
            if self.take("="):
                self.assignment()
            if rest or not self.take(","):
                self.need(")")
                return

    def function(self, named: bool, is_async: bool = False) -> None:
        self.need("function")
        generator = self.take("*")
        if named or self.kind == "name":
            self.need("name")
        self.function_rest(is_async, generator)

    def function_rest(self, is_async: bool, generator: bool, parameters: bool = True) -> None:
        kept = self.functions, self.loops, self.is_async, self.is_generator
        self.functions, self.loops, self.is_async, self.is_generator = 1, 0, is_async, generator
        if parameters:
            self.parameters()
        self.block()
        self.functions, self.loops, self.is_async, self.is_generator = kept

    def class_(self, named: bool) -> None:
        self.need("class")
        if named or self.kind == "name":
            self.need("name")
        if self.take("extends"):
            self.unary()
        self.need("{")
        while not self.take("}"):
            if self.take(";"):
                continue
            self.member(True)

    def key(self) -> None:
        k = self.kind
        if k == "[":
            self.i += 1
            self.assignment()
            self.need("]")
        elif k in ("name", "string", "number", "private") or k in _KEYWORDS:
            self.i += 1
        else:
            raise self.fail("expected a name")

    def member(self, in_class: bool) -> None:
        """A class member, or a method or accessor of an object (the caller handles other properties)."""
        is_async = generator = False
        after = ("(", "=", ";", "}", ",", ":")
        if in_class and self.values[self.i] == "static" and self.kinds[self.i + 1] not in after:
            self.i += 1
            if self.kind == "{":
                self.function_rest(False, False, parameters=False)
                return
        if self.values[self.i] == "async" and self.kinds[self.i + 1] not in after and not self.lines[self.i + 1]:
            self.i += 1
            is_async = True
        elif self.values[self.i] in ("get", "set") and self.kind == "name" and self.kinds[self.i + 1] not in after:
            self.i += 1
        generator = self.take("*")
        self.key()
        if self.kind == "(":
            self.function_rest(is_async, generator)
        elif in_class:
            if self.take("="):
                self.assignment()
            self.semicolon()
        else:
            raise self.fail("expected '('")

    # Expressions return 2 for a simple target, 1 for a pattern, 0 for no target.

    def expression(self, with_in: bool = True) -> int:
        result = self.assignment(with_in)
        while self.take(","):
            self.assignment(with_in)
            result = 0
        return result

    def assignment(self, with_in: bool = True) -> int:
        self.enter()
        try:
            if self.arrow(with_in):
                return 0
            if self.is_generator and self.kind == "name" and self.values[self.i] == "yield":
                self.i += 1
                star = self.take("*")
                if star or self.kind not in (")", "]", "}", ",", ";", ":", "eof") and not self.lines[self.i]:
                    self.assignment(with_in)
                return 0
            left = self.binary(1, with_in)
            if self.take("?"):
                self.assignment()
                self.need(":")
                self.assignment(with_in)
                return 0
            k = self.kind
            if k in _ASSIGN:
                if left == 0 or left == 1 and k != "=":
                    raise self.fail("no target")
                self.i += 1
                self.assignment(with_in)
                return 0
            return left
        finally:
            self.leave()

    def arrow(self, with_in: bool) -> bool:
        i = self.i
        is_async = self.kinds[i] == "name" and self.values[i] == "async" and self.kinds[i + 1] in ("name", "(") and not self.lines[i + 1]
        if is_async:
            i += 1
        if self.kinds[i] == "name" and self.kinds[i + 1] == "=>":
            self.i = i + 1
        elif self.kinds[i] == "(" and i in self.close and self.kinds[self.close[i] + 1] == "=>":
            self.i = i
            self.parameters()
        else:
            return False
        self.need("=>")
        if self.kind == "{":
            self.function_rest(is_async, False, parameters=False)
        else:
            kept, self.is_async = self.is_async, is_async
            self.assignment(with_in)
            self.is_async = kept
        return True

    def binary(self, least: int, with_in: bool) -> int:
        """Precedence climbing."""
        left = self.unary()
        while True:
            k = self.kind
            level = _BINARY.get(k)
            if level is None or level < least or k == "in" and not with_in:
                return left
            self.i += 1
            self.binary(level if k == "**" else level + 1, with_in)
            left = 0

    def unary(self) -> int:
        k = self.kind
        if k in _UNARY or self.is_async and k == "name" and self.values[self.i] == "await":
            self.enter()
            self.i += 1
            result = self.unary()
            self.leave()
            if k in ("++", "--") and result != 2:
                raise self.fail("no target")
            return 0
        result = self.postfix()
        if self.kind in ("++", "--") and not self.lines[self.i]:
            if result != 2:
                raise self.fail("no target")
            self.i += 1
            return 0
        return result

    def arguments(self) -> None:
        while not self.take(")"):
            self.take("...")
            self.assignment()
            if not self.take(","):
                self.need(")")
                return

    def postfix(self, calls: bool = True) -> int:
        result = self.primary()
        while True:
            k = self.kind
            if k == "." or k == "?.":
                self.i += 1
                if k == "?." and self.kind in ("(", "["):
                    continue
                if self.kind not in ("name", "private") and self.kind not in _KEYWORDS:
                    raise self.fail("expected a name")
                self.i += 1
                result = 2
            elif k == "[":
                self.i += 1
                self.expression()
                self.need("]")
                result = 2
            elif k == "(" and calls:
                self.i += 1
                self.arguments()
                result = 0
            elif k == "template":
                self.i += 1
                result = 0
            else:
                return result

    def primary(self) -> int:
        k = self.kind
        if k == "name":
            if self.values[self.i] == "async" and self.kinds[self.i + 1] == "function" and not self.lines[self.i + 1]:
                self.i += 1
                self.function(False, True)
                return 0
            self.i += 1
            return 2
        if k in ("number", "string", "template", "regex", "this", "null", "true", "false", "super"):
            self.i += 1
            return 0
        if k == "private" and self.kinds[self.i + 1] == "in":
            self.i += 1
            return 0
        if k == "(":
            self.i += 1
            result = self.expression()
            self.need(")")
            return 2 if result == 2 else 0
        if k == "[":
            self.i += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.assignment()
                if not self.take(","):
                    self.need("]")
                    break
            return 1
        if k == "{":
            self.object()
            return 1
        if k == "function":
            self.function(False)
            return 0
        if k == "class":
            self.class_(False)
            return 0
        if k == "new":
            self.i += 1
            if self.take("."):
                self.need("name")
                return 0
            self.postfix(calls=False)
            if self.take("("):
                self.arguments()
            return 0
        if k == "import" and self.kinds[self.i + 1] in ("(", "."):
            self.i += 1
            return 0
        raise self.fail("expected an expression")

    def object(self) -> None:
        self.need("{")
        while not self.take("}"):
            if self.take("..."):
                self.assignment()
            else:
                begin, plain = self.i, self.kind == "name"
                if self.kind != "*" and not (self.values[self.i] in ("get", "set", "async") and self.kinds[self.i + 1] not in ("(", ":", ",", "}", "=")):
                    self.key()
                    if self.take(":"):
                        self.assignment()
                    elif self.kind == "(":
                        self.function_rest(False, False)
                    elif not plain:
                        raise self.fail("expected ':'")
                    elif self.take("="):
                        self.assignment()
                else:
                    self.i = begin
                    self.member(False)
            if not self.take(","):
                self.need("}")
                return


def _field_errors(text: str) -> list[tuple[int, str]]:
    """Errors of an expression that stands within a template."""
    c = _Parser(text)
    c.is_async = c.is_generator = True  # what is around it is not known here
    try:
        c.expression()
        if c.kind != "eof":
            c.note(f"unexpected {c.kind!r} in a template")
    except Stop:
        pass
    return c.errors


def parse(text: str) -> list[tuple[int, str]]:
    c = _Parser(text)
    try:
        c.statements("eof")
    except Stop:
        pass
    return c.errors
