"""Java compilation units."""

from __future__ import annotations

import re

from dialogforge.llm.syntax.base import Cursor, Stop

_PRIMITIVE = frozenset("boolean byte char double float int long short void".split())
_KEYWORDS = _PRIMITIVE | frozenset(
    "abstract assert break case catch class const continue default do else enum extends final finally for goto if implements import instanceof interface native new package private protected public return static strictfp super switch synchronized this throw throws transient try volatile while true false null".split()
)
_MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default".split())
_SOFT_MODIFIERS = frozenset(["sealed", "non"])
_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<string>\"\"\"[ \t]*\n(?:[^"\\]|\\.|"(?!""))*\"\"\"|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\(?:[0-7]{1,3}|u+[\da-fA-F]{4}|.))')"""
    r"""|(?P<number>(?:0[xX][\da-fA-F_]+[lL]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)(?![\w$]))|(?P<name>[^\W\d][\w$]*|\$[\w$]*)"""
    r"""|(?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<=|<<|[{}()\[\];,.<>+\-*/%&|^!~?:=@])""",
    re.S,
)
_ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
_BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, ">>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
_CAST_FOLLOWS = frozenset(["name", "string", "number", "(", "!", "~", "this", "new", "super", "true", "false", "null", "switch"])


class _Parser(Cursor):
    def __init__(self, text: str) -> None:
        super().__init__(text)
        self.close: dict[int, int] = {}
        self.lex()

    def lex(self) -> None:
        text, at, end, stack = self.text, 0, len(self.text), []
        while at < end:
            m = _TOKEN.match(text, at)
            if m is None:
                self.add("bad", text[at], at)
                at += 1
                continue
            group = m.lastgroup
            if group not in ("space", "comment"):
                value = m.group()
                kind = value if group == "op" or group == "name" and value in _KEYWORDS else group
                if kind == "(":
                    stack.append(len(self.kinds))
                elif kind == ")" and stack:
                    self.close[stack.pop()] = len(self.kinds)
                self.add(kind, value, at)
            at = m.end()
        self.add("eof", "", end)

    def word(self, value: str) -> bool:
        return self.kind == "name" and self.values[self.i] == value

    # Declarations.

    def unit(self) -> None:
        begin = self.i
        try:
            self.annotations()
            if self.kind == "package":
                self.i += 1
                self.qualified()
                self.need(";")
            else:
                self.i = begin
            while self.kind == "import":
                self.i += 1
                self.take("static")
                self.need("name")
                while self.take("."):
                    if self.take("*"):
                        break
                    self.need("name")
                self.need(";")
        except Stop:
            self.recover(begin, (";",))
        while self.kind != "eof":
            begin = self.i
            try:
                if not self.take(";"):
                    self.modifiers()
                    if not self.type_declaration():
                        raise self.fail("expected a type declaration")
            except Stop:
                self.recover(begin, ("}",))

    def qualified(self) -> None:
        self.need("name")
        while self.kind == "." and self.kinds[self.i + 1] == "name":
            self.i += 2

    def annotations(self) -> None:
        while self.kind == "@" and self.kinds[self.i + 1] != "interface":
            self.i += 1
            self.qualified()
            if self.take("("):
                while not self.take(")"):
                    if self.kind == "name" and self.kinds[self.i + 1] == "=":
                        self.i += 2
                    self.element()
                    if not self.take(","):
                        self.need(")")
                        break

    def element(self) -> None:
        if self.kind == "@":
            self.annotations()
        elif self.kind == "{":
            self.initializer()
        else:
            self.ternary()

    def modifiers(self) -> None:
        while True:
            if self.kind == "@" and self.kinds[self.i + 1] != "interface":
                self.annotations()
            elif self.kind in _MODIFIERS and not (self.kind == "default" and self.kinds[self.i + 1] in (":", "->")):
                self.i += 1
            elif self.word("sealed") and self.kinds[self.i + 1] in ("class", "interface", "public", "abstract"):
                self.i += 1
            elif self.word("non") and self.kinds[self.i + 1] == "-":
                self.i += 3
            else:
                return

    def type_declaration(self) -> bool:
        k = self.kind
        if k == "class":
            self.i += 1
            self.need("name")
            self.type_parameters()
            if self.take("extends"):
                self.type()
            self.heritage("class")
        elif k == "interface":
            self.i += 1
            self.need("name")
            self.type_parameters()
            if self.take("extends"):
                self.types()
            self.heritage("interface")
        elif k == "@":
            self.i += 2
            self.need("name")
            self.class_body("interface")
        elif k == "enum":
            self.i += 1
            self.need("name")
            if self.take("implements"):
                self.types()
            self.enum_body()
        elif self.word("record") and self.kinds[self.i + 1] == "name":
            self.i += 2
            self.type_parameters()
            self.parameters()
            self.heritage("class")
        else:
            return False
        return True

    def heritage(self, what: str) -> None:
        if what == "class" and self.take("implements"):
            self.types()
        if self.word("permits"):
            self.i += 1
            self.types()
        self.class_body(what)

    def types(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def enum_body(self) -> None:
        self.need("{")
        while self.kind not in (";", "}"):
            self.annotations()
            self.need("name")
            if self.take("("):
                self.arguments()
            if self.kind == "{":
                self.class_body("class")
            if not self.take(","):
                break
        if self.take(";"):
            self.members("class")
        self.need("}")

    def class_body(self, what: str) -> None:
        self.need("{")
        self.enter()
        self.members(what)
        self.leave()
        self.need("}")

    def members(self, what: str) -> None:
        while self.kind != "}":
            if self.kind == "eof":
                raise self.fail("unclosed class body")
            begin, depth = self.i, self.depth
            try:
                self.member(what)
            except Stop:
                self.recover(begin, (";", "}"))
                self.depth = depth

    def member(self, what: str) -> None:
        if self.take(";"):
            return
        if self.kind == "{" or self.kind == "static" and self.kinds[self.i + 1] == "{":
            self.take("static")
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        self.type_parameters()
        self.annotations()
        if self.kind == "name" and self.kinds[self.i + 1] in ("(", "{"):  # constructor
            self.i += 1
            if self.kind == "(":
                self.parameters()
            self.throws()
            self.block()
            return
        self.type()
        self.need("name")
        if self.kind == "(":
            self.parameters()
            self.dimensions()
            self.throws()
            if self.take("default"):
                self.element()
            if self.kind == "{":
                self.block()
            else:
                self.need(";")
            return
        self.declarators()
        self.need(";")

    def throws(self) -> None:
        if self.take("throws"):
            self.types()

    def dimensions(self) -> bool:
        found = False
        while self.kind == "[" and self.kinds[self.i + 1] == "]":
            self.i += 2
            found = True
        return found

    def declarators(self) -> None:
        """Behind the first name."""
        while True:
            self.dimensions()
            if self.take("="):
                self.initial()
            if not self.take(","):
                return
            self.need("name")

    def initial(self) -> None:
        if self.kind == "{":
            self.initializer()
        else:
            self.expression()

    def initializer(self) -> None:
        self.need("{")
        self.enter()
        while not self.take("}"):
            if self.kind == "@":
                self.annotations()
            else:
                self.initial()
            if not self.take(","):
                self.need("}")
                break
        self.leave()

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.modifiers()
            self.type()
            self.take("...")
            if not self.take("this"):
                self.need("name")
            self.dimensions()
            if not self.take(","):
                self.need(")")
                return

    def type_parameters(self) -> None:
        if self.take("<"):
            while True:
                self.annotations()
                self.need("name")
                if self.take("extends"):
                    self.type()
                    while self.take("&"):
                        self.type()
                if not self.take(","):
                    break
            self.need(">")

    def type(self) -> None:
        self.annotations()
        if self.kind in _PRIMITIVE:
            self.i += 1
        else:
            while True:
                self.need("name")
                if self.kind == "<":
                    self.type_arguments()
                if self.kind != "." or self.kinds[self.i + 1] not in ("name", "@"):
                    break
                self.i += 1
                self.annotations()
        self.dimensions()

    def type_arguments(self) -> None:
        self.need("<")
        self.enter()
        if not self.take(">"):
            while True:
                self.annotations()
                if self.take("?"):
                    if self.take("extends") or self.take("super"):
                        self.type()
                else:
                    self.type()
                if not self.take(","):
                    break
            self.need(">")
        self.leave()

    def attempt(self, rule: object) -> bool:
        """Whether ``rule`` holds here; if not, the cursor stays."""
        begin, errors, depth = self.i, len(self.errors), self.depth
        try:
            if rule():
                return True
        except Stop:
            pass
        del self.errors[errors:]
        self.i, self.depth = begin, depth
        return False

    # Statements.

    def block(self) -> None:
        self.need("{")
        self.enter()
        while self.kind != "}":
            if self.kind == "eof":
                raise self.fail("unclosed block")
            self.statement()
        self.i += 1
        self.leave()

    def local(self) -> bool:
        self.modifiers()
        self.type()
        if self.kind != "name" or self.kinds[self.i + 1] not in ("=", ";", ",", ":", "["):
            return False
        self.i += 1
        return True

    def statement(self) -> None:
        k = self.kind
        if k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif k == "if":
            self.i += 1
            self.parenthesised()
            self.statement()
            if self.take("else"):
                self.statement()
        elif k == "while":
            self.i += 1
            self.parenthesised()
            self.statement()
        elif k == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.parenthesised()
            self.need(";")
        elif k == "for":
            self.for_()
        elif k == "try":
            self.try_()
        elif k == "switch":
            self.i += 1
            self.switch()
        elif k == "synchronized" and self.kinds[self.i + 1] == "(":
            self.i += 1
            self.parenthesised()
            self.block()
        elif k == "return":
            self.i += 1
            if self.kind != ";":
                self.expression()
            self.need(";")
        elif k == "throw":
            self.i += 1
            self.expression()
            self.need(";")
        elif k in ("break", "continue"):
            self.i += 1
            self.take("name")
            self.need(";")
        elif k == "assert":
            self.i += 1
            self.expression()
            if self.take(":"):
                self.expression()
            self.need(";")
        elif k == "name" and self.kinds[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif k == "name" and self.values[self.i] == "yield" and self.kinds[self.i + 1] not in ("=", ".", "(", "[", "++", "--"):
            self.i += 1
            self.expression()
            self.need(";")
        elif k in ("class", "interface", "enum", "abstract", "static", "strictfp") or k in ("final", "@") or self.word("record"):
            if self.attempt(self.local):
                self.declarators()
                self.need(";")
            else:
                self.modifiers()
                if not self.type_declaration():
                    self.statement_expression()
        elif (k == "name" or k in _PRIMITIVE) and self.kinds[self.i + 1] in ("name", "<", "[", ".", "@") and self.attempt(self.local):
            self.declarators()
            self.need(";")
        else:
            self.statement_expression()

    def statement_expression(self) -> None:
        if self.expression() not in ("call", "change"):
            raise self.fail("a value is no statement")
        self.need(";")

    def parenthesised(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def for_(self) -> None:
        self.i += 1
        self.need("(")
        if self.kind != ";":
            if self.attempt(self.local):
                if self.take(":"):
                    self.expression()
                    self.need(")")
                    self.statement()
                    return
                self.declarators()
            else:
                self.expression()
                while self.take(","):
                    self.expression()
        self.need(";")
        if self.kind != ";":
            self.expression()
        self.need(";")
        if self.kind != ")":
            self.expression()
            while self.take(","):
                self.expression()
        self.need(")")
        self.statement()

    def try_(self) -> None:
        self.i += 1
        resources = self.take("(")
        if resources:
            while not self.take(")"):
                if self.attempt(self.local):
                    self.need("=")
                self.expression()
                if not self.take(";"):
                    self.need(")")
                    break
        self.block()
        handled = False
        while self.take("catch"):
            handled = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.take("|"):
                self.type()
            self.need("name")
            self.need(")")
            self.block()
        if self.take("finally"):
            self.block()
        elif not handled and not resources:
            raise self.fail("expected catch or finally")

    def switch(self) -> None:
        self.parenthesised()
        self.need("{")
        while not self.take("}"):
            if self.take("default"):
                pass
            else:
                self.need("case")
                while True:
                    if not self.take("default"):
                        self.label()
                    if not self.take(","):
                        break
            if self.take("->"):
                if self.kind == "{":
                    self.block()
                elif self.kind == "throw":
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
                continue
            self.need(":")
            while self.kind not in ("case", "default", "}"):
                if self.kind == "eof":
                    raise self.fail("unclosed switch")
                self.statement()

    def pattern(self) -> bool:
        self.modifiers()
        self.type()
        if self.take("("):
            while not self.take(")"):
                if not self.pattern():
                    return False
                if not self.take(","):
                    self.need(")")
                    break
            self.take("name")
            return True
        return self.take("name")

    def label(self) -> None:
        if not (self.kind == "name" and self.kinds[self.i + 1] in ("name", "(", "<", ".") and self.attempt(self.pattern)):
            self.ternary()
        if self.word("when"):
            self.i += 1
            self.expression()

    # Expressions say what they are: "target", "call", "change" or "value".

    def expression(self) -> str:
        self.enter()
        left = self.ternary()
        k = self.kind
        if k == ">" and self.values[self.i + 1] in (">", ">="):
            k = ""
        if k in _ASSIGN or self.shift_assign():
            if left != "target":
                raise self.fail("no target")
            self.i += 1
            self.expression()
            left = "change"
        self.leave()
        return left

    def shift_assign(self) -> bool:
        """>>= and >>>= come as single signs, so that generic types can close."""
        j = self.i
        while self.kinds[j] == ">" and self.places[j + 1] == self.places[j] + 1:
            j += 1
        if j > self.i and self.kinds[j] == ">=":
            self.i = j
            return True
        return False

    def lambda_(self) -> bool:
        i = self.i
        if self.kinds[i] == "name" and self.kinds[i + 1] == "->":
            self.i = i + 2
        elif self.kinds[i] == "(" and i in self.close and self.kinds[self.close[i] + 1] == "->":
            stop = self.close[i]
            self.i = i + 1
            while self.i < stop:
                if self.kind == "name" and self.kinds[self.i + 1] in (",", ")"):
                    self.i += 1
                else:
                    self.modifiers()
                    self.type()
                    self.take("...")
                    self.need("name")
                    self.dimensions()
                if self.i < stop:
                    self.need(",")
            self.i = stop + 2
        else:
            return False
        if self.kind == "{":
            self.block()
        else:
            self.expression()
        return True

    def ternary(self) -> str:
        if self.lambda_():
            return "value"
        left = self.binary(1)
        if self.take("?"):
            self.ternary()
            self.need(":")
            self.ternary()
            return "value"
        return left

    def binary(self, least: int) -> str:
        """Precedence climbing."""
        left = self.unary()
        while True:
            k, width = self.kind, 1
            if k == ">" and self.places[self.i + 1] == self.places[self.i] + 1 and self.kinds[self.i + 1] in (">", ">="):
                j = self.i
                while self.kinds[j] == ">" and self.places[j + 1] == self.places[j] + 1:
                    j += 1
                if self.kinds[j] == ">=":
                    return left
                k, width = ">>", j - self.i + 1
            level = _BINARY.get(k)
            if level is None or level < least:
                return left
            self.i += width
            if k == "instanceof":
                if not self.attempt(self.pattern):
                    self.take("final")
                    self.type()
            else:
                self.binary(level + 1)
            left = "value"

    def cast(self) -> bool:
        self.need("(")
        primitive = self.kind in _PRIMITIVE
        self.type()
        while self.take("&"):
            self.type()
        self.need(")")
        if self.kind in _CAST_FOLLOWS or primitive and self.kind in ("+", "-", "++", "--"):
            return True
        return False

    def unary(self) -> str:
        k = self.kind
        if k in ("+", "-", "!", "~"):
            self.enter()
            self.i += 1
            self.unary()
            self.leave()
            return "value"
        if k in ("++", "--"):
            self.i += 1
            if self.unary() != "target":
                raise self.fail("no target")
            return "change"
        if k == "(" and (self.kinds[self.i + 1] == "name" or self.kinds[self.i + 1] in _PRIMITIVE) and self.attempt(self.cast):
            if not self.lambda_():
                self.enter()
                self.unary()
                self.leave()
            return "value"
        result = self.postfix()
        if self.kind in ("++", "--"):
            if result != "target":
                raise self.fail("no target")
            self.i += 1
            return "change"
        return result

    def arguments(self) -> None:
        while not self.take(")"):
            self.expression()
            if not self.take(","):
                self.need(")")
                return

    def reference(self) -> bool:
        self.type()
        return self.kind == "::"

    def postfix(self) -> str:
        result = self.primary()
        while True:
            k = self.kind
            if k == ".":
                self.i += 1
                if self.kind == "<":
                    self.type_arguments()
                if self.kind == "new":
                    self.new()
                    result = "call"
                elif self.kind in ("this", "class", "super"):
                    self.i += 1
                    result = "value"
                else:
                    self.need("name")
                    result = "target"
            elif k == "(" and result in ("target", "constructor"):
                self.i += 1
                self.arguments()
                result = "call"
            elif k == "[":
                self.i += 1
                self.expression()
                self.need("]")
                result = "target"
            elif k == "::":
                self.i += 1
                if self.kind == "<":
                    self.type_arguments()
                if not self.take("new"):
                    self.need("name")
                result = "value"
            else:
                return "value" if result == "constructor" else result

    def primary(self) -> str:
        k = self.kind
        if k == "name":
            if self.kinds[self.i + 1] in ("<", "[") and self.attempt(self.reference):
                return "value"
            self.i += 1
            return "target"
        if k in ("number", "string", "true", "false", "null"):
            self.i += 1
            return "value"
        if k in ("this", "super"):
            self.i += 1
            return "constructor"
        if k == "(":
            self.i += 1
            result = self.expression()
            self.need(")")
            return "target" if result == "target" and self.kind != "(" else "value"
        if k == "new":
            self.new()
            return "call"
        if k == "switch":
            self.i += 1
            self.switch()
            return "value"
        if k in _PRIMITIVE:
            self.type()
            if self.take("."):
                self.need("class")
            elif self.kind != "::":
                raise self.fail("expected an expression")
            return "value"
        raise self.fail("expected an expression")

    def new(self) -> None:
        self.need("new")
        self.annotations()
        if self.kind in _PRIMITIVE:
            self.i += 1
        else:
            while True:
                self.need("name")
                if self.kind == "<":
                    self.type_arguments()
                if not self.take("."):
                    break
        if self.take("("):
            self.arguments()
            if self.kind == "{":
                self.class_body("class")
        elif self.kind == "[":
            if self.dimensions():
                self.initializer()
            else:
                while self.kind == "[" and self.kinds[self.i + 1] != "]":
                    self.i += 1
                    self.expression()
                    self.need("]")
                self.dimensions()
        else:
            raise self.fail("expected '(' or '['")


def parse(text: str) -> list[tuple[int, str]]:
    c = _Parser(text)
    try:
        c.unit()
    except Stop:
        pass
    return c.errors
