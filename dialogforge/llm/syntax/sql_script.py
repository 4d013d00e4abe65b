"""SQL statements."""

from __future__ import annotations

import re

from dialogforge.llm.syntax.base import Cursor, Stop

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<string>[eEnNbBxX]?'(?:[^']|'')*'|\$\$.*?\$\$)|(?P<quoted>"(?:[^"]|"")+"|`[^`]+`|\[[^\W\d]\w*\])|(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?!\w))|(?P<name>[^\W\d][\w$]*)"""
    r"""|(?P<op>::|<=>|<>|!=|<=|>=|\|\||->>|->|:=|[-+*/%^(),.;=<>?:@\[\]&|~])""",
    re.S,
)
#: Words that end an expression or a table name; they are no aliases or column names here.
_RESERVED = frozenset(
    "select from where group having order limit offset union intersect except join inner left right full cross natural on using as and or not in is null like ilike between case when then else end exists distinct all with insert into values update set delete create table view index drop alter primary foreign key references check unique default constraint returning fetch for window".split()
)
_BINARY = {"or": 1, "and": 2, "=": 4, "<>": 4, "!=": 4, "<": 4, ">": 4, "<=": 4, ">=": 4, "<=>": 4, "|": 5, "&": 5, "||": 6, "->": 6, "->>": 6, "+": 7, "-": 7, "*": 8, "/": 8, "%": 8, "^": 9}


class _Parser(Cursor):
    """Words are compared in lower case: a name's kind is its lower-case text if reserved, else "name"."""

    def __init__(self, text: str) -> None:
        super().__init__(text)
        at, end = 0, len(text)
        while at < end:
            m = _TOKEN.match(text, at)
            if m is None:
                self.add("bad", text[at], at)
                at += 1
                continue
            group = m.lastgroup
            if group not in ("space", "comment"):
                value = m.group().lower() if group == "name" else m.group()
                kind = value if group == "op" or group == "name" and value in _RESERVED else "name" if group in ("name", "quoted") else group
                self.add(kind, value, at)
            at = m.end()
        self.add("eof", "", end)

    def word(self, *words: str) -> bool:
        """Take these words, reserved or not, if they stand here."""
        if all(self.values[j] == w for j, w in zip(range(self.i, len(self.values)), words)) and self.i + len(words) < len(self.values):
            self.i += len(words)
            return True
        return False

    def expect(self, *words: str) -> None:
        if not self.word(*words):
            raise self.fail(f"expected {' '.join(words)}")

    def script(self) -> None:
        while self.kind != "eof":
            if self.take(";"):
                continue
            begin = self.i
            try:
                self.statement()
                if self.kind != "eof":
                    self.need(";")
            except Stop:
                self.recover(begin, (";",))

    def statement(self) -> None:
        v = self.values[self.i]
        if self.kind in ("select", "with", "values", "("):
            self.query()
        elif v == "insert":
            self.i += 1
            self.expect("into")
            self.name()
            if self.word("as"):
                self.need("name")
            if self.kind == "(" and self.kinds[self.i + 1] not in ("select", "with"):
                self.columns()
            if not self.word("default", "values"):
                self.query()
            if self.word("on", "conflict"):
                if self.kind == "(":
                    self.columns()
                self.expect("do")
                if not self.word("nothing"):
                    self.expect("update", "set")
                    self.assignments()
                    self.where()
            self.returning()
        elif v == "update":
            self.i += 1
            self.name()
            self.alias()
            self.expect("set")
            self.assignments()
            if self.word("from"):
                self.tables()
            self.where()
            self.returning()
        elif v == "delete":
            self.i += 1
            self.expect("from")
            self.name()
            self.alias()
            if self.word("using"):
                self.tables()
            self.where()
            self.returning()
        elif v == "create":
            self.create()
        elif v == "drop":
            self.i += 1
            if not (self.word("table") or self.word("view") or self.word("index") or self.word("schema") or self.word("database") or self.word("materialized", "view") or self.word("type") or self.word("function") or self.word("sequence")):
                raise self.fail("expected what to drop")
            self.word("if", "exists")
            self.name()
            while self.take(","):
                self.name()
            if not self.word("cascade"):
                self.word("restrict")
        elif v == "alter":
            self.alter()
        elif v == "truncate":
            self.i += 1
            self.word("table")
            self.name()
        elif v in ("begin", "commit", "rollback"):
            self.i += 1
            if not self.word("transaction"):
                self.word("work")
        elif v == "explain":
            self.i += 1
            self.word("analyze")
            self.statement()
        elif v == "set" or v == "use":
            self.i += 1
            self.name()
            if self.take("=") or self.word("to"):
                self.expression()
        elif v in ("grant", "revoke", "copy", "lock", "vacuum", "reindex", "cluster", "notify", "listen"):
            self.i += 1
            self.rest()
        elif v == "merge":
            self.merge()
        elif v == "call":
            self.i += 1
            self.name()
            self.need("(")
            if not self.take(")"):
                self.list()
                self.need(")")
        elif v == "declare":
            self.i += 1
            self.need("name")
            self.rest()
        elif v == "analyze":
            self.i += 1
            self.word("verbose")
            if self.kind == "name":
                self.name()
                if self.kind == "(":
                    self.columns()
        elif v == "comment":
            self.i += 1
            self.expect("on")
            while self.kind not in ("is", ";", "eof", "bad"):
                self.i += 1
            self.expect("is")
            if not self.take("null"):
                self.need("string")
        elif v == "refresh":
            self.i += 1
            self.expect("materialized", "view")
            self.word("concurrently")
            self.name()
            if self.word("with"):
                self.word("no")
                self.expect("data")
        elif v in ("savepoint", "release", "deallocate", "execute", "prepare"):
            self.i += 1
            self.word("savepoint")
            self.need("name")
            self.rest(empty=True)
        else:
            raise self.fail("expected a statement")

    def rest(self, empty: bool = False) -> None:
        """What this grammar does not know of a statement; its brackets must close and its tokens be whole."""
        begin = self.i
        while self.kind not in (";", "eof"):
            if self.kind == "(":
                self.balanced()
            elif self.kind in ("bad", ")"):
                raise self.fail("unexpected token")
            else:
                self.i += 1
        if self.i == begin and not empty:
            raise self.fail("unfinished statement")

    def merge(self) -> None:
        self.i += 1
        self.expect("into")
        self.name()
        self.alias()
        self.expect("using")
        self.table()
        self.expect("on")
        self.expression()
        count = 0
        while self.take("when"):
            count += 1
            self.word("not")
            self.expect("matched")
            if self.word("by"):
                if not self.word("source"):
                    self.expect("target")
            if self.take("and"):
                self.expression()
            self.expect("then")
            if self.word("update"):
                self.expect("set")
                self.assignments()
            elif self.word("insert"):
                if self.kind == "(":
                    self.columns()
                if not self.word("default", "values"):
                    self.expect("values")
                    self.need("(")
                    self.list()
                    self.need(")")
            elif not self.word("delete") and not self.word("do", "nothing"):
                raise self.fail("expected update, insert or delete")
        if not count:
            raise self.fail("expected when")

    def name(self) -> None:
        self.need("name")
        while self.take("."):
            self.need("name")

    def columns(self) -> None:
        self.need("(")
        self.need("name")
        while self.take(","):
            self.need("name")
        self.need(")")

    def where(self) -> None:
        if self.take("where"):
            self.expression()

    def returning(self) -> None:
        if self.take("returning"):
            self.outputs()

    def assignments(self) -> None:
        while True:
            if self.kind == "(":
                self.columns()
            else:
                self.name()
            self.need("=")
            if not self.take("default"):
                self.expression()
            if not self.take(","):
                return

    def alias(self) -> None:
        if self.take("as") or self.kind == "name" and self.values[self.i] != "tablesample":
            self.need("name")
            if self.kind == "(" and self.kinds[self.i + 1] == "name":
                self.columns()

    def create(self) -> None:
        self.i += 1
        self.word("or", "replace")
        if not self.word("temporary"):
            self.word("temp")
        unique = self.word("unique")
        if self.word("index"):
            self.word("concurrently")
            self.word("if", "not", "exists")
            if self.kind == "name":
                self.name()
            self.expect("on")
            self.name()
            if self.word("using"):
                self.need("name")
            self.need("(")
            self.ordering()
            self.need(")")
            self.where()
        elif unique:
            raise self.fail("expected index")
        elif self.word("table"):
            self.word("if", "not", "exists")
            self.name()
            if self.take("as"):
                self.query()
                return
            self.need("(")
            while True:
                self.table_element()
                if not self.take(","):
                    break
            self.need(")")
            while self.kind not in (";", "eof"):  # storage options
                if self.take("as"):
                    self.query()
                    return
                if self.kind == "(":
                    self.balanced()
                elif self.kind in ("name", "with", "=", "number", "string", "on", "default", "using", ","):
                    self.i += 1
                else:
                    raise self.fail("unexpected word")
        elif self.word("view") or self.word("materialized", "view"):
            self.word("if", "not", "exists")
            self.name()
            if self.kind == "(":
                self.columns()
            self.expect("as")
            self.query()
        elif self.word("schema") or self.word("database") or self.word("sequence") or self.word("extension"):
            self.word("if", "not", "exists")
            self.name()
        elif self.word("function") or self.word("procedure") or self.word("trigger") or self.word("type"):
            self.name()
            self.rest()
        else:
            raise self.fail("expected what to create")

    def balanced(self) -> None:
        self.need("(")
        self.enter()
        while not self.take(")"):
            if self.kind == "(":
                self.balanced()
            elif self.kind in (";", "eof", "bad"):
                raise self.fail("unclosed parenthesis")
            else:
                self.i += 1
        self.leave()

    def table_element(self) -> None:
        if self.take("constraint"):
            self.need("name")
        if self.kind in ("primary", "unique", "foreign", "check"):
            self.constraint()
            return
        self.need("name")
        self.type()
        while self.kind not in (",", ")"):
            if self.take("constraint"):
                self.need("name")
            self.constraint()

    def type(self) -> None:
        self.need("name")
        while self.kind == "name" and self.values[self.i] in ("precision", "varying", "unsigned", "with", "without", "time", "zone", "character"):
            self.i += 1
        if self.take("("):
            self.need("number") if self.kind != "name" else self.need("name")
            if self.take(","):
                self.need("number")
            self.need(")")
        if self.word("with", "time", "zone") or self.word("without", "time", "zone"):
            pass
        if self.kind == "<":
            level = 0
            while self.kind not in ("eof", ";"):
                level += (self.kind == "<") - (self.kind == ">")
                self.i += 1
                if not level:
                    break
        while self.take("["):
            self.take("number")
            self.need("]")

    def constraint(self) -> None:
        if self.word("not", "null") or self.word("null") or self.word("unique") and self.kind != "(":
            return
        if self.word("primary", "key"):
            if self.kind == "(":
                self.columns()
            if not self.word("asc"):
                self.word("desc")
            self.word("autoincrement")
        elif self.values[self.i - 1] == "unique" and self.kind == "(":
            self.columns()
        elif self.word("default"):
            self.binary(3)
        elif self.word("check"):
            self.need("(")
            self.expression()
            self.need(")")
        elif self.word("foreign", "key"):
            self.columns()
            self.references()
        elif self.kind == "references":
            self.references()
        elif self.word("collate"):
            self.need("name")
        elif self.word("generated"):
            while self.kind == "name" or self.kind == "as":
                self.i += 1
            if self.kind == "(":
                self.balanced()
            self.word("stored")
        elif self.word("auto_increment") or self.word("autoincrement") or self.word("comment") and self.take("string"):
            pass
        else:
            raise self.fail("expected a constraint")

    def references(self) -> None:
        self.expect("references")
        self.name()
        if self.kind == "(":
            self.columns()
        while self.word("on"):
            if not self.word("delete"):
                self.expect("update")
            if not (self.word("cascade") or self.word("restrict") or self.word("set", "null") or self.word("set", "default")):
                self.expect("no", "action")

    def alter(self) -> None:
        self.i += 1
        self.expect("table")
        self.word("if", "exists")
        self.name()
        while True:
            if self.word("add"):
                if self.word("column") or self.kind == "name":
                    self.word("if", "not", "exists")
                    self.table_element()
                else:
                    self.table_element()
            elif self.word("drop"):
                if not self.word("column"):
                    self.word("constraint")
                self.word("if", "exists")
                self.need("name")
                self.word("cascade")
            elif self.word("rename"):
                if self.word("column") or self.kind == "name" and self.values[self.i] != "to":
                    self.need("name")
                self.expect("to")
                self.need("name")
            elif self.word("alter") or self.word("modify"):
                self.word("column")
                self.need("name")
                if self.word("set", "default"):
                    self.expression()
                elif self.word("set", "data", "type") or self.word("type"):
                    self.type()
                elif not (self.word("drop", "default") or self.word("set", "not", "null") or self.word("drop", "not", "null")):
                    self.type()
            else:
                raise self.fail("expected a change")
            if not self.take(","):
                return

    # Queries.

    def query(self) -> None:
        self.enter()
        if self.take("with"):
            self.word("recursive")
            while True:
                self.need("name")
                if self.kind == "(":
                    self.columns()
                self.expect("as")
                if not self.word("materialized"):
                    self.word("not", "materialized")
                self.need("(")
                self.statement()
                self.need(")")
                if not self.take(","):
                    break
            if self.kind not in ("select", "values", "("):
                self.statement()
                self.leave()
                return
        self.term()
        while self.kind in ("union", "intersect", "except"):
            self.i += 1
            if not self.take("all"):
                self.take("distinct")
            self.term()
        if self.take("order"):
            self.expect("by")
            self.ordering()
        while self.kind in ("limit", "offset", "fetch", "for"):
            if self.take("limit"):
                if not self.take("all"):
                    self.expression()
                if self.take(","):
                    self.expression()
            elif self.take("offset"):
                self.expression()
                if not self.word("rows"):
                    self.word("row")
            elif self.take("fetch"):
                if not self.word("first"):
                    self.expect("next")
                self.take("number")
                if not self.word("rows"):
                    self.expect("row")
                self.expect("only")
            else:
                self.i += 1
                if not self.word("update"):
                    self.expect("share")
        self.leave()

    def ordering(self) -> None:
        while True:
            self.expression()
            if not self.word("asc"):
                self.word("desc")
            if self.word("nulls") and not self.word("first"):
                self.expect("last")
            if not self.take(","):
                return

    def term(self) -> None:
        if self.take("("):
            self.query()
            self.need(")")
            return
        if self.take("values"):
            while True:
                self.need("(")
                while True:
                    if not self.take("default"):
                        self.expression()
                    if not self.take(","):
                        break
                self.need(")")
                if not self.take(","):
                    return
        self.need("select")
        if self.take("distinct"):
            if self.take("on"):
                self.need("(")
                self.list()
                self.need(")")
        else:
            self.take("all")
        self.outputs()
        if self.take("into"):
            self.name()
        if self.take("from"):
            self.tables()
        self.where()
        if self.take("group"):
            self.expect("by")
            self.list()
        if self.take("having"):
            self.expression()
        if self.take("window"):
            while True:
                self.need("name")
                self.expect("as")
                self.window()
                if not self.take(","):
                    break

    def list(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def outputs(self) -> None:
        while True:
            if not self.take("*"):
                self.expression(star=True)
                if self.take("as"):
                    if self.kind != "string":
                        self.need("name")
                    else:
                        self.i += 1
                else:
                    self.take("name")
            if not self.take(","):
                return

    def tables(self) -> None:
        while True:
            self.table()
            while True:
                natural = self.take("natural")
                if self.take("cross"):
                    self.need("join")
                    self.table()
                    continue
                if self.kind in ("left", "right", "full"):
                    self.i += 1
                    self.word("outer")
                    self.need("join")
                elif self.take("inner"):
                    self.need("join")
                elif not self.take("join"):
                    if natural:
                        raise self.fail("expected join")
                    break
                self.table()
                if self.take("on"):
                    self.expression()
                elif self.take("using"):
                    self.columns()
                elif not natural:
                    raise self.fail("join without a condition")
            if not self.take(","):
                return

    def table(self) -> None:
        self.word("lateral")
        if self.take("("):
            if self.kind in ("select", "with", "values", "("):
                self.query()
            else:
                self.tables()
            self.need(")")
        else:
            self.name()
            if self.take("("):
                if not self.take(")"):
                    self.list()
                    self.need(")")
        self.alias()
        if self.word("tablesample"):
            self.need("name")
            self.balanced()
            if self.word("repeatable"):
                self.balanced()

    # Expressions.

    def expression(self, star: bool = False) -> None:
        self.star = star
        self.binary(1)

    star = False

    def binary(self, least: int) -> None:
        """Precedence climbing; IS, IN, LIKE and BETWEEN stand at the level of comparisons."""
        self.enter()
        if self.kind == "not" and least <= 3:
            self.i += 1
            self.binary(3)
        else:
            self.unary()
        while True:
            k = self.kind
            level = _BINARY.get(k)
            if level is not None:
                if level < least:
                    break
                self.i += 1
                if level == 4 and (self.word("any") or self.word("some") or self.word("all")):
                    self.need("(")
                    self.query() if self.kind in ("select", "with") else self.expression()
                    self.need(")")
                else:
                    self.binary(level + 1)
                continue
            if least > 4 or k not in ("is", "in", "like", "ilike", "between", "not"):
                break
            negated = self.take("not")
            if self.take("is"):
                if negated:
                    raise self.fail("misplaced not")
                self.take("not")
                if self.take("distinct"):
                    self.need("from")
                    self.binary(5)
                elif not (self.take("null") or self.word("true") or self.word("false") or self.word("unknown")):
                    raise self.fail("expected null")
            elif self.take("in"):
                self.need("(")
                if self.kind in ("select", "with", "values"):
                    self.query()
                else:
                    self.list()
                self.need(")")
            elif self.take("like") or self.take("ilike"):
                self.binary(5)
                if self.word("escape"):
                    self.binary(5)
            elif self.take("between"):
                self.binary(5)
                self.need("and")
                self.binary(5)
            else:
                raise self.fail("expected in, like or between")
        self.leave()

    def unary(self) -> None:
        while self.take("-") or self.take("+") or self.take("~"):
            pass
        self.primary()
        while True:
            if self.take("::"):
                self.type()
            elif self.take("["):
                if self.kind != ":":
                    self.expression()
                if self.take(":") and self.kind != "]":
                    self.expression()
                self.need("]")
            elif self.word("at", "time", "zone"):
                self.primary()
            else:
                return

    def primary(self) -> None:
        k = self.kind
        if k in ("number", "string", "null"):
            self.i += 1
        elif k == "?":
            self.i += 1
        elif k in (":", "@"):
            self.i += 1
            self.need("name")
        elif k == "(":
            self.i += 1
            if self.kind in ("select", "with", "values"):
                self.query()
            else:
                self.list()
            self.need(")")
        elif k == "case":
            self.i += 1
            if self.kind != "when":
                self.expression()
            if self.kind != "when":
                raise self.fail("expected when")
            while self.take("when"):
                self.expression()
                self.need("then")
                self.expression()
            if self.take("else"):
                self.expression()
            self.need("end")
        elif k == "exists":
            self.i += 1
            self.need("(")
            self.query()
            self.need(")")
        elif k == "name" or k in ("left", "right") and self.kinds[self.i + 1] == "(":
            self.named()
        else:
            raise self.fail("expected an expression")

    def named(self) -> None:
        v = self.values[self.i]
        if v == "cast" and self.kinds[self.i + 1] == "(":
            self.i += 2
            self.expression()
            self.expect("as")
            self.type()
            self.need(")")
            return
        if v in ("interval", "date", "timestamp", "time") and self.kinds[self.i + 1] == "string":
            self.i += 2
            if v == "interval" and self.values[self.i] in ("day", "days", "hour", "hours", "minute", "minutes", "month", "months", "year", "years", "second", "seconds"):
                self.i += 1
            return
        if v == "extract" and self.kinds[self.i + 1] == "(":
            self.i += 2
            self.need("name")
            self.need("from")
            self.expression()
            self.need(")")
            return
        self.i += 1
        while self.take("."):
            if self.kind == "*" and self.star:
                self.i += 1
                return
            self.need("name")
        if self.take("("):
            if self.take("*"):
                self.need(")")
            elif not self.take(")"):
                self.take("distinct")
                while True:
                    if self.kind in ("select", "with"):
                        self.query()
                    else:
                        self.expression()
                    if self.take("from") or self.take("for") or self.take("in"):
                        self.expression()
                        if self.take("for"):
                            self.expression()
                    if not self.take(","):
                        break
                if self.take("order"):
                    self.expect("by")
                    self.ordering()
                self.need(")")
            if self.word("within", "group"):
                self.need("(")
                self.expect("order", "by")
                self.ordering()
                self.need(")")
            if self.word("filter"):
                self.need("(")
                self.need("where")
                self.expression()
                self.need(")")
            if self.word("over"):
                if not self.take("name"):
                    self.window()

    def window(self) -> None:
        self.need("(")
        self.take("name") if self.values[self.i] not in ("partition", "rows", "range") else None
        if self.word("partition", "by"):
            self.list()
        if self.take("order"):
            self.expect("by")
            self.ordering()
        if self.word("rows") or self.word("range") or self.word("groups"):
            between = self.word("between")
            self.bound()
            if between:
                self.expect("and")
                self.bound()
        self.need(")")

    def bound(self) -> None:
        if self.word("current", "row"):
            return
        if not self.word("unbounded"):
            self.binary(5)
        if not self.word("preceding"):
            self.expect("following")


def parse(text: str) -> list[tuple[int, str]]:
    c = _Parser(text)
    try:
        if c.kind == "eof":
            c.note("no statement")
        c.script()
    except Stop:
        pass
    return c.errors
