import ast
import glob
import json
import os
import random
import subprocess

import pytest

from dialogforge.llm.source_files import invalid_files, invalid_rates, parsed_files
from dialogforge.llm.syntax import UNJUDGED, errors_of

VALID = {
    "py": ["x = 1", "", "# only a comment", "async def f(a, /, b=1, *, c, **k):\n    async with a as b, c:\n        return [i async for i in b if i]\n", "match x:\n    case [1, *rest] if rest:\n        pass\n    case {'a': 1, **r} | None as q:\n        pass\n", "try:\n    pass\nexcept* E as e:\n    raise X from e\n", "BAD = '<<<<<<< HEAD'\n", "x: int = (yield)\nprint(*a, **b)\nlambda *a, k=1: (a, k)\n", "def f[T: int](x: T) -> T: return x\n", "x = f'{a[\"b\"]!r:>{w}} {{}} {f(\"y\", {1: 2})}' f\"{d[\"k\"]:%H:%M}\"\ny = rf'\\d{n}'\n", "a, *b = c = 1, 2\na[1:2, ::3] = b\nif (n := 1): pass\n"],
    "js": ["let {a, b: [c] = [1], ...d} = e;", "class A extends B { #x = 1; static async *f() { yield* this.#x } get y() { return `a${`b${1}`}` } }", "for (const x of y) label: for (;;) { break label }", "const f = async (a, b = /[/]\"/g) => ({a, ...b})\nf?.(1) ?? 2", "if (a) b\nelse c\nreturn_ = 1 / 2 / 3", "switch (a) { case 1: b(); default: }", "var t = `<<<<<<< ${'`'}`"],
    "java": ["package a.b; import java.util.*; @X(a = 1) public final class A<T extends B & C> implements D { int[] a = {1, 2}; <U> A(List<? super U> u) throws E { this.<U>f(); } static { } }", "record P(int x) { P { if (x < 0) throw new E(); } }", "interface I { default void f() { var x = (Runnable) () -> g(a >> 2, b >>> 3); for (int i = 0, j; i < 3; i++) ; } }", "enum E { A(1) { }, B; int f(Object o) { return switch (o) { case String s when s.length() > 1 -> 1; default -> { yield 2; } }; } }", 'class T { String s = """\n  "x" {{\n  """; Function<A, B> f = A::new; int[][] y = new int[2][]; }'],
    "go": ['package a\n\nimport (\n\t"fmt"\n\tx "y"\n)\n\ntype T[K comparable] struct {\n\ta, b int `json:"a"`\n\t*E\n}\n\nfunc (t *T[K]) F(a, b int, c ...string) (n int, err error) {\n\tif v, ok := m[a]; ok && v == (P{1}) {\n\t\treturn\n\t}\n\tfor i := range xs {\n\t\tgo func() { ch <- i }()\n\t}\n\tswitch x := y.(type) {\n\tcase int, *T[string]:\n\t\tfmt.Println([]int{1, 2}[:1], map[string]P{"a": {1}})\n\tdefault:\n\t}\n\tselect {\n\tcase v := <-ch:\n\t\t_ = v\n\t}\n\treturn 1, nil\n}\n'],
    "sql": ["SELECT a.*, count(*) FILTER (WHERE x) AS n FROM t AS a LEFT JOIN u USING (id) WHERE a.b NOT IN (1, 2) AND c BETWEEN 1 AND 2 OR d IS NOT NULL GROUP BY 1 HAVING sum(x) > 3 ORDER BY 2 DESC LIMIT 5;", "CREATE TABLE t (a BIGINT NOT NULL PRIMARY KEY, b DECIMAL(10, 2) DEFAULT 0, UNIQUE (a, b)); INSERT INTO t (a) VALUES (1), (2);", "WITH RECURSIVE c AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM c) SELECT CASE WHEN n > 1 THEN 'it''s' END, row_number() OVER (PARTITION BY n ORDER BY n) FROM c", "UPDATE t SET a = a + 1 WHERE EXISTS (SELECT 1 FROM u); -- end"],
    "json": ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"]}', "1", '""', " [] "],
    "sh": ["#!/bin/bash\nset -eu\nf() {\n  local a=(1 \"$2\")\n  case \"$1\" in a|b) echo x ;; *) ;; esac\n}\n", "cat <<'E' > o\nit's (\nE\nif [[ $a =~ ^(x|y)$ ]]; then echo \"$(date +%s)\" | wc -l; fi", "for ((i = 0; i < 3; i++)); do echo $((i * (2 + 1))); done", "while read -r l; do echo \"${l%%\\}}\"; done < <(ls)"],
}
BROKEN = {
    "py": ["def f(:\n  pass", "  x = 1", "if x:\n", "x = (1,", "f() = 1", "<<<<<<< HEAD\nx = 1\n=======\nx = 2\n>>>>>>> b", "print 'x'", "def f(a=1, b): pass", "x = 'abc", "x = f'{'", "x = f'{}'", "x = f'}'", "x = f'{a'", "class A:\n    def f(self):\n        return 1\n   y = 2\n"],
    "js": ["function f( {", "var x = ;", "return 1;\n}", "import a from 'b'", "const a;", "let x = 1 2", "f(1,", "def f():\n    pass"],
    "java": ["public class A {", "var x = 1;", "class A { void f() { a + b; } }", "class A { int f( { } }", "class A { void f() { return } }"],
    "go": ["func f() {}", "package a\n\nfunc f() {", "package a\n\nx := 1\n", "package a\n\nfunc f() {\n\tif {\n\t}\n}\n", "package a\n\nfunc f() { a + b }\n"],
    "sql": ["SELECT FROM WHERE", "CREATE TABLE t (a", "SELEC 1", "SELECT a FROM t WHERE", "INSERT INTO t VALUES (1", "function f() {}"],
    "json": ["{", '{"a" 1}', "[1,]", "{'a': 1}", "01", "nul", '{"a": 1} x', '"a\nb"'],
    "sh": ["if true; then", "fi", "f() {", 'echo "x', "for x in a b; echo", "case x in a) echo", "echo $(ls", "a | | b", "}\nf"],
}


@pytest.mark.parametrize(("extension", "text"), [(e, t) for e, ts in VALID.items() for t in ts])
def test_valid(extension, text):
    assert errors_of(extension, text) == ([], "")


@pytest.mark.parametrize(("extension", "text"), [(e, t) for e, ts in BROKEN.items() for t in ts])
def test_broken(extension, text):
    errors, cause = errors_of(extension, text)
    assert errors and cause


def test_recovery_finds_later_errors_and_the_first_cause():
    errors, cause = errors_of("py", "x = (\n")
    assert len(errors) >= 1
    errors, cause = errors_of("py", "x = = 1\ny = 2\nz = = 3\n")
    assert len(errors) == 2 and cause == errors[0][1]
    assert errors_of("py", "<<<<<<< HEAD\nx\n")[1] == "merge conflict"


def test_python_agrees_with_the_compiler():
    files = sorted(glob.glob(os.path.dirname(os.__file__) + "/*.py"))[:40]
    for name in files:
        text = open(name, encoding="utf-8").read()
        lines = text.split("\n")
        for part in ("\n".join(lines[: len(lines) // 2]), "\n".join(lines[len(lines) // 3 : len(lines) // 2])):
            try:
                ast.parse(part)
                fine = True
            except SyntaxError:
                fine = False
            if fine:
                assert not errors_of("py", part)[0], name
            else:
                assert errors_of("py", part)[0], name


def test_deep_and_long_texts():
    assert errors_of("json", "[" * 900 + "]" * 900)[0] == []
    assert errors_of("json", "[" * 5000)[0]
    assert errors_of("py", "(" * 5000)[0]
    assert errors_of("json", json.dumps(list(range(50_000))))[0] == []


def test_tables(spark):
    schema = "msg_id bigint, repo string, file_path string, code_snippet string, valid string"
    rows = [(1, "r", "a.PY", "x = 1", "x"), (1, "r", "a.PY", "x = 1", "x"), (2, "r", "b.py", "x =", "x"), (2, "r", "b.py", "x =", "x"), (3, None, "c.json", "{", None), (4, "r", "d.rs", "fn", None), (5, "r", None, "x =", None), (6, "r", "e.py", "  \n", None), (None, "r", "f.py", "x =", None), (7, "r", "noext", "x", None), (8, "r", "g.py", None, None)]
    df = spark.createDataFrame(rows, schema)
    assert {(r.msg_id, r.language) for r in invalid_files(df).collect()} == {(2, "python"), (3, "json")}
    assert all(r.errors and r.cause for r in invalid_files(df).collect())
    rates = {(r.grouped, r.repo, r.language): (r.files, r.invalid, r.rate) for r in invalid_rates(df).collect()}
    assert rates["repo, language", "r", "python"] == (2, 1, 0.5) and rates["language", None, "json"] == (1, 1, 1.0) and rates["repo", None, None] == (1, 1, 1.0)
    assert parsed_files(df.limit(0)).count() == 0


SHELL = ["for x in a; do b; done 2>&1", "( a ) 2>/dev/null", "if a; then b; fi 2>/dev/null", "while a; do b; done < f 2> g", "f() { a; } 2>/dev/null", "[[ a ]] 2>/dev/null", "coproc x { y; }", "{ a; } {fd}> f 3<&-", "x=`ls | wc -l`", "for x.y in a; do b; done", "x=`if a; then`", "( a ) 2>", "{ a; } 2", "coproc", "x=`a", "f() { a; } 2> ; b"]
SQL_VALID = ["MERGE INTO t USING s ON t.a = s.a WHEN MATCHED AND s.b > 1 THEN UPDATE SET b = s.b WHEN NOT MATCHED THEN INSERT (a, b) VALUES (s.a, s.b)", "CALL p(1, 'x')", "COPY t (a, b) FROM '/f.csv' WITH (FORMAT csv)", "DECLARE c CURSOR FOR SELECT 1", "ANALYZE t", "SELECT * FROM t TABLESAMPLE BERNOULLI (10) REPEATABLE (1)", "COMMENT ON TABLE t IS 'x'", "LOCK TABLE t IN SHARE MODE", "REFRESH MATERIALIZED VIEW CONCURRENTLY v", "SELECT a[1:2], b[:3], c[4] FROM t", "GRANT SELECT ON t TO u", "CREATE FUNCTION f(a int) RETURNS int AS $$ SELECT 1; $$ LANGUAGE sql"]
SQL_BROKEN = ["MERGE INTO t USING s ON t.a = s.a", "CALL p", "COMMENT ON TABLE t", "GRANT", "CREATE FUNCTION f(a int", "REFRESH VIEW v", "SELECT * FROM t TABLESAMPLE", "COPY t (a", "CREATE FUNCTION f() RETURNS int AS $$ SELECT 1;"]
PYTHON = ['"""a"\nx = 1\n', "x = '''a''", 'x = ""\ny = "" ""', 'f"""{a}"', "x = b'é'", "u'a' b'b'", "b'a' b'b'", "f(x for x in y, 1)", "f(1, x for x in y)", "f((x for x in y), 1)", "a := 1", "(a := 1)", "x = f'{a +}'", "x = f'{a!r:>{w}} {b=} {c == d} {lambda_}'", "x = f'{m\\anifest}'", "x = f'{samp!ler}'", "x = f'{if}'", "x = f'{f\"{y}\"}'", "x = f'{ {1: 2}[1] }'"]


@pytest.mark.parametrize("text", SHELL)
def test_shell_agrees_with_bash(text):
    fine = subprocess.run(["bash", "-n"], input=text.encode(), capture_output=True).returncode == 0
    assert (errors_of("sh", text)[0] == []) == fine


@pytest.mark.parametrize("text", PYTHON)
def test_python_details(text):
    try:
        ast.parse(text)
        fine = True
    except SyntaxError:
        fine = False
    assert (errors_of("py", text)[0] == []) == fine


def test_sql_statements():
    assert [t for t in SQL_VALID if errors_of("sql", t)[0]] == []
    assert [t for t in SQL_BROKEN if not errors_of("sql", t)[0]] == []


def test_templates_are_parsed():
    assert errors_of("js", "x = `a ${b + 1} ${f(`${c}`)}`")[0] == []
    assert errors_of("js", "x = `a ${b +}`")[0] and errors_of("js", "x = `${}`")[0]


def test_json_resumes_within_the_container():
    assert len(errors_of("json", '{"a": 1, "b":, "c": 2, "d" 3}')[0]) == 2
    assert len(errors_of("json", '[1, , {"a" 1, "b": [1 2, 3]}, nul]')[0]) == 4
    assert errors_of("json", "[" * 200_000 + "]" * 200_000)[0] == []
    assert errors_of("json", "[" * 1_200 + "{}")[0]


def test_depth_gives_no_verdict(spark):
    deep = "x = " + "(" * 30_000 + "1" + ")" * 30_000
    assert errors_of("js", deep) == ([], UNJUDGED)
    assert errors_of("js", "x = ;\n" + deep)[0]  # errors before it count
    assert errors_of("js", "x = " + "(" * 1_200 + "1" + ")" * 1_200)[0] == []
    rows = spark.createDataFrame([(1, "r", "a.js", deep), (2, "r", "a.js", "x = ;")], "msg_id bigint, repo string, file_path string, code_snippet string")
    assert [r.msg_id for r in invalid_files(rows).collect()] == [2]
    assert {r.msg_id: (r.valid, r.cause) for r in parsed_files(rows).collect()}[1] == (None, UNJUDGED)


def mutated(rng, text):
    at = rng.randrange(len(text))
    return [text[:at] + text[at + 1 :], text[:at] + rng.choice("(){}[]:;,\"'`|&<>=*\\\n #$!.@") + text[at:], text[: at + 1], text[:at] + text[at + rng.randrange(1, 12) :]][rng.randrange(4)]


@pytest.mark.parametrize("extension", ["py", "json", "sh"])
def test_agreement_on_generated_texts(extension):
    rng = random.Random(8)
    seeds = VALID[extension] + ['{"a": [1, 2.5, {"b": null}], "c": "x"}'] * (extension == "json")

    def fine(text):
        try:
            if extension == "sh":
                return subprocess.run(["bash", "-n"], input=text.encode(), capture_output=True).returncode == 0
            ast.parse(text) if extension == "py" else json.loads(text)
            return True
        except (SyntaxError, ValueError):
            return False

    texts = [mutated(rng, rng.choice([s for s in seeds if s])) for _ in range(500)]
    differ = [t for t in texts if (errors_of(extension, t)[0] == []) != fine(t)]
    assert len(differ) <= (0 if extension == "json" else 25), differ  # bash and Python check more than their grammar
