import random

import pytest

from dialogforge.llm import stuffing

D = "doc_id bigint, text string, url string, origin string, host string"
PROSE = "The reviewer wanted the parser to stay readable, and the author agreed after a look at the second queue. We moved the cache into the worker last week and now the job ends with an error. A good reply keeps the order in mind and says why the first attempt was wrong. It also names the test that failed. "
LINKS = "\n".join(f"https://site{k}.example/page_{k}" for k in range(20))
TAGS = ", ".join(["cheap parser", "queue online", "best cache", "worker price"] * 10)
STUFFED = "Find cheap parser and cheap queue with cheap parser today. Why cheap parser? Because cheap parser. Our cheap parser is the best cheap parser! " * 4
PRODUCTS = "\n".join(f"Parsor queue {k} | XL | loose | {k}.99 | in stock" for k in range(20))


def density(text):
    return stuffing.evidence([text])[0][0]


@pytest.mark.parametrize("text", [LINKS, TAGS, STUFFED, PRODUCTS, "A sentence that leads in. " + "\n" + LINKS, "\n".join(["cheap parser", "queue"] * 20), " ".join(["cheap parser queue online"] * 15), '<a href="http://x.example/a">parser</a> ' * 12])
def test_stuffed_pages_have_high_density(text):
    assert density(text) > 0.7


@pytest.mark.parametrize("text", [PROSE, PROSE + "\n\n- the queue in `a`\n- the cache in `b`\n\nSee also https://x.example/a", PROSE + "\n\n| name | type |\n|---|---|\n| a | int |", PROSE + "\n```python\nx = 1\ny = 2\n```", "# Title\n\n" + PROSE])
def test_ordinary_pages_have_low_density(text):
    assert density(text) < 0.4


def test_phrases_keep_real_words_but_for_kinds():
    pages = [STUFFED.replace("parser", word) for word in ("parser", "widget")] + [TAGS, TAGS.replace("cheap parser", "cheap lexer"), "", "..."]
    found = [set(p.tolist()) for _, p, _ in stuffing.evidence(pages)]
    assert len(found[0] & found[1]) > 0.5 * len(found[0])  # within a clause the keyword stands for its kind
    assert found[2] & found[3] and found[2] != found[3]
    assert found[4] == found[5] == set()
    assert all(abs(a - b) < 1e-12 and (x == y).all() for (a, x, _), (b, y, _) in zip(stuffing.evidence(pages), [stuffing.evidence([p])[0] for p in pages]))


def entries(name, count=16):
    return "\n".join(f"{name}{k} {w}" for k, w in zip(range(count), ["queue", "cache", "worker", "lexer", "token", "batch", "graph", "index"] * 2))


def test_hosts_decide_on_pages_with_text_beside_a_list(spark, monkeypatch):
    half = PROSE[:150] + "\n" + entries("cheap")
    other = PROSE[150:] + "\n" + entries("cheap")
    rows = [(1, half, "https://a.example/x", None, None), (2, other, "https://b.example/x", None, None)]  # one list on two hosts
    rows += [(3, half.replace("cheap", "dear"), "https://a.example/y", None, None), (4, other.replace("cheap", "dear"), "https://a.example/z", None, None)]  # on one host
    rows += [(k, half.replace("cheap", "loose"), f"https://h{k}.example/", None, None) for k in (5, 6)]  # copies of one page
    df = spark.createDataFrame(rows, D)
    assert 0.45 < density(half) < stuffing.CASE and 0.45 < density(other) < stuffing.CASE
    assert {r.doc_id for r in stuffing.find_stuffed(df).collect()} == {1, 2}
    hosts = {r.phrase: r.hosts for r in stuffing.replicated_phrases(stuffing.page_evidence(df)).collect()}
    assert set(hosts.values()) == {2} and len(hosts) >= 16
    nothing = stuffing.replicated_phrases(stuffing.page_evidence(df)).filter("hosts < 0")
    monkeypatch.setattr(stuffing, "replicated_phrases", lambda pages: nothing)
    assert stuffing.find_stuffed(df).count() == 0  # without the hosts the case is lost


def test_pages(spark):
    rows = [(1, LINKS, None, "a", "x"), (2, LINKS.replace("page", "leaf"), "https://b.example/x", None, "x"), (3, PROSE, None, None, None), (4, None, None, "a", None), (None, LINKS, None, "a", None), (5, "", None, "a", None), (6, STUFFED, None, None, None), (6, STUFFED, None, None, None), (7, PROSE * 300, None, "a", None)]
    df = spark.createDataFrame(rows, D)
    got = {r.doc_id: r for r in stuffing.find_stuffed(df).collect()}
    assert set(got) == {1, 2, 6} and abs(got[1].stitched - 1) < 1e-9 and got[6].stitched == 0.0
    assert stuffing.find_stuffed(df.limit(0)).count() == 0


def random_lines(rng, count):
    pieces = ["cheap", "The", "a_b", "_x", "__init__", "x__y", "_", "-", " - ", "  ", "\t-\t", " -\t", "\t- ", " ", ", ", "|", "# ", "42 ", "é", "İ", "ſo", "·", "•", ";", "/", ">", "...", ": ", "\r", "\x0b", "\x1c", "\x00", "\x7f", "\x85", "\xa0", "(x)", "[1] ", "- ", "'", '"', "²"]
    for _ in range(count):
        few = rng.sample(pieces, rng.choice([5, 12, len(pieces)]))
        yield rng.choice(["", " ", ", "]).join(rng.choice(few) for _ in range(rng.choice([0, 3, 10, 40])))


def test_tables_of_bytes_part_lines_like_the_regular_expressions():
    clauses = lambda tokens: [c.split() for c in " ".join(t if t[0].isalnum() else "," for t in tokens).split(",") if c.split()]
    sizes = lambda parts, count: [n for n in map(count, parts) if n]
    for line in random_lines(random.Random(8), 5_000):
        tokens = stuffing._tokens(line)
        assert clauses(tokens) == clauses(stuffing._TOKEN.findall(line.lower())), line
        assert sizes(stuffing._parts(line), stuffing._word_count) == sizes(stuffing._PARTS.split(line), lambda x: len(stuffing._WORD.findall(x))), line
        assert stuffing._word_count(line) == len(stuffing._WORD.findall(line)), line


def test_plain_lines_need_no_regular_expression(monkeypatch):
    whole = [stuffing.evidence([text]) for text in (PROSE, TAGS, STUFFED, PRODUCTS, "a_b __c__\n\n```x\n1```" + PROSE)]
    for name in ("_TOKEN", "_PARTS", "_WORD"):
        monkeypatch.setattr(stuffing, name, None)
    again = [stuffing.evidence([text]) for text in (PROSE, TAGS, STUFFED, PRODUCTS, "a_b __c__\n\n```x\n1```" + PROSE)]
    assert all(a[0] == b[0] and (a[1] == b[1]).all() and (a[2] == b[2]).all() for (a,), (b,) in zip(whole, again))
