import difflib
import random

import pytest

from dialogforge.operators import dedup
from dialogforge.operators.components import components

ROWS = "scope string, line bigint, key string"


def brute(keys, threshold):
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lines = sorted(keys)
    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if keys[a] and keys[b] and difflib.SequenceMatcher(None, keys[a], keys[b]).ratio() >= threshold:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {k: root(k) for k in keys}


def test_exact_groups_and_flags(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 5, "x"), ("a", 9, "x"), ("b", 2, "x"), ("a", 3, ""), ("a", 4, None), ("a", 6, "y")], ROWS)
    flagged = dedup.flags(dedup.exact_groups(rows))
    got = {(r.scope, r.line): r.flag for r in flagged.collect()}
    assert got == {("a", 1): "ORIGINAL", ("a", 5): "DUPLICATE -> L1", ("a", 9): "DUPLICATE -> L1", ("b", 2): "UNIQUE", ("a", 3): "UNIQUE", ("a", 4): "UNIQUE", ("a", 6): "UNIQUE"}
    long = {(r.scope, r.line): r.flag for r in dedup.list_duplicates(flagged).collect()}
    assert long["a", 1] == "ORIGINAL (dups: L5, L9)"
    assert dedup.remove_duplicates(flagged).count() == 5
    t = {r.scope: r for r in dedup.totals(flagged).collect()}
    assert (t["a"].uniques, t["a"].originals, t["a"].duplicates, t["a"].distinct_rows) == (3, 1, 2, 4)


def test_near_groups_are_the_brute_forces(spark):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(300)]
    keys = {}
    for base in range(12):
        text = [rng.choice(words) for _ in range(60)]
        for edit in range(rng.choice([1, 2, 3])):
            own = list(text)
            for _ in range(edit):
                own[rng.randrange(60)] = rng.choice(words)
            keys[base * 10 + edit] = " ".join(own)
    keys[500], keys[501] = keys[0], ""
    rows = spark.createDataFrame([("f", k, v) for k, v in keys.items()], ROWS)
    got = {r.line: r.first_line for r in dedup.near_groups(rows).collect()}
    assert got == brute(keys, dedup.THRESHOLD)


def test_components_are_union_finds(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(140)] + [(1000 + k, 1001 + k) for k in range(60)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    df = spark.createDataFrame([*edges, (None, 1), (7, 7)], "a bigint, b bigint").repartition(5)
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(df.limit(0)).count() == 0


def test_near_groups_need_no_common_shingle(spark):
    rng = random.Random(11)
    long, short = "abcdefghijklmnopqrstuvwxyz"[:20] * 2, "q" * 40
    spread = "".join(rng.choice("abcdefghij klmnop") for _ in range(190))
    edited = list(spread)
    for k in range(20, 190, 40):  # a change in most runs of three words
        edited[k] = "#"
    keys = {1: long, 2: long[:30] + "x" + long[30:], 3: f"{short} m {short}", 4: f"{short} n {short}", 5: spread, 6: "".join(edited), 7: "a b", 8: "a c"}
    rows = spark.createDataFrame([("f", k, v) for k, v in keys.items()], ROWS)
    expected = brute(keys, dedup.THRESHOLD)
    assert expected[2] == 1 and expected[4] == 3 and expected[6] == 5
    assert {r.line: r.first_line for r in dedup.near_groups(rows).collect()} == expected


def test_near_groups_judge_both_orders_of_copies(spark):
    rng = random.Random(4)
    b = "".join(rng.choice("abcdefgh ") for _ in range(202))  # from 200 characters on, popular ones of the second text are junk
    a = b[5:]
    ratios = [difflib.SequenceMatcher(None, *p).ratio() >= dedup.THRESHOLD for p in ((a, b), (b, a))]
    assert ratios == [False, True]
    got = lambda keys: {r.line: r.first_line for r in dedup.near_groups(spark.createDataFrame([("f", k, v) for k, v in keys.items()], ROWS)).collect()}
    assert got({1: a, 2: b}) == {1: 1, 2: 2}
    assert got({1: a, 2: b, 3: a}) == {1: 1, 2: 1, 3: 1}


def test_near_groups_in_blocks_at_any_threshold(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 7)
    rng = random.Random(8)
    base = "".join(rng.choice("abcdefghijklmnop ") for _ in range(150))
    keys = {}
    for k in range(60):  # copies of one text at growing distances: links are not transitive
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(len(own))] = rng.choice("rstuvw")
        keys[k] = "".join(own[: rng.randrange(120, 151)])
    for threshold in (0.97, 0.9, 0.0, 1.0):
        rows = spark.createDataFrame([("f", k, v) for k, v in keys.items()], ROWS)
        assert {r.line: r.first_line for r in dedup.near_groups(rows, threshold).collect()} == brute(keys, threshold)


def test_components_that_have_not_settled_are_an_error(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(64)], "a bigint, b bigint").repartition(8)
    with pytest.raises(RuntimeError, match="after 1 rounds"):
        components(path, limit=1)
