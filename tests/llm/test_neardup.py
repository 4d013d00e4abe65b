import random
from collections import Counter, defaultdict

import numpy as np

from dialogforge.llm import neardup

M = "msg_id bigint, dialogue_id string, turn_id int, msg_index int, role string, content string, code_snippet string, id string"


def brute(texts):
    bags = {k: Counter(neardup.WORD.findall(t.lower())) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common, longer = sum((bags[a] & bags[b]).values()), max(bags[a].total(), bags[b].total())
            if longer and common * 5 >= longer * 4:
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    groups = defaultdict(list)
    for k in ids:
        groups[root(k)].append(k)
    return {(a, b) for g in groups.values() for a in g for b in g if a < b}


def corpus(seed, families=25, words=80):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    texts = {}
    for family in range(families):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for copy in range(rng.choice([1, 1, 2, 4])):
            own = list(base)
            for _ in range(rng.choice([0, 3, 10, 15, 20])):
                own[rng.randrange(words)] = rng.choice(vocabulary)
            if copy == 1:
                rng.shuffle(own)
            texts[family * 10 + copy] = " ".join(own)
    return texts


def found(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    return {tuple(r) for r in neardup.pairs_within(neardup.group(df)).collect()}


def test_groups_are_the_brute_forces(spark):
    texts = corpus(1)
    texts |= {900: texts[0], 901: texts[0], 902: "", 903: "", 904: "...", 905: "one", 906: "one"}
    assert found(spark, texts) == brute(texts)


def test_a_chain_and_a_hot_band(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(100)]
    texts = {}
    for k in range(40):  # near-copies of one text share most bands
        own = list(base)
        for j in rng.sample(range(100), 6):
            own[j] = f"x{k}_{j}"
        texts[k] = " ".join(own)
    chain = [f"c{k}" for k in range(100)]
    for k in range(6):  # neighbours are similar, the ends are not
        chain = chain[12:] + [f"n{k}_{j}" for j in range(12)]
        texts[100 + k] = " ".join(chain)
    assert found(spark, texts) == brute(texts)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 120, dtype=np.uint64)
    b = np.concatenate([a[:90], rng.integers(0, 2**63, 30, dtype=np.uint64)])
    got = neardup.superminhash(np.repeat([0, 1], 120), np.concatenate([a, b]), 2)
    assert abs((got[0] == got[1]).mean() - 90 / 150) < 0.1
    assert (neardup.superminhash(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), 1) == 0xFFFFFFFF).all()
    one = neardup.superminhash(np.zeros(1, dtype=np.int64), a[:1], 1)
    assert (one != 0xFFFFFFFF).all()  # every place is reached: the places of an element are a permutation


def test_openings_and_edges(spark):
    rows = [(1, "d", 2, 0, "user", "later", None, "x"), (2, "d", 1, 3, "User", "first", "code", "x"), (2, "d", 1, 3, "User", "first", "code", "x"), (3, "d", 0, 0, "system", "s", None, None), (4, "e", None, 0, "human", None, None, None), (5, None, 1, 0, "user", "lost", None, None)]
    df = spark.createDataFrame(rows, M)
    assert {tuple(r) for r in neardup.openings(df).collect()} == {(2, "first code"), (4, "")}
    assert neardup.group(neardup.openings(df.limit(0))).count() == 0
    long = "word " * 50_000
    twice = spark.createDataFrame([(1, long), (1, long), (2, long + "tail"), (None, "a"), (3, None)], "id bigint, text string")
    assert {tuple(r) for r in neardup.pairs_within(neardup.group(twice)).collect()} == {(1, 2)}


def test_links_count_every_similar_text(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_SALTED", 8)
    rng = random.Random(6)
    base = [f"w{k}" for k in range(100)]
    texts = {}
    for k in range(40):
        own = list(base)
        for j in rng.sample(range(100), rng.choice([4, 8, 14])):
            own[j] = f"x{k}_{j}"
        texts[k] = " ".join(own)
    texts |= {100: "one two three four five", 101: "one two three four six", 102: "alone", 103: texts[0]}
    bags = {k: Counter(neardup.WORD.findall(t)) for k, t in texts.items()}
    similar = lambda a, b: sum((bags[a] & bags[b]).values()) * 5 >= max(bags[a].total(), bags[b].total()) * 4
    expected = {a: sum(a != b and texts[a] != texts[b] and similar(a, b) for b in texts if b != 103 or texts[a] == texts[103]) for a in texts}
    df = spark.createDataFrame(list(texts.items()), "id bigint, text string")
    got = {r.id: r.links for r in neardup.group_links(df).collect()}
    assert got == expected and max(expected.values()) > 20


def test_recall_at_the_least_similarity(spark):
    """Pairs that share exactly 80 % of equal lengths (Jaccard 2/3), the hardest true ones."""
    rng = random.Random(6)
    rows = []
    for k in range(400):
        shared = [f"s{k}x{j}" for j in range(80)]
        for side in (0, 1):
            words = shared + [f"o{k}x{side}x{j}" for j in range(20)]
            rng.shuffle(words)
            rows.append((2 * k + side, " ".join(words)))
    groups = {r.id: r.group for r in neardup.group(spark.createDataFrame(rows, "id bigint, text string")).collect()}
    assert len(groups) == 800 and all(groups[i] // 2 == i // 2 for i in groups)
    assert sum(groups[2 * k] == groups[2 * k + 1] for k in range(400)) >= 0.98 * 400


def test_a_salted_band_loses_no_link(spark, monkeypatch):
    # Many groups in one band: texts share a long opening, but their groups differ by what follows.
    shared = [f"w{j}" for j in range(70)]
    rows = [(10 * g + k, " ".join(shared + [f"g{g}x{j}" for j in range(40)] + [f"k{g}x{k}"])) for g in range(8) for k in range(4)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    whole = {r.id: r.group for r in neardup.group(df).collect()}
    monkeypatch.setattr(neardup, "_BAND_ROWS", 3)
    assert {r.id: r.group for r in neardup.group(df).collect()} == whole == {i: i // 10 * 10 for i in whole}
