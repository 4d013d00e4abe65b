import random

import numpy as np
import pyarrow as pa

from dialogforge.llm import leaks


def brute(docs, items):
    grams = {}
    for item, text in items:
        w = leaks.words_of(text)
        for k in range(len(w) - leaks.RUN + 1):
            grams.setdefault(tuple(w[k : k + leaks.RUN]), set()).add(item)
    out = set()
    for doc, text in docs:
        w = leaks.words_of(text)
        for k in range(len(w) - leaks.RUN + 1):
            out.update((doc, item) for item in grams.get(tuple(w[k : k + leaks.RUN]), ()))
    return out


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string, suite string")


def test_runs_of_every_length_and_place(spark):
    rng = random.Random(4)
    vocabulary = [f"v{k}" for k in range(120)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(k, some(70)) for k in range(12)]
    docs = []
    for k in range(150):
        item = rng.choice(items)[1]
        length = rng.randrange(15, 30)
        at = rng.randrange(0, 70 - length)
        part = " ".join(item[at : at + length]).upper().replace(" ", rng.choice([" ", "_", "\n* ", " - "]))
        docs.append((k, " ".join(some(rng.randrange(0, 40))) + ". " + part + ", " + " ".join(some(rng.randrange(0, 40)))))
    items = [(k, " ".join(w)) for k, w in items]
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(*tables(spark, docs, [(*i, "s") for i in items])).filter("distance = 0").collect()}
    assert got == brute(docs, items) and got


def test_edges(spark):
    text = " ".join(f"w{k}" for k in range(40))
    docs = [(1, text), (1, text), (2, None), (3, ""), (None, text), (4, " ".join(f"w{k}" for k in range(19))), (5, "x " * 100_000 + text)]
    items = [(7, text, "s"), (7, text, "s"), (8, None, "s"), (9, "short", "s"), (None, text, "s")]
    d, i = tables(spark, docs, items)
    found = leaks.find_leaks(d, i)
    assert found.columns == ["doc_id", "item_id", "distance", "shared_runs"]
    assert {(r.doc_id, r.item_id, r.shared_runs) for r in found.collect()} == {(1, 7, 21), (5, 7, 21)}
    assert {(r.item_id, r.documents) for r in leaks.leaked_items(found, i).collect()} == {(7, 2), (8, 0), (9, 0)}
    assert leaks.find_leaks(d.limit(0), i).count() == 0 and leaks.find_leaks(d, i.limit(0)).count() == 0


def test_a_full_table_loses_nothing(spark):
    text = lambda p: " ".join(f"{p}{k}" for k in range(30))
    d, i = tables(spark, [(k, text(f"p{k}x")) for k in range(40)], [(k, text(f"p{k}x"), "s") for k in range(40)])
    got = leaks.find_leaks(d, i, table_bits=6).collect()  # 64 bits for 3,520 keys
    assert {(r.doc_id, r.item_id, r.distance, r.shared_runs) for r in got} == {(k, k, 0, 11) for k in range(40)}


def edited(rng, words, edits):
    words = list(words)
    for at in sorted(rng.sample(range(len(words)), edits), reverse=True):
        kind = rng.randrange(3)
        words[at : at + (kind != 1)] = [] if kind == 0 else [f"new{rng.randrange(10**9)}"]
    return words


def test_recall_of_edited_passages(spark):
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    items = [(k, fresh(60)) for k in range(60)]
    docs = []
    for k in range(720):
        at = rng.randrange(40)
        docs.append((k, " ".join(fresh(30) + edited(rng, items[k % 60][1][at : at + leaks.RUN], k // 60 % 3 + 1) + fresh(30))))
    found = {(r.doc_id, r.item_id): r.distance for r in leaks.find_leaks(*tables(spark, docs, [(k, " ".join(w), "s") for k, w in items])).collect()}
    assert all(item == doc % 60 for doc, item in found)  # no chance pairs
    assert max(found.values()) <= leaks.EDITS
    for edits, least in ((1, 0.99), (2, 0.97), (3, 0.9)):
        planted = [k for k in range(720) if k // 60 % 3 + 1 == edits]
        assert sum((k, k % 60) in found for k in planted) >= least * len(planted), edits


def brute_distance(a, b):
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def test_edit_distance_in_a_band():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 5, (400, 8), dtype=np.uint64)
    b = rng.integers(0, 5, (400, 14), dtype=np.uint64)
    b[:300, 3:11] = a[:300]
    b[:200, rng.integers(3, 11)] = 7
    b[:100, 3:13] = b[:100, 4:14]
    got = leaks.edit_distance(a, b, 3)
    exact = np.array([min(4, brute_distance(x.tolist(), y.tolist())) for x, y in zip(a, b)])
    # The band holds parts that begin within three words of the diagonal and stay there.
    assert (got >= exact).all() and (got[:300] == exact[:300]).all() and {0, 1, 2} <= set(got.tolist())


def test_embedding_keeps_small_edits_near():
    words = [f"w{k}" for k in range(60)]
    texts = leaks.Texts([" ".join(words), " ".join(words[:20] + words[21:] + words[:1]), " ".join(f"v{k}" for k in range(60))])
    outputs = lambda at, number: np.stack([np.where(p < at + 60, np.append(texts.words, -1)[p], -2) for p in leaks.walk(texts, np.array([at]), 60, number)])
    distance = lambda at: np.mean([(outputs(0, n) != outputs(at, n)).mean() for n in range(8)])
    assert distance(0) == 0 and distance(60) < 0.8 * distance(120)


def test_walks_move_on_only_at_wanted_steps():
    rng = random.Random(5)
    texts = leaks.Texts([" ".join(f"w{rng.randrange(30)}" for _ in range(n)) for n in (90, 5, 20, 33)])
    starts, _ = texts.windows(leaks.RUN)
    for number in range(leaks.WALKS):
        places = starts.tolist()
        brute = []
        for step in range(leaks.PACE * leaks.RUN):
            brute.append(list(places))
            salt = np.uint64((step + 1 + number * 1_000) * leaks._PHI & 0xFFFFFFFFFFFFFFFF)
            bits = (leaks._mix(texts.vocabulary + salt) & np.uint64(1)).tolist()
            places = [p if p == s + leaks.RUN else p + bits[texts.words[p]] for p, s in zip(places, starts.tolist())]
        for steps in (range(40), [0, 1, 9, 26, 27, 39], [7, 8, 16], [31]):
            assert [at.tolist() for at in leaks.walk(texts, starts, leaks.RUN, number, steps)] == [brute[s] for s in steps]


def test_random_bits_of_words_are_made_once(monkeypatch):
    texts = leaks.Texts([" ".join(f"w{k % 37}" for k in range(400))])
    starts, _ = texts.windows(leaks.RUN)
    mixed, mix = [], leaks._mix
    monkeypatch.setattr(leaks, "_mix", lambda x: mixed.append(x.shape) or mix(x))
    whole = leaks.lsh_keys(texts, starts)
    mixed.clear()
    parts = [leaks.lsh_keys(texts, starts[k : k + 100]) for k in range(0, len(starts), 100)]
    assert (np.concatenate(parts) == whole).all() and (37,) not in mixed


def test_words_of_plain_and_other_texts():
    texts = ["Ab_c  D9\x1c\x00e-f\n_G__h'i", "".join(map(chr, range(128))), "Ünd_ſo ²³ İx\x85y\xa0ßZ"]
    assert [leaks.words_of(t) for t in texts] == [leaks.WORD.findall(t.lower()) for t in texts]


def table_of(*hashes):
    table = np.zeros(1 << 16, dtype=np.uint8)
    for h in np.concatenate(hashes):
        table[int(h) >> 48] |= 1 << (int(h) >> 45 & 7)
    return table


def test_seeds_lose_no_edited_passage():
    assert [leaks.seed_length(*x) for x in ((20, 3), (20, 0), (9, 2), (3, 3), (2, 3))] == [5, 20, 3, 0, 0]
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    run, pad = leaks.RUN, leaks.SHIFT + leaks.EDITS
    for k in range(300):
        edits = k % 4
        length = leaks.seed_length(run, edits)
        item, before = fresh(run), rng.randrange(30)
        table = table_of(leaks.seeds(leaks.Texts([" ".join(item)]), length))
        passage = edited(rng, item, edits)
        texts = leaks.Texts([" ".join(fresh(before) + passage + fresh(rng.randrange(30)))])
        starts, _ = texts.windows(run)
        near = leaks._near(texts, starts, run, pad, length, table)
        meant = np.abs(starts - before) <= leaks.SHIFT  # windows that may be judged by this passage
        assert near[meant].all(), (k, edits)


def test_only_windows_near_a_seed_are_embedded(monkeypatch):
    rng = random.Random(12)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    item = fresh(40)
    table = table_of(leaks.seeds(leaks.Texts([" ".join(item)]), 5), leaks.lsh_keys(leaks.Texts([" ".join(item)]), np.arange(21)).ravel())
    texts = [" ".join(fresh(2_000)), " ".join(fresh(1_000) + item + fresh(1_000)), "short"]
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3], "text": texts})
    embedded, lsh_keys = [], leaks.lsh_keys
    monkeypatch.setattr(leaks, "lsh_keys", lambda texts, starts, run: embedded.extend(starts.tolist()) or lsh_keys(texts, starts, run))
    rows = [r for b in leaks._described(iter([batch]), leaks.RUN, leaks.EDITS, table) for r in b.to_pylist()]
    assert {(2, 1_000 + k) for k in range(21)} <= {(r["id"], r["place"]) for r in rows}
    assert 21 <= len(embedded) < 200  # of 4,002 windows


def test_narrow_ids(spark):
    text = " ".join(f"w{k}" for k in range(30))
    d, i = tables(spark, [(1, text)], [(7, text, "s")])
    found = leaks.find_leaks(d.withColumn("doc_id", d.doc_id.cast("int")), i.withColumn("item_id", i.item_id.cast("smallint"))).collect()
    assert [(r.doc_id, r.item_id, r.distance, r.shared_runs) for r in found] == [(1, 7, 0, 11)]
