import pytest

from dialogforge.llm import mixing

D = "doc_id bigint, source string, text string, tokens string"
T = "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, ["big", "Big ", "BIG"][k % 3], f"some words of document {k} " * (1 + k % 7), "x") for k in range(600)] + [(1000 + k, "small", f"tiny text {k} " * 3, None) for k in range(40)] + [(2000, None, "no source", None), (2001, "other", "no target", None), (2002, "big", None, None), (None, "big", "no id", None)]
    docs = spark.createDataFrame(rows, D)
    targets = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 3)], T)
    return docs, targets


def test_shares_and_repeats(corpus):
    docs, targets = corpus
    mixed = mixing.mix(docs, targets, block=64)
    report = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    total = sum(r.tokens for r in report.values())
    assert abs(report["big"].share - 0.9) < 0.02 and abs(report["small"].share - 0.1) < 0.02 and total > 5_000
    assert report["small"].most_repeats <= 3 and report["big"].most_repeats == 1
    ids = {r.doc_id for r in mixed.collect()}
    assert not ids & {2000, 2001, 2002}


def test_prefixes_of_the_mix_have_the_shares(corpus):
    docs, targets = corpus
    rows = mixing.mix(docs, targets, block=64).orderBy("slot", "place").collect()
    half = rows[: len(rows) // 2]
    share = sum(r.tokens for r in half if r.source == "small") / sum(r.tokens for r in half)
    assert abs(share - 0.1) < 0.04


def test_a_chosen_total_and_a_seed(corpus):
    docs, targets = corpus
    a, b, c = (sorted(map(tuple, mixing.mix(docs, targets, total_tokens=2_000, block=64, seed=s).collect())) for s in (1, 1, 2))
    assert a == b != c
    assert abs(sum(r[-1] for r in a) - 2_000) < 400


def test_chunks_do_not_change_the_running_counts(corpus, monkeypatch):
    docs, targets = corpus
    monkeypatch.setattr(mixing, "_CHUNK", 16)
    mixed = mixing.mix(docs, targets, block=64)
    big = mixed.filter("source = 'big'").orderBy("place").collect()
    assert all(x.place + x.tokens == y.place or y.place > x.place for x, y in zip(big, big[1:]))
    report = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert abs(report["small"].share - 0.1) < 0.02


def test_more_than_there_is(corpus):
    docs, targets = corpus
    report = {r.source: r for r in mixing.shares(mixing.mix(docs, targets, total_tokens=200_000, block=64), targets).collect()}
    assert report["small"].most_repeats <= 3 and report["small"].tokens < 20_000


def test_empty(corpus):
    docs, targets = corpus
    assert mixing.mix(docs.limit(0), targets).count() == 0
    assert mixing.mix(docs, targets.limit(0)).count() == 0
    assert {r.tokens for r in mixing.shares(mixing.mix(docs.limit(0), targets), targets).collect()} == {0}


def test_any_number_of_sources(corpus):
    docs, _ = corpus
    spark = docs.sparkSession
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.25, 3)] + [(f"s{k}", 0.25 / 12_000, 1) for k in range(12_000)], T)
    report = mixing.shares(mixing.mix(docs, targets, total_tokens=4_000, block=64), targets)
    assert report.count() == 12_002
    assert {r.source for r in report.filter("tokens > 0").collect()} == {"big", "small"}


def test_the_error_of_a_share_is_bounded_by_blocks_and_texts(corpus):
    docs, targets = corpus
    block = 64
    longest = mixing.sized(docs).agg({"tokens": "max"}).first()[0]
    for total in (2_000, 4_000):
        for r in mixing.shares(mixing.mix(docs, targets, total_tokens=total, block=block), targets).collect():
            assert abs(r.tokens - r.target_share * total) <= 3 * block + longest
