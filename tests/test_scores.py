import pytest

from dialogforge.operators import scores

S = "record_id bigint, metadata struct<primary_task:string>, scores map<string,array<struct<score:double,verdict:string,passed:boolean>>>"


def sample(score=None, verdict=None, passed=None):
    return {"score": score, "verdict": verdict, "passed": passed}


@pytest.fixture(scope="module")
def long(spark):
    rows = [
        (1, {"primary_task": "A"}, {"code_tests": [sample(passed=False), sample(), sample(passed=True)], "judge": [sample(8.0, "Pass"), sample(7.0, "pass"), sample(6.0, "fail")]}),
        (2, None, {"judge": [None, sample(4.0, None)], "empty": []}),
        (3, {"primary_task": "A"}, None),
    ]
    return spark.createDataFrame(rows, S)


def test_failed_code_zeroes_its_index(long):
    got = {(r.record_id, r.idx): r.score for r in scores.zeroed(scores.long_scores(long)).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 7.0, (1, 2): 6.0, (2, 1): 4.0}
    kept = {(r.record_id, r.idx): r.score for r in scores.zeroed(scores.long_scores(long), zero_failed=False).collect()}
    assert kept[1, 0] == 8.0


def test_statistics_and_ranking(long):
    z = scores.zeroed(scores.long_scores(long))
    stats = {(r.scope, r.metric): r for r in scores.score_statistics(z).collect()}
    assert stats["task:A", "judge"].n == 3 and stats["GLOBAL", "judge"].mean == pytest.approx(4.25) and stats["task:UNKNOWN", "judge"].stdev == 0.0
    assert [(r.task, r.place) for r in scores.task_ranking(z).orderBy("place").collect()] == [("A", 1), ("UNKNOWN", 2)]
    assert "| judge | A |" in scores.report(scores.score_statistics(z), scores.task_ranking(z), scores.verdicts(scores.long_scores(long)))


def test_verdicts(long):
    got = {r.verdict: (r.samples, r.share) for r in scores.verdicts(scores.long_scores(long)).collect()}
    assert got == {"pass": (2, pytest.approx(2 / 3)), "fail": (1, pytest.approx(1 / 3))}


def test_pass_rates(long):
    got = {r.k: r for r in scores.pass_rates(long, [1, 5]).collect()}
    assert got[1].pass_at_k == pytest.approx(1 / 3) and got[1].skipped == 0
    assert got[5].pass_at_k is None and got[5].skipped == 1


def test_csv_rows(long):
    rows = scores.csv_rows(scores.score_statistics(scores.zeroed(scores.long_scores(long))))
    assert rows.columns == scores.CSV_COLUMNS
