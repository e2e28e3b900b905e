import numpy as np
import pytest

from convfeat.operators.runs import early_stop, epoch_loss, first_improving_steps, select_checkpoints


def history(spark, runs):
    rows = [(run, step, float(s)) for run, scores in runs.items() for step, s in enumerate(scores, 10)]
    return spark.createDataFrame(rows, "run_id long, step long, score double").repartition(3)


def by_hand(scores, patience, delta):
    best, at, waited = None, 0, 0
    improved = []
    for i, s in enumerate(scores, 1):
        if best is None or s > best + delta:
            best, at, waited = s, i, 0
            improved.append(i)
        else:
            waited += 1
            if waited >= patience:
                return at, best, i, improved
    return at, best, None, improved


def test_stops_after_patience(spark):
    [row] = early_stop(history(spark, {1: [0.5, 0.6, 0.6, 0.59, 0.9]}), patience=2).collect()
    assert (row.best_check, row.best_step, row.best_score, row.stop_check, row.checks_run) == (2, 11, 0.6, 4, 4)


@pytest.mark.parametrize("parts", [1, 6])
@pytest.mark.parametrize("delta", [0.0, 0.04])
def test_equals_a_sequential_pass(spark, parts, delta):
    rng = np.random.default_rng(11)
    runs = {i: rng.integers(0, 100, rng.integers(1, 40)) / 100 for i in range(12)}
    runs[99] = np.concatenate([np.arange(200) / 1000, rng.integers(0, 300, 100) / 1000])  # spans several ranges
    df = history(spark, runs)
    got = {r.run_id: (r.best_check, r.best_score, r.stop_check) for r in early_stop(df, 4, delta, parts).collect()}
    want = {run: by_hand(list(s), 4, delta) for run, s in runs.items()}
    assert got == {run: w[:3] for run, w in want.items()}
    steps = {}
    for r in first_improving_steps(df, 4, delta, parts).collect():
        steps.setdefault(r.run_id, []).append(r.check)
    assert {run: sorted(s) for run, s in steps.items()} == {run: w[3] for run, w in want.items()}


def test_checkpoints(spark):
    df = history(spark, {1: [0.5, 0.6, 0.1, 0.2], 2: [0.9, 0.1, 0.1, 0.1, 0.1]})
    got = {(r.run_id, r.kind, r.check) for r in select_checkpoints(df, [1, 2, 4, 9], last=4, patience=2).collect()}
    assert got == {
        (1, "publish", 1), (1, "publish", 2), (1, "publish", 4), (1, "best", 4),
        (2, "publish", 1), (2, "publish", 2), (2, "best", 1),
    }


def test_epoch_loss(spark):
    df = spark.createDataFrame([(1, 1, 0.2), (1, 1, 0.4), (1, 2, 0.1)], "run_id long, epoch long, loss double")
    assert {r.epoch: round(r.mean_loss, 9) for r in epoch_loss(df).collect()} == {1: 0.3, 2: 0.1}


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("delta", [0.0, 0.05])
def test_scores_that_are_no_numbers(spark, parts, delta):
    nan = float("nan")
    runs = {1: [0.5, nan, 0.6, 0.7], 2: [nan, 0.9, 0.95], 3: [0.5, nan, nan, nan, 0.9]}
    got = {r.run_id: (r.best_check, r.best_score, r.stop_check) for r in early_stop(history(spark, runs), 3, delta, parts).collect()}
    assert got[1] == (4, 0.7, None) and got[3] == (1, 0.5, 4)
    assert got[2][0] == 1 and np.isnan(got[2][1]) and got[2][2] is None


@pytest.mark.parametrize("parts", [1, 5])
def test_least_improvement_on_a_long_rising_run(spark, parts):
    """Every check a new maximum; a least improvement of 1.5 steps keeps every second one."""
    runs = {7: list(np.arange(300) / 1000), 8: [0.1] * 5, 9: list(np.arange(40) / 1000)[::-1]}
    df = history(spark, runs)
    got = {r.run_id: (r.best_check, r.best_score, r.stop_check) for r in early_stop(df, 4, 0.0015, parts).collect()}
    want = {run: by_hand(list(s), 4, 0.0015) for run, s in runs.items()}
    assert got == {run: w[:3] for run, w in want.items()}
    kept = sorted(r.check for r in first_improving_steps(df, 4, 0.0015, parts).collect() if r.run_id == 7)
    assert kept == want[7][3] and kept[:3] == [1, 3, 5]


def test_least_improvement_runs_in_the_jvm(spark):
    from convfeat.operators.runs import _improvements, _numbered

    rows, _ = _numbered(history(spark, {1: [0.1, 0.2, 0.5, 0.52, 0.9]}), 2)
    plan = _improvements(rows, 0.05, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
