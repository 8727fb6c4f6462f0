import math
import random

import pytest

from quarry.operators import metrics
from quarry.plans import queries


def test_registered_baseline_runs_the_operators_trials(monkeypatch):
    seen = {"trials": 1000}
    monkeypatch.setattr(queries, "_ranked", lambda spark, sf: (None, None))
    monkeypatch.setattr(metrics, "random_baseline", lambda *args, **named: seen.update(named))
    queries.QUERIES["random_baseline"](None, "")
    assert seen["trials"] == 1000


def test_baseline_of_groups_that_fit_a_task_sends_no_row_per_trial(spark, monkeypatch):
    """The same means as by trial and stretch, for keys of both kinds, null keys and labels, groups over several batches and a last block that is not full."""
    r = random.Random(5)
    rows = [(r.choice("abcd") if i % 5 else "e", i, None if i % 17 == 0 else r.randrange(4)) for i in range(300)] + [("a", None, 3), ("f", None, 2), (None, 7, 2), ("g", 1, 0)]
    labels = spark.createDataFrame(rows, "g string, id long, label int")
    monkeypatch.setattr(metrics, "BLOCK", 8)
    before = {"spark.sql.execution.arrow.maxRecordsPerBatch": spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")}
    for own, key in ((labels, "id"), (labels.selectExpr("g", "'k' || id AS id", "label"), "id")):
        expected = {(x.g, x.k): x for x in metrics._drawn_by_trial(own.where("g IS NOT NULL"), "g", key, [1, 5, 400], 19, 42).collect()}
        with monkeypatch.context() as m:
            m.setattr(metrics, "evaluate", None)  # ranks rows that are sent for each trial
            m.setattr(metrics, "TOGETHER", 20)
            try:
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
                got = {(x.g, x.k): x for x in metrics.random_baseline(own, "g", key, [1, 5, 400], 19).collect()}
            finally:
                spark.conf.set(*next(iter(before.items())))
        assert set(got) == set(expected) and {g for g, _ in got} == set("abcdeg")
        assert all(got[x][c] == pytest.approx(expected[x][c], abs=1e-12) for x in got for c in metrics.METRICS)


def test_baseline_of_groups_over_the_limit_is_dealt_by_trial(spark, monkeypatch):
    labels = spark.createDataFrame([(g, f"{g}{i}", i % 4) for g, n in (("a", 30), ("b", 5)) for i in range(n)], "g string, id string, label int")
    rows = lambda: {(x.g, x.k): [round(x[c], 12) for c in metrics.METRICS] for x in metrics.random_baseline(labels, "g", "id", [3], 10).collect()}
    held = rows()
    monkeypatch.setattr(metrics, "HELD", 10)
    assert rows() == held and math.isfinite(held["a", 3][0])
