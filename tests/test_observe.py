from quarry.operators.observe import Counter, Histogram, StageClock, observed


def test_counters_and_histograms():
    requests, latency = Counter("evaluator", "cache"), Histogram("stage", bounds=(0.1, 1.0))
    for cache in ("hit", "miss", "hit"):
        requests.add(evaluator="heuristic", cache=cache)
    assert requests.counts == {("heuristic", "hit"): 2, ("heuristic", "miss"): 1}
    for value in (0.05, 0.1, 0.5, 7):
        latency.add(value, stage="search")
    assert latency.held["search",][:2] == (4, 7.65) and latency.within(0.1, stage="search") == 2 and latency.within(1.0, stage="search") == 3


def test_stage_clock():
    ticks = iter([0.0, 0.25, 1.0, 1.5])
    latency = Histogram("stage")
    clock = StageClock(latency, lambda: next(ticks))
    assert clock.run("parse", lambda: 7) == 7 and clock.run("search", list) == []
    assert clock.timings == {"parse": 250.0, "search": 500.0} and latency.within(0.25, stage="parse") == 1


def test_rows_are_counted_as_they_pass(spark):
    rows, seen = observed(spark.createDataFrame([(0.5,), (2.0,), (None,)], "x double"), "passed", "x", (1.0,))
    assert rows.count() == 3 and seen.get == {"n": 3, "sum": 2.5, "le_1.0": 1}
