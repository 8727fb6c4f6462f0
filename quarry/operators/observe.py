"""Counts and latencies of what an engine does, gathered beside its results."""

from __future__ import annotations

import bisect
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: Upper bounds of the classes of a histogram of seconds.
SECONDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


class Counter:
    """Counts by labels."""

    def __init__(self, *labels: str):
        self.labels, self.counts, self._lock = labels, {}, threading.Lock()

    def add(self, n: float = 1, **values: str) -> None:
        key = tuple(values[name] for name in self.labels)
        with self._lock:
            self.counts[key] = self.counts.get(key, 0) + n


class Histogram:
    """By labels: how many values there were, their sum, and how many of them each bound holds."""

    def __init__(self, *labels: str, bounds: tuple[float, ...] = SECONDS):
        self.labels, self.bounds, self.held, self._lock = labels, bounds, {}, threading.Lock()

    def add(self, value: float, **values: str) -> None:
        key = tuple(values[name] for name in self.labels)
        with self._lock:
            n, total, classes = self.held.get(key, (0, 0.0, [0] * (len(self.bounds) + 1)))
            classes[bisect.bisect_left(self.bounds, value)] += 1
            self.held[key] = (n + 1, total + value, classes)

    def within(self, bound: float, **values: str) -> int:
        """How many values were at most a bound of the histogram."""
        return sum(self.held[tuple(values[name] for name in self.labels)][2][: self.bounds.index(bound) + 1])


class StageClock:
    """Milliseconds of each stage of a run, and a histogram over all runs."""

    def __init__(self, latency: Histogram | None = None, clock: Callable[[], float] = time.perf_counter):
        self.timings: dict[str, float] = {}
        self.latency, self.clock = latency, clock

    def run(self, stage: str, work: Callable):
        began = self.clock()
        made = work()
        took = self.clock() - began
        self.timings[stage] = round(1000 * took, 2)
        if self.latency is not None:
            self.latency.add(took, stage=stage)
        return made


def observed(rows: DataFrame, name: str, by: str | None = None, bounds: tuple[float, ...] = ()) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that has n, and for a numeric column its sum and the rows up to each bound, once the rows have been worked on."""
    seen = Observation(name)
    own = [F.count(F.lit(1)).alias("n")]
    if by is not None:
        own += [F.sum(by).alias("sum"), *[F.count_if(F.col(by) <= b).alias(f"le_{b}") for b in bounds]]
    return rows.observe(seen, *own), seen
