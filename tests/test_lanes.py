"""Calls spaced over a whole job."""

import random
import sys
import time

import pytest
from pyspark import cloudpickle

from factloom.sources.providers import SLACK, Lanes, ProviderError, apply

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests


class Clock:
    """A worker's time: it passes while the worker sleeps, a little longer than asked for, or while it works."""

    def __init__(self, now, late):
        self.now, self.late = now, late

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += max(0.0, seconds) + self.late()


@pytest.mark.parametrize("seed", range(20))
def test_no_two_starts_are_nearer_than_the_interval(seed):
    rng = random.Random(seed)
    interval, n = rng.choice([0.1, 2.5, 7.0]), rng.randint(1, 6)
    starts = []
    for lane in range(n):
        clock = Clock(1e6 + rng.random() * 20, lambda: rng.choice([0.0, 1e-4, 0.2 * interval, interval]) * rng.random())
        lanes = Lanes(interval, n, clock=clock, sleep=clock.sleep)
        for _ in range(30):
            if rng.random() < 0.2:
                lanes.used.clear()  # the lane's next task, in another worker
            lanes.hold(lane)
            starts.append(clock.now)
            clock.now += rng.choice([0.0, 0.01, interval, 5 * interval]) * rng.random()
    starts.sort()
    assert all(b - a >= interval - 1e-6 for a, b in zip(starts, starts[1:]))


def test_one_lane_uses_every_slot():
    clock = Clock(1e6, lambda: 0.0)
    lanes = Lanes(2.0, 1, clock=clock, sleep=clock.sleep)
    starts = []
    for _ in range(10):
        lanes.hold(0)
        starts.append(clock.now)
    assert all(abs(b - a - 2.0 * (1 + SLACK)) < 1e-6 for a, b in zip(starts, starts[1:]))
    free = Lanes(0.0, 3, clock=clock, sleep=None)
    free.hold(1)
    with pytest.raises(ValueError):
        Lanes(n=0)


class Timed:
    """Says when each call started; some calls fail at first, some for good."""

    def __init__(self):
        self.failed = set()

    def run(self, rows):
        at = time.time()
        for r in rows:
            if r["prompt"].endswith("7") and r["prompt"] not in self.failed:
                self.failed.add(r["prompt"])
                raise ProviderError("busy", 429)
            if r["prompt"].endswith("9"):
                raise ProviderError("refused", 400)
        return [{"raw": str(at)} for _ in rows]


def test_a_job_of_several_tasks(spark):
    asked = spark.createDataFrame([(i, f"prompt {i}") for i in range(30)], "id int, prompt string").repartition(7)
    lanes = Lanes(0.2, 4, retries=2, base=0.01)
    got = apply(asked, Timed(), ["prompt"], "raw string", lanes=lanes).collect()
    assert sorted(r.id for r in got) == list(range(30)) and {r.id for r in got if r.error} == {9, 19, 29}
    starts = sorted(float(r.raw) for r in got if r.raw)
    assert len(starts) == 27 and all(b - a >= 0.2 * 0.9 for a, b in zip(starts, starts[1:]))
    together = apply(asked.where("id % 10 < 7"), Timed(), ["prompt"], "raw string", lanes=Lanes(0.1, 3, batch=4)).collect()
    assert sorted(r.id for r in together) == [i for i in range(30) if i % 10 < 7] and len({r.raw for r in together}) < 12
    assert apply(asked.limit(0), Timed(), ["prompt"], "raw string", lanes=lanes).count() == 0
