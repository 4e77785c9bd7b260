"""Plug-ins for what this engine doesn't compute itself: page text, OCR, embeddings, drafts and judgments.

A provider is any object with `run(rows)`: a list of dicts in, a list of dicts out, in the same order. It is called on
the executors, a batch at a time; what it raises becomes the rows' error. The providers here are deterministic.
"""

from __future__ import annotations

import hashlib
import json
import random
import time
from collections.abc import Callable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR_SIZE, MOST_TEXTS = 384, 2000


class Provider(Protocol):
    def run(self, rows: list[dict]) -> list[dict]: ...


class HashEmbedder:
    """Unit vectors from signed hashes of words. Deterministic; equal texts have equal vectors."""

    def __init__(self, size: int = VECTOR_SIZE):
        self.size = size

    def run(self, rows: list[dict]) -> list[dict]:
        out = []
        for row in rows:
            v = [0.0] * self.size
            for word in (row["text"] or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.size] += 1.0 if h >> 63 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append({"vector": [x / n for x in v] if n else v})
        return out


class KeepingJudge:
    """Answers every pair with RELATED and a fixed confidence."""

    def run(self, rows: list[dict]) -> list[dict]:
        return [{"raw": json.dumps({"relationship_type": "RELATED", "confidence": 0.6, "explanation": "kept as related"})} for _ in rows]


class NoProvider:
    """Always unavailable."""

    def run(self, rows: list[dict]) -> list[dict]:
        raise RuntimeError("no provider is configured")


def resolve(name: str | None, known: dict[str, Callable[[], Provider]]) -> Provider | None:
    """None where nothing is configured; unknown names are an error."""
    if not name:
        return None
    if name not in known:
        raise ValueError(f"unknown provider: {name}")
    return known[name]()


def backoff(attempt: int, base: float, most: float, retry_after: float | None = None, draw: Callable[[], float] = random.random) -> float:
    """Seconds before the next attempt: doubled each time up to `most`, raised to what the service asks for; half of it is drawn."""
    delay = min(most, max(base * 2 ** (attempt - 1), retry_after or 0.0))
    return delay / 2 + draw() * delay / 2


class ProviderError(Exception):
    """What a service says: its HTTP status where there is one, and how long it asks to wait."""

    def __init__(self, message: str, status: int | None = None, headers: dict | None = None):
        super().__init__(message)
        self.status, self.headers = status, headers or {}


def retry_after(headers: dict) -> float | None:
    """Seconds that a service asks to wait; null where it says nothing that is a number from 0 on."""
    named = {str(k).lower(): v for k, v in headers.items()}
    for name, unit in (("retry-after", 1.0), ("retry-after-ms", 1000.0)):
        try:
            seconds = float(str(named[name]).strip()) / unit
        except (KeyError, ValueError):
            continue
        if seconds >= 0:
            return seconds
    return None


def final(error: Exception) -> bool:
    """Errors that a second try won't mend: refused requests, a day's quota used up, a prompt over the model's context."""
    text = str(error).lower()
    status = getattr(error, "status", None)
    return "tokens per day" in text or "(tpd)" in text or "context length" in text or status in (400, 401, 403, 404, 422)


def error_kind(status: Column, reached: Column, readable: Column) -> Column:
    """What a failed call to a model service means: unavailable, runtime or malformed; null where it worked."""
    return F.when(~reached | (status == 503), "unavailable").when(status >= 400, "runtime").when(~readable, "malformed")


class Paced:
    """Spaces the starts of calls by `interval` seconds at least, in one worker."""

    def __init__(self, provider: Provider, interval: float = 2.5, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.provider, self.interval, self.clock, self.sleep, self.last = provider, interval, clock, sleep, None

    def run(self, rows: list[dict]) -> list[dict]:
        out = []
        for row in rows:
            if self.last is not None and (wait := self.interval - (self.clock() - self.last)) > 0:
                self.sleep(wait)
            self.last = self.clock()
            out += self.provider.run([row])
        return out


class Retrying:
    """Tries again after errors that may pass, `most` times, with growing waits; others are raised at once. An answer that `readable` refuses is such an error."""

    def __init__(self, provider: Provider, most: int = 5, base: float = 1.0, longest: float = 60.0, readable: Callable[[list[dict]], bool] | None = None, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random):
        self.provider, self.most, self.base, self.longest, self.readable, self.sleep, self.draw = provider, most, base, longest, readable, sleep, draw

    def run(self, rows: list[dict]) -> list[dict]:
        for attempt in range(1, self.most + 2):
            try:
                out = self.provider.run(rows)
                if self.readable is None or self.readable(out):
                    return out
                raise ProviderError("unreadable answer")
            except Exception as e:
                if final(e) or attempt > self.most:
                    raise
                self.sleep(backoff(attempt, self.base, self.longest, retry_after(getattr(e, "headers", {})), self.draw))
        raise AssertionError


#: A start may come this share of the interval after its slot has begun; slots are longer by as much.
SLACK = 0.25


class Lanes:
    """Spaces the starts of all calls of a job by `interval` seconds at least, whatever the number of workers.

    Time is cut into slots, dealt to `n` lanes in turn; a lane's rows lie in one task, and each call, a second try too, starts at
    the beginning of one of its lane's slots. Starts in different slots are an interval apart, so workers needn't talk. Their
    clocks may differ by a quarter of the interval less what a start is late; speculative copies of tasks must be off, and jobs
    that ask the same service run one at a time. More lanes than tasks at a time leave slots unused, but none is used twice."""

    def __init__(self, interval: float = 2.5, n: int = 8, batch: int = 1, retries: int = 5, base: float = 1.0, longest: float = 60.0, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        if n < 1 or batch < 1:
            raise ValueError("there is one lane, and one row to a call, at least")
        self.interval, self.n, self.batch, self.retries, self.base, self.longest, self.clock, self.sleep = interval, n, batch, retries, base, longest, clock, sleep
        self.used: dict[int, int] = {}

    def hold(self, lane: int) -> None:
        """Waits for the next slot of the lane. The slot in which a task first asks may have been used by the one before it, so it isn't taken."""
        if self.interval <= 0:
            return
        slot = self.interval * (1 + SLACK)
        while True:
            now = self.clock()
            s = int(now // slot)
            if s % self.n == lane and s > self.used.setdefault(lane, s) and now - s * slot <= self.interval * SLACK:
                self.used[lane] = s
                return
            self.used.setdefault(lane, s)
            self.sleep((s + ((lane - s) % self.n or self.n)) * slot - now)

    def held(self, provider: Provider, lane: int) -> Provider:
        """The provider, each of whose calls waits for the lane; errors that may pass are tried again in the same lane."""
        return Retrying(_Held(provider, self, lane), self.retries, self.base, self.longest, sleep=self.sleep)


class _Held:
    def __init__(self, provider: Provider, lanes: Lanes, lane: int):
        self.provider, self.lanes, self.lane = provider, lanes, lane

    def run(self, rows: list[dict]) -> list[dict]:
        self.lanes.hold(self.lane)
        return self.provider.run(rows)


def vectors_fit(size: int = VECTOR_SIZE) -> Callable[[list[dict]], bool]:
    """Whether an embedding answer has a vector of finite numbers of this size for each text."""
    return lambda rows: all(isinstance(r.get("vector"), list) and len(r["vector"]) == size and all(isinstance(x, (int, float)) and abs(x) < float("inf") for x in r["vector"]) for r in rows)


def apply(df: DataFrame, provider: Provider, columns: list[str], result: str, batch: int = MOST_TEXTS, lanes: Lanes | None = None) -> DataFrame:
    """df with the provider's result columns (a DDL string) and `error`, filled for each batch that the provider couldn't do.

    lanes: calls are paced over the whole job, with so many rows each as the lanes say, and tried again."""
    names = [part.split()[0] for part in result.split(", ")]
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, {result}, error string"
    kinds = {f.name: f.dataType for f in df.sparkSession.createDataFrame([], result).schema}
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = {n: to_arrow_type(t) for n, t in kinds.items()}

    def done(part: pa.RecordBatch, asked: Provider) -> pa.RecordBatch:
        try:
            got, error = asked.run(part.select(columns).to_pylist()), None
        except Exception as e:  # the rows keep what went wrong; other batches go on
            got, error = [dict.fromkeys(names)] * part.num_rows, f"{type(e).__name__}: {e}"
        return pa.RecordBatch.from_arrays([*part.columns, *(pa.array([g[n] for g in got], arrow[n]) for n in names), pa.array([error] * part.num_rows, pa.string())], [*part.schema.names, *names, "error"])

    def work(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                yield done(whole.slice(at, batch), provider)

    def paced(batches):
        for whole in batches:
            lane, rows = whole.column(whole.num_columns - 1).to_numpy(), whole.select(whole.schema.names[:-1])
            ends = [*(np.flatnonzero(np.diff(lane)) + 1), len(lane)]
            for begin, end in zip([0, *ends], ends):  # rows of one lane
                for at in range(begin, end, lanes.batch):
                    yield done(rows.slice(at, min(lanes.batch, end - at)), lanes.held(provider, int(lane[at])))

    if lanes is None:
        return df.mapInArrow(work, schema)
    lane = F.pmod(F.xxhash64(*columns), F.lit(lanes.n)).cast("int")
    dealt = df.withColumn("__lane", lane).repartition(lanes.n, "__lane")
    return (dealt.sortWithinPartitions("__lane") if lanes.batch > 1 else dealt).mapInArrow(paced, schema)


def embedded(facts: DataFrame, text: str, provider: Provider, lanes: Lanes | None = None) -> DataFrame:
    """fact_id, v: vectors of the facts' texts; facts whose batch failed are left out."""
    return apply(facts.select("fact_id", F.col(text).alias("text")), provider, ["text"], "vector array<double>", lanes=lanes).where("error is null").select("fact_id", F.col("vector").alias("v"))
