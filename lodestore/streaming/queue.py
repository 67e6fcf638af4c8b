"""Queue semantics as Structured Streaming state: leases, retries, rate limits, cooldowns (STM02-STM07).

Input rows are events with a time of their own; nothing reads the clock, so a replay gives the same results. Each
function groups by a key and keeps a few numbers a key. ``leases``, ``limiter`` and ``cooldowns`` have no watermark: they take
events in the order in which batches bring them, and keep a key's numbers for ever. ``streaming.timers`` has forms that
order events by time and forget keys without news.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

LEASE, ATTEMPTS, WAIT = 120, 3, 10


def leases(events: DataFrame, lease: int = LEASE, most: int = ATTEMPTS, wait: int = WAIT) -> DataFrame:
    """Events (``job_id``, ``at`` in seconds, ``action``, ``fence``) to outcomes (``job_id``, ``at``, ``action``, ``outcome``,
    ``fence``, ``attempts``).

    ``claim`` takes a job that is free, due and has attempts left, and gives the next fence; ``renew`` and ``finish``
    count only with the current fence and before the lease runs out; ``fail`` makes the job due again after ``wait``
    seconds until its attempts are spent; ``defer`` does the same without spending one.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fence, attempts, until, due, done = state.get if state.exists else (0, 0, -1, 0, 0)
        rows = []
        for frame in frames:
            for at, action, given in sorted(zip(frame["at"], frame["action"], frame["fence"], strict=True)):
                held = until >= at
                mine = held and given == fence
                if action == "claim":
                    ok = not done and not held and at >= due and attempts < most
                    if ok:
                        fence, attempts, until = fence + 1, attempts + 1, at + lease
                elif action == "renew":
                    ok = mine and not done
                    until = at + lease if ok else until
                else:
                    ok = mine and not done
                    if ok:
                        until = -1
                        done = 1 if action == "finish" or (action == "fail" and attempts >= most) else 0
                        due = at + wait
                        attempts -= action == "defer"
                rows.append((key[0], int(at), action, "accepted" if ok else "rejected", int(fence), int(attempts)))
        state.update((int(fence), int(attempts), int(until), int(due), int(done)))
        yield pd.DataFrame(rows, columns=["job_id", "at", "action", "outcome", "fence", "attempts"])

    return events.groupBy("job_id").applyInPandasWithState(
        step, "job_id long, at long, action string, outcome string, fence long, attempts long", "fence long, attempts long, until long, due long, done long", "append", GroupStateTimeout.NoTimeout
    )


def limiter(events: DataFrame, key: str, seconds: int, most: int) -> DataFrame:
    """Events (key, ``at`` in seconds) to (key, ``at``, ``allowed``): at most ``most`` in a window that begins with its
    first event (STM05)."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        rows = []
        for frame in frames:
            for at in sorted(frame["at"]):
                if start is None or at >= start + seconds:
                    start, n = at, 0
                n += 1
                rows.append((k[0], int(at), bool(n <= most)))
        state.update((int(start), int(n)))
        yield pd.DataFrame(rows, columns=["key", "at", "allowed"])

    return events.select(F.col(key).cast("string").alias("key"), "at").groupBy("key").applyInPandasWithState(step, "key string, at long, allowed boolean", "start long, n long", "append", GroupStateTimeout.NoTimeout)


def cooldowns(failures: DataFrame, seconds: int = 1800, extending: bool = True) -> DataFrame:
    """Failures (``key``, ``at``) to (``key``, ``at``, ``until``): a cooldown that each failure extends, or a failover that
    lasts from its first one (STM07)."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (until,) = state.get if state.exists else (-1,)
        rows = []
        for frame in frames:
            for at in sorted(frame["at"]):
                if extending or at >= until:
                    until = at + seconds
                rows.append((k[0], int(at), int(until)))
        state.update((int(until),))
        yield pd.DataFrame(rows, columns=["key", "at", "until"])

    return failures.select(F.col("key").cast("string").alias("key"), "at").groupBy("key").applyInPandasWithState(step, "key string, at long, until long", "until long", "append", GroupStateTimeout.NoTimeout)


def daily_calls(calls: DataFrame, at: str = "ts", late: str = "1 day") -> DataFrame:
    """Calls by UTC day, in append mode after the watermark has passed the day (STM06)."""
    return calls.withWatermark(at, late).groupBy(F.window(at, "1 day").alias("day")).agg(F.count(F.lit(1)).alias("calls")).select(F.col("day.start").alias("day"), "calls")
