"""Queue semantics as folds over event time, the same in a batch and in a stream (STM02, STM03, STM05, STM07).

A rule says what an event does to a key's state, what happens by itself as time goes on (a lease that runs out), and
when a key can be forgotten. In a stream the events of a key wait until the watermark has passed them, so they are
taken in order of their time whatever batch brought them; timers let time go on where no event comes, and a key without
news leaves no state. A stream therefore gives the rows of the batch fold up to its watermark.

Streams need ``spark.sql.streaming.stateStore.providerClass`` to be the RocksDB provider.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Leases:
    """Events ``claim``, ``renew``, ``finish``, ``fail``, ``defer`` of a job, with the ``fence`` they were given.

    ``claim`` takes a job that is free, due and has attempts left, and gives the next fence. The others count only with
    the current fence and up to the lease's end; ``renew`` prolongs it, ``fail`` makes the job due after ``wait`` seconds
    or ends it with its last attempt, ``defer`` does not spend the attempt. A lease that runs out is told once
    (``expired``) and frees the job, or ends it with its last attempt. A job without news for ``keep`` seconds is
    forgotten; whatever comes then begins anew.
    """

    event = "action string, fence long"
    state = "fence long, attempts long, until long, due long, done long, last long"
    output = "at long, action string, outcome string, fence long, attempts long"

    def __init__(self, lease: int = 120, most: int = 3, wait: int = 10, keep: int = 7 * 86400):
        self.lease, self.most, self.wait, self.keep = lease, most, wait, keep

    def advance(self, state: tuple | None, upto: float) -> tuple[tuple | None, list[tuple]]:
        """What happens before ``upto`` if no event comes."""
        rows = []
        if state is not None:
            fence, attempts, until, due, done, last = state
            if 0 <= until < upto:
                rows.append((until, "lease", "expired", fence, attempts))
                state = fence, attempts, until, due, done, last = fence, attempts, -1, until, int(attempts >= self.most), until
            if until < 0 and last + self.keep < upto:
                state = None
        return state, rows

    def step(self, state: tuple | None, at: int, action: str, given: int | None) -> tuple[tuple, list[tuple]]:
        fence, attempts, until, due, done, last = state or (0, 0, -1, 0, 0, at)
        if action == "claim":
            ok = not done and until < 0 and at >= due and attempts < self.most
            if ok:
                fence, attempts, until = fence + 1, attempts + 1, at + self.lease
        else:
            ok = until >= 0 and given == fence and action in ("renew", "finish", "fail", "defer")
            if ok and action == "renew":
                until = at + self.lease
            elif ok:
                done, until, due = int(action == "finish" or (action == "fail" and attempts >= self.most)), -1, at + self.wait
                attempts -= action == "defer"
        return (fence, attempts, until, due, done, at), [(at, action, "accepted" if ok else "rejected", fence, attempts)]

    def wake(self, state: tuple) -> int:
        """The last second before which ``advance`` changes nothing."""
        return state[2] if state[2] >= 0 else state[5] + self.keep


class Limiter:
    """At most ``most`` events in a window of ``seconds`` that begins with its first one; a window that is over is forgotten."""

    event, state, output = "", "start long, n long", "at long, allowed boolean"

    def __init__(self, seconds: int, most: int):
        self.seconds, self.most = seconds, most

    def advance(self, state, upto):
        return (None if state is not None and state[0] + self.seconds <= upto else state), []

    def step(self, state, at):
        start, n = state or (at, 0)
        return (start, n + 1), [(at, n < self.most)]

    def wake(self, state):
        return state[0] + self.seconds


class Cooldowns:
    """A cooldown of ``seconds`` that every failure extends, or that lasts from its first one; then it is forgotten."""

    event, state, output = "", "until long", "at long, until long"

    def __init__(self, seconds: int = 1800, extending: bool = True):
        self.seconds, self.extending = seconds, extending

    def advance(self, state, upto):
        return (None if state is not None and state[0] <= upto else state), []

    def step(self, state, at):
        until = at + self.seconds if self.extending or state is None else state[0]
        return (until,), [(at, until)]

    def wake(self, state):
        return state[0]


def fold(rule: Any, state: tuple | None, events: list[tuple], upto: float | None) -> tuple[tuple | None, list[tuple]]:
    """The events (at, seq, ...) in order of time and ``seq``, then what happens before ``upto``."""
    rows = []
    for at, _, *rest in sorted(events, key=lambda e: e[:2]):
        state, told = rule.advance(state, at)
        rows += told
        state, told = rule.step(state, at, *rest)
        rows += told
    if upto is not None:
        state, told = rule.advance(state, upto)
        rows += told
    return state, rows


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(",") if f.strip()]


def _plain(value: Any) -> Any:
    return None if value is None or value != value else value if isinstance(value, str) else int(value)


def _prepared(events: DataFrame, rule: Any, key: str, ts: str, seq: str) -> DataFrame:
    own = [F.col(n) for n in _names(rule.event)]
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    return events.select(F.col(key).cast("string").alias("key"), F.col(ts).cast("timestamp").alias("ts"), F.floor(at / 1_000_000).cast("long").alias("at"), F.col(seq).cast("long").alias("seq"), *own)


def batch(events: DataFrame, rule: Any, key: str, ts: str, seq: str, upto: int | None = None) -> DataFrame:
    """``key`` and the rule's output for all events of a table; ``upto``: the second up to which time goes on after the
    last event of a key (none: it ends there). A key's events are one group."""
    names = ["at", "seq", *_names(rule.event)]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        rows = fold(rule, None, [tuple(map(_plain, r)) for r in frame[names].itertuples(index=False, name=None)], upto)[1]
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["key", *_names(rule.output)])

    return _prepared(events, rule, key, ts, seq).groupBy("key").applyInPandas(run, f"key string, {rule.output}")


class _Processor(StatefulProcessor):
    def __init__(self, rule: Any):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.keep(handle)
        event = ", ".join(filter(None, ("at long, seq long", self.rule.event)))
        self.names = _names(event)
        self.waiting = handle.getListState("waiting", event)

    def keep(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.rule.state)

    def load(self) -> tuple | None:
        return tuple(map(int, self.state.get())) if self.state.exists() else None

    def save(self, state: tuple | None) -> None:
        self.state.clear() if state is None else self.state.update(state)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for row in frame[self.names].itertuples(index=False, name=None):
                event = tuple(map(_plain, row))
                self.waiting.appendValue(event)
                self.handle.registerTimer(event[0] * 1000 + 999)
        yield self._told(key, [])

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() / 1000
        events = [tuple(map(_plain, e)) for e in self.waiting.get()]
        ripe = [e for e in events if e[0] + 1 <= now]  # no event of that second can come any more
        # time goes on to the last second whose events are all there, and no further than events that still wait
        state, rows = fold(self.rule, self.load(), ripe, min([now - 1, *(e[0] for e in events if e not in ripe)]))
        if ripe:
            later = [e for e in events if e not in ripe]
            self.waiting.put(later) if later else self.waiting.clear()
        self.save(state)
        if state is not None:
            self.handle.registerTimer(max(self.rule.wake(state) * 1000 + 2001, int(now * 1000) + 1))
        yield self._told(key, rows)

    def _told(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["key", *_names(self.rule.output)])

    def close(self) -> None:
        pass


def stream(events: DataFrame, rule: Any, key: str, ts: str, seq: str, late: str = "10 minutes", processor: type[_Processor] = _Processor) -> DataFrame:
    """The same for a stream, in append mode. Events more than ``late`` behind the newest one are dropped."""
    own = _prepared(events, rule, key, ts, seq).withWatermark("ts", late)
    return own.groupBy("key").transformWithStateInPandas(statefulProcessor=processor(rule), outputStructType=f"key string, {rule.output}", outputMode="Append", timeMode="EventTime")
