"""Query vectors as a queue in event time: tickets in order of arrival, one deadline, a cache of recent vectors (STM08).

An instance works on one query at a time. A request whose vector is cached is answered at once; if too many are pending
it is refused; else it waits in line. What is computed for a query of at most ``longest`` characters is cached, and answers all in line that
ask the same. The deadline covers waiting and computing: a request that meets it in line never starts; one that meets it while computed
is given up, but the computation goes on, holds the instance to its end and is cached.

Requests have a second of their own and the seconds that their computation takes, so a replay gives the same outcomes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from lodestore.streaming import timers


class Tickets:
    """A rule for ``timers``. Its state: the computation under way (``end``, ``query``, ``short``) if any, the line of
    tickets, and the cache (``query``, ``expires``), least recently used first.

    Outcomes are told once they are certain, with the second ``ended`` in which the caller has them: ``cached``,
    ``refused``, ``served``, ``shared`` (by the computation of an equal query), ``expired`` (in line), ``late`` (given up while
    computed), ``failed`` (no ``cost``: the model fails at once). What ends in a second precedes what arrives in it.
    """

    event = "request long, query string, short long, cost long"
    output = "at long, request long, outcome string, ended long"
    line = "request long, at long, query string, short long, cost long"

    def __init__(self, most: int = 64, deadline: int = 5, entries: int = 256, ttl: int = 300, longest: int = 500):
        self.most, self.deadline, self.entries, self.ttl, self.longest = most, deadline, entries, ttl, longest

    def _known(self, cache: dict, query: str, now: int) -> bool:
        """Whether the cache has the query, which is then its last used; what has expired goes when it is asked for."""
        expires = cache.pop(query, None)
        if expires is None or now >= expires:
            return False
        cache[query] = expires
        return True

    def _start(self, line: list, now: int, rows: list) -> tuple | None:
        """The computation of the first ticket that can be computed."""
        while line:
            request, at, query, short, cost = line.pop(0)
            if cost is None:
                rows.append((at, request, "failed", now))
                continue
            ended = now + cost
            rows.append((at, request, "served", ended) if ended <= at + self.deadline else (at, request, "late", at + self.deadline))
            return ended, query, short
        return None

    def advance(self, state: tuple | None, upto: float) -> tuple[tuple | None, list[tuple]]:
        """What happens up to the second ``upto`` if no request comes."""
        rows: list[tuple] = []
        if state is None:
            return None, rows
        active, line, cache = state[0], list(state[1]), dict(state[2])
        while active is not None:
            now = min(active[0], line[0][1] + self.deadline) if line else active[0]
            if now > upto:
                break
            free = active[0] == now
            if free:
                if active[2]:
                    cache.pop(active[1], None)
                    cache[active[1]] = now + self.ttl
                    while len(cache) > self.entries:
                        del cache[next(iter(cache))]
                shared = [t for t in line if self._known(cache, t[2], now)]
                rows += [(t[1], t[0], "shared", now) for t in shared]
                line = [t for t in line if t not in shared]
            rows += [(t[1], t[0], "expired", now) for t in line if t[1] + self.deadline <= now]
            line = [t for t in line if t[1] + self.deadline > now]
            if free:
                active = self._start(line, now, rows)
        if active is None and all(expires <= upto for expires in cache.values()):
            return None, rows
        return (active, line, cache), rows

    def step(self, state: tuple | None, at: int, request: int, query: str, short: int, cost: int | None) -> tuple[tuple, list[tuple]]:
        active, line, cache = (None, [], {}) if state is None else (state[0], list(state[1]), dict(state[2]))
        if self._known(cache, query, at):
            return (active, line, cache), [(at, request, "cached", at)]
        if len(line) + (active is not None) >= self.most:
            return (active, line, cache), [(at, request, "refused", at)]
        rows: list[tuple] = []
        line.append((request, at, query, short, cost))
        if active is None:
            active = self._start(line, at, rows)
        if active is not None and active[0] == at:  # takes no time
            state, told = self.advance((active, line, cache), at)
            return state or (None, [], {}), rows + told
        return (active, line, cache), rows

    def wake(self, state: tuple) -> int:
        """The last second before which ``advance`` changes nothing."""
        active, line, cache = state
        if active is None:
            return max(cache.values(), default=0)
        return min(active[0], line[0][1] + self.deadline) if line else active[0]


class _Processor(timers._Processor):
    """Line and cache are lists of the state store: a ticket that comes or goes does not rewrite what an instance knows."""

    def keep(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "end long, query string, short long")
        self.line = handle.getListState("line", Tickets.line)
        self.cache = handle.getListState("cache", "query string, expires long")

    def load(self) -> tuple | None:
        plain = lambda rows: [tuple(map(timers._plain, r)) for r in rows]
        active = tuple(map(timers._plain, self.active.get())) if self.active.exists() else None
        line, cache = plain(self.line.get()), dict(plain(self.cache.get()))
        self.before = (active, line, list(cache.items()))
        return None if active is None and not cache else (active, line, cache)

    def save(self, state: tuple | None) -> None:
        active, line, cache = state or (None, [], {})
        for own, rows, before in ((self.line, line, self.before[1]), (self.cache, list(cache.items()), self.before[2])):
            if rows[: len(before)] == before:
                for row in rows[len(before) :]:
                    own.appendValue(row)
            elif rows:
                own.put(rows)
            else:
                own.clear()
        if active is None:
            self.active.clear()
        elif active != self.before[0]:
            self.active.update(active)


def _requests(requests: DataFrame, rule: Tickets, key: str, ts: str, seq: str, text: str, cost: str) -> DataFrame:
    """Queries by their digest, so that long ones take no more of the state than short ones. Null texts are empty; costs
    are whole seconds, none below 0."""
    own, seconds = F.coalesce(F.col(text), F.lit("")), F.col(cost).cast("long")
    return requests.select(
        F.col(key).alias("_instance"), F.col(ts).alias("_ts"), F.col(seq).cast("long").alias("request"), F.sha2(own, 256).alias("query"),
        (F.length(own) <= rule.longest).cast("long").alias("short"), F.when(seconds < 0, 0).otherwise(seconds).alias("cost"),
    )


def batch(requests: DataFrame, rule: Tickets, key: str, ts: str, seq: str, text: str, cost: str) -> DataFrame:
    """``key``, ``at``, ``request`` (its ``seq``), ``outcome`` and ``ended`` of every request of a table. Requests have different ``seq``.

    An instance's history is cut where it surely is idle and remembers nothing: were every request computed, all would be
    done, and out of the cache, before the next one comes. This bound is a prefix maximum over prefix sums, so windows
    find the cuts, and a group is one busy stretch and not an instance.
    """
    own = _requests(requests, rule, key, ts, seq, text, cost)
    at = F.floor(F.unix_micros(F.col("_ts").cast("timestamp")) / 1_000_000).cast("long")
    order = W.partitionBy("_instance").orderBy("_at", "request")
    spent = own.withColumn("_at", at).withColumn("_spent", F.sum(F.coalesce("cost", F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0)))
    idle = spent.withColumn("_done", F.max(F.col("_at") - F.col("_spent") + F.coalesce("cost", F.lit(0))).over(order.rowsBetween(W.unboundedPreceding, 0)) + F.col("_spent"))
    begins = F.coalesce(F.col("_at") >= F.lag("_done").over(order) + rule.ttl, F.lit(True))
    cut = idle.withColumn("_begins", begins.cast("long")).withColumn("_stretch", F.sum("_begins").over(order.rowsBetween(W.unboundedPreceding, 0)))
    names = ["_at", "request", "again", "query", "short", "cost"]

    def run(of: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        events = [tuple(map(timers._plain, r)) for r in frame[names].itertuples(index=False, name=None)]
        rows = timers.fold(rule, None, events, float("inf"))[1]
        return pd.DataFrame([(of[0], *r) for r in rows], columns=["key", "at", "request", "outcome", "ended"])

    dealt = cut.select(F.col("_instance").cast("string").alias("key"), "_stretch", "_at", "request", F.col("request").alias("again"), "query", "short", "cost")
    return dealt.groupBy("key", "_stretch").applyInPandas(run, f"key string, {rule.output}")


def stream(requests: DataFrame, rule: Tickets, key: str, ts: str, seq: str, text: str, cost: str, late: str = "10 minutes") -> DataFrame:
    """The same for a stream, in append mode: each outcome follows once the watermark has passed what decides it."""
    return timers.stream(_requests(requests, rule, key, ts, seq, text, cost), rule, "_instance", "_ts", "request", late, _Processor)
