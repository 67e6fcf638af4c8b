"""Tickets against a plain clock; streams against the batch."""

import random
import shutil
from datetime import UTC, datetime, timedelta

import pytest

from lodestore.streaming import tickets, timers

SCHEMA = "instance string, ts timestamp, n long, text string, cost long"
START = datetime(2024, 1, 1, tzinfo=UTC)
T0 = int(START.timestamp())
RULE = tickets.Tickets(most=4, deadline=12, entries=3, ttl=40, longest=6)


def drawn(seed, n=300, seconds=1500):
    rng = random.Random(seed)
    words = ["a", "b", "c", "d", "e", "too long", None]
    return [(f"m{rng.randrange(2)}", START + timedelta(seconds=rng.randrange(seconds) // rng.choice([1, 1, 60]) ), i, rng.choice(words), rng.choice([0, 1, 3, 7, 20, None])) for i in range(n)]


def plain(events, rule):
    """Second by second, with every caller's own view of line, cache and clock."""
    out = []
    for own in sorted({e[0] for e in events}, key=str):
        mine = sorted((e for e in events if e[0] == own), key=lambda e: (int(e[1].timestamp()), e[2]))
        last = int(mine[-1][1].timestamp()) + sum(e[4] or 0 for e in mine) + rule.deadline + 1
        line, busy, recent, until = [], None, [], {}

        def cached(text, now):
            if text in until and now < until[text]:
                recent.remove(text)
                recent.append(text)
                return True
            if text in until:
                del until[text]
                recent.remove(text)
            return False

        def settle(now):
            nonlocal busy
            moved = True
            while moved:
                moved = False
                if busy and busy[0] == now:
                    text = busy[1]
                    busy, moved = None, True
                    if len(text) <= rule.longest:
                        if text in until:
                            recent.remove(text)
                        recent.append(text)
                        until[text] = now + rule.ttl
                        if len(recent) > rule.entries:
                            del until[recent.pop(0)]
                if not busy:
                    for ticket in list(line):
                        if cached(ticket[2], now):
                            line.remove(ticket)
                            out.append((own, ticket[1], ticket[0], "shared", now))
                for ticket in list(line):
                    if now - ticket[1] >= rule.deadline:
                        line.remove(ticket)
                        out.append((own, ticket[1], ticket[0], "expired", now))
                while line and not busy:
                    n, at, text, cost = line.pop(0)
                    if cost is None:
                        out.append((own, at, n, "failed", now))
                        continue
                    busy, moved = (now + cost, text), True
                    out.append((own, at, n, "served", now + cost) if now + cost - at <= rule.deadline else (own, at, n, "late", at + rule.deadline))

        for now in range(T0, last + 1):
            settle(now)
            for _, ts, n, text, cost in mine:
                if int(ts.timestamp()) == now:
                    text = text or ""
                    if cached(text, now):
                        out.append((own, now, n, "cached", now))
                    elif len(line) + bool(busy) >= rule.most:
                        out.append((own, now, n, "refused", now))
                    else:
                        line.append((n, now, text, cost))
                        settle(now)
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_batch_against_a_plain_clock(spark, seed):
    events = drawn(seed)
    got = tickets.batch(spark.createDataFrame(events, SCHEMA), RULE, "instance", "ts", "n", "text", "cost")
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == plain(events, RULE) and len(rows) == len(events)
    assert {r[3] for r in rows} == {"cached", "refused", "served", "shared", "expired", "late", "failed"}


def test_cuts_change_nothing(spark):
    """Sparse requests fall into many stretches, whose outcomes are those of the whole."""
    events = drawn(5, n=200, seconds=20000)
    frame = spark.createDataFrame(events, SCHEMA)
    rows = sorted((tuple(r) for r in tickets.batch(frame, RULE, "instance", "ts", "n", "text", "cost").collect()), key=str)
    assert rows == plain(events, RULE)


def test_stream_equals_batch_and_forgets(spark, tmp_path):
    events = drawn(7, n=160)
    rng = random.Random(8)
    dealt = sorted(events, key=lambda e: e[1] + timedelta(seconds=rng.randrange(500)))
    end = [("end", START + timedelta(hours=3, minutes=k), 10_000 + k, "a", 1) for k in (0, 1)]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.ROCKSDB)
    folder = tmp_path / "requests"
    folder.mkdir()
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    told = tickets.stream(source, RULE, "instance", "ts", "n", "text", "cost")
    query = told.writeStream.format("memory").queryName("tickets").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for k, part in enumerate([dealt[:50], dealt[50:100], dealt[100:], end[:1], end[1:]]):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"part-{k}"))
            for f in (tmp_path / f"part-{k}").glob("*.parquet"):
                shutil.move(f, folder / f"{k:03d}-{f.name}")
            query.processAllAvailable()
        query.processAllAvailable()
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        rows = sorted((tuple(r) for r in spark.table("tickets").collect() if r["key"] != "end"), key=str)
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert rows == plain(events, RULE) and state <= 12  # of the last key only


def test_no_requests_and_nulls(spark):
    assert tickets.batch(spark.createDataFrame([], SCHEMA), RULE, "instance", "ts", "n", "text", "cost").collect() == []
    one = spark.createDataFrame([(None, START, 1, None, None), (None, START, 2, None, 2)], SCHEMA)
    rows = sorted(tuple(r) for r in tickets.batch(one, RULE, "instance", "ts", "n", "text", "cost").collect())
    assert rows == [(None, T0, 1, "failed", T0), (None, T0, 2, "served", T0 + 2)]
