"""Streams give what the batch fold gives, however events are dealt into batches, and leave no state behind."""

import random
import shutil
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestore.streaming import timers

SCHEMA = "job string, ts timestamp, seq long, action string, fence long"
START = datetime(2024, 1, 1, tzinfo=UTC)
T0 = int(START.timestamp())


def drawn(seed, jobs=6, n=160, minutes=60):
    rng = random.Random(seed)
    return [(f"j{rng.randrange(jobs)}", START + timedelta(seconds=rng.randrange(minutes * 60)), i, rng.choice(["claim", "claim", "renew", "finish", "fail", "defer"]), rng.randint(1, 3)) for i in range(n)]


def streamed(spark, tmp_path, name, batches, rule, late="10 minutes"):
    """Rows, and the number of state rows after the last batch."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.ROCKSDB)
    folder = tmp_path / name
    folder.mkdir()
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = timers.stream(source, rule, "job", "ts", "seq", late).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    try:
        for n, batch in enumerate(batches):
            part = tmp_path / f"{name}-{n}"
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(str(part))
            for f in part.glob("*.parquet"):
                shutil.move(f, folder / f"{n:03d}-{f.name}")
            query.processAllAvailable()
        query.processAllAvailable()
        state = query.lastProgress["stateOperators"][0]["numRowsTotal"]
        return [tuple(r) for r in spark.table(name).collect()], state
    finally:
        query.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def plain_leases(events, lease, most, wait, keep, upto):
    """Second by second."""
    out, byjob = [], {}
    for job, ts, seq, action, fence in events:
        byjob.setdefault(job, {}).setdefault(int(ts.timestamp()), []).append((seq, action, fence))
    for job, at in byjob.items():
        own = None
        for now in range(T0, upto + 1):
            if own and own["until"] is not None and own["until"] < now:
                out.append((job, own["until"], "lease", "expired", own["fence"], own["attempts"]))
                own |= {"due": own["until"], "last": own["until"], "until": None, "done": own["attempts"] >= most}
            if own and own["until"] is None and own["last"] + keep < now:
                own = None
            for _, action, fence in sorted(at.get(now, [])):
                own = own or {"fence": 0, "attempts": 0, "until": None, "due": 0, "done": False}
                own["last"], held = now, own["until"] is not None
                ok = (not own["done"] and not held and now >= own["due"] and own["attempts"] < most) if action == "claim" else held and fence == own["fence"]
                if ok and action == "claim":
                    own |= {"fence": own["fence"] + 1, "attempts": own["attempts"] + 1, "until": now + lease}
                elif ok and action == "renew":
                    own["until"] = now + lease
                elif ok:
                    own |= {"until": None, "due": now + wait, "done": action == "finish" or (action == "fail" and own["attempts"] >= most)}
                    own["attempts"] -= action == "defer"
                out.append((job, now, action, "accepted" if ok else "rejected", own["fence"], own["attempts"]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_batch_against_a_plain_clock(spark, seed):
    events, upto = drawn(seed), T0 + 5400
    got = timers.batch(spark.createDataFrame(events, SCHEMA), timers.Leases(60, 3, 20, 400), "job", "ts", "seq", upto)
    rows = [tuple(r) for r in got.collect()]
    assert sorted(rows, key=str) == plain_leases(events, 60, 3, 20, 400, upto) and {r[3] for r in rows} == {"accepted", "rejected", "expired"}


def test_stream_equals_batch_and_forgets(spark, tmp_path):
    events = drawn(7)
    rng = random.Random(8)
    dealt = sorted(events, key=lambda e: e[1] + timedelta(seconds=rng.randrange(500)))  # late by less than the watermark allows
    end = [("end", START + timedelta(hours=3, minutes=k), 10_000 + k, "claim", 0) for k in (0, 1)]
    batches = [dealt[i : i + 40] for i in range(0, len(dealt), 40)] + [end[:1], end[1:]]
    rule = timers.Leases(60, 3, 20, 400)
    got, state = streamed(spark, tmp_path, "leases_timed", batches, rule)
    want = plain_leases(events, 60, 3, 20, 400, T0 + 3 * 3600 - 600)
    assert sorted((r for r in got if r[0] != "end"), key=str) == want
    assert state <= 6  # of the last key only: its waiting events and their timers


@pytest.mark.parametrize(("name", "rule"), [("limited", timers.Limiter(900, 2)), ("cooled", timers.Cooldowns(300)), ("failed_over", timers.Cooldowns(300, extending=False))])
def test_limits_and_cooldowns(spark, tmp_path, name, rule):
    events = drawn(11, n=60)
    end = [("end", START + timedelta(hours=5, minutes=k), 10_000 + k, "claim", 0) for k in (0, 1)]
    got, state = streamed(spark, tmp_path, name, [events[::2], events[1::2], end[:1], end[1:]], rule, "2 hours")
    whole = timers.batch(spark.createDataFrame(events, SCHEMA), rule, "job", "ts", "seq").collect()
    assert sorted(r for r in got if r[0] != "end") == sorted(map(tuple, whole)) and len(whole) == 60 and state <= 6


def test_no_events(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert timers.batch(none, timers.Leases(), "job", "ts", "seq").collect() == []
    one = spark.createDataFrame([(None, START, 1, "claim", None)], SCHEMA)
    assert [tuple(r) for r in timers.batch(one, timers.Leases(), "job", "ts", "seq", T0 + 500).collect()] == [(None, T0, "claim", "accepted", 1, 1), (None, T0 + 120, "lease", "expired", 1, 1)]


def test_table_streamed(spark, tmp_path, sf):
    """The events of the table, as jobs of their users."""
    from lodestore.plans.lifecycle import LEASES, job_events

    events = job_events(spark, sf).select(F.col("user_id").cast("string").alias("job"), "ts", F.col("event_id").alias("seq"), "action", "fence").orderBy("ts").collect()
    last = max(e["ts"] for e in events)
    rows = [tuple(e) for e in events]
    end = [("end", last + timedelta(days=200, minutes=k), 10**9 + k, "claim", 0) for k in (0, 1)]
    half = len(rows) // 2
    got, state = streamed(spark, tmp_path, "table_timed", [rows[:half], rows[half:], end[:1], end[1:]], LEASES, "1 hour")
    whole = timers.batch(job_events(spark, sf), LEASES, "user_id", "ts", "event_id", int(last.timestamp()) + 100 * 86400).collect()
    assert sorted((r for r in got if r[0] != "end"), key=str) == sorted(map(tuple, whole), key=str) and state <= 6
