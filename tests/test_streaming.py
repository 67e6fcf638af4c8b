import pytest

from lodestore.streaming import queue


def replay(spark, tmp_path, schema, batches, build, name):
    """Run the stream over one file a batch."""
    folder = tmp_path / name
    folder.mkdir()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))
    query = build(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    try:
        for n, batch in enumerate(batches):
            spark.createDataFrame(batch, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}-{n}"))
            for f in (tmp_path / f"{name}-{n}").glob("*.parquet"):
                f.rename(folder / f"{n}-{f.name}")
            query.processAllAvailable()
        return spark.table(name).collect()
    finally:
        query.stop()


def test_leases(spark, tmp_path):
    batches = [[(1, 0, "claim", 0), (2, 0, "claim", 0), (1, 50, "claim", 0)], [(1, 100, "renew", 1), (1, 210, "finish", 1), (2, 130, "finish", 1), (2, 131, "claim", 0)], [(2, 140, "fail", 2), (2, 145, "claim", 0), (2, 150, "claim", 0), (2, 160, "fail", 3), (2, 200, "claim", 0)]]
    rows = replay(spark, tmp_path, "job_id long, at long, action string, fence long", batches, queue.leases, "leases")
    got = {(r["job_id"], r["at"], r["action"]): (r["outcome"], r["fence"], r["attempts"]) for r in rows}
    assert got[1, 0, "claim"] == ("accepted", 1, 1) and got[1, 50, "claim"][0] == "rejected"
    assert got[1, 100, "renew"][0] == "accepted" and got[1, 210, "finish"][0] == "accepted"
    assert got[2, 130, "finish"][0] == "rejected" and got[2, 131, "claim"] == ("accepted", 2, 2)
    assert got[2, 145, "claim"][0] == "rejected" and got[2, 150, "claim"] == ("accepted", 3, 3) and got[2, 200, "claim"][0] == "rejected"


def test_limiter_windows_are_anchored(spark, tmp_path):
    rows = replay(spark, tmp_path, "email string, at long", [[("a", 10), ("a", 20), ("a", 30)], [("a", 905), ("a", 915), ("b", 1)]], lambda s: queue.limiter(s, "email", 900, 2), "limits")
    assert sorted((r["key"], r["at"], r["allowed"]) for r in rows) == [("a", 10, True), ("a", 20, True), ("a", 30, False), ("a", 905, False), ("a", 915, True), ("b", 1, True)]


@pytest.mark.parametrize(("extending", "last"), [(True, 4300), (False, 1800)])
def test_cooldowns(spark, tmp_path, extending, last):
    rows = replay(spark, tmp_path, "key string, at long", [[("m", 0)], [("m", 1000), ("m", 1700)], [("m", 2500 if extending else 1750)]], lambda s: queue.cooldowns(s, 1800, extending), f"cool{extending}")
    assert max(r["until"] for r in rows) == last


def test_daily_calls(spark, tmp_path):
    from datetime import datetime as d

    rows = replay(spark, tmp_path, "ts timestamp", [[(d(2024, 1, 1, 5),), (d(2024, 1, 1, 23),)], [(d(2024, 1, 9),)], [(d(2024, 1, 9, 1),)]], queue.daily_calls, "days")
    assert [(r["day"], r["calls"]) for r in rows] == [(d(2024, 1, 1), 2)]
