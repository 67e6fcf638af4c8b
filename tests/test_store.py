"""Memo, backup, restore and purge, with faults in between."""

import pytest
from pyspark.sql import functions as F

from lodestore.operators.memo import Memo, merged, page_ranges
from lodestore.sources.commits import Conflict, Files
from lodestore.sources.store import INCOMPLETE, PHASES, Purge, Refused, Store, backup, damaged, requeued, restore, validated


@pytest.fixture
def store(spark, tmp_path):
    made = Store(spark, str(tmp_path / "store"))
    made.write("chunks", spark.range(500).select("id", F.concat(F.lit("text "), "id").alias("text"), F.when(F.col("id") % 3 == 0, F.col("id") * 0.5).alias("x")))
    made.write("jobs", spark.createDataFrame([(1, "running", 4, 99), (2, "complete", 1, 50), (3, "queued", 0, None)], "id long, state string, generation int, lease_until long"))
    made.write("accounts", spark.createDataFrame([(1, "a"), (2, None)], "id long, name string"))
    return made


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip(spark, store, tmp_path):
    manifest = backup(store, str(tmp_path / "b"))
    assert manifest["tables"]["chunks"]["rows"] == 500 and set(manifest["tables"]) == {"chunks", "jobs", "accounts"} and validated(spark, str(tmp_path / "b")) == manifest
    with pytest.raises(Refused):
        backup(store, str(tmp_path / "b"))
    back = Store(spark, str(tmp_path / "back"))
    restore(spark, str(tmp_path / "b"), back, exactly=["accounts", "chunks", "jobs"])
    assert rows(back.read("chunks")) == rows(store.read("chunks")) and back.read("chunks").schema == store.read("chunks").schema
    assert rows(back.read("jobs")) == [(1, "queued", 5, None), (2, "complete", 1, 50), (3, "queued", 0, None)] == rows(requeued(store.read("jobs")))
    with pytest.raises(Refused):
        restore(spark, str(tmp_path / "b"), back)
    with pytest.raises(Refused):
        restore(spark, str(tmp_path / "b"), Store(spark, str(tmp_path / "other")), exactly=["chunks"])
    assert Store(spark, str(tmp_path / "other")).names() == []


@pytest.mark.parametrize("fault", ["changed", "missing", "unexpected", "incomplete", "manifest", "digests"])
def test_faulty_backups_are_refused(spark, store, tmp_path, fault):
    backup(store, str(tmp_path / "b"), ["chunks", "accounts"])
    part = next((tmp_path / "b" / "tables" / "chunks").glob("*.parquet"))
    if fault == "changed":
        part.write_bytes(part.read_bytes()[:-9] + b"x" + part.read_bytes()[-8:])
        for crc in part.parent.glob(".*.crc"):
            crc.unlink()
    elif fault == "missing":
        part.unlink()
    elif fault == "unexpected":
        part.with_name("part-more.parquet").write_bytes(part.read_bytes())
    elif fault == "incomplete":
        (tmp_path / "b" / INCOMPLETE).write_text("x")
    elif fault == "manifest":
        (tmp_path / "b" / "manifest.json").unlink()
    else:
        spark.createDataFrame([("a", 1, "b")], "path string, length long, sha256 string").write.mode("append").parquet(str(tmp_path / "b" / "digests"))
    target = Store(spark, str(tmp_path / "back"))
    with pytest.raises(Refused):
        restore(spark, str(tmp_path / "b"), target)
    assert target.names() == []
    if fault in ("changed", "missing", "unexpected"):
        assert [r["status"] for r in damaged(spark, str(tmp_path / "b")).collect()] == [fault]


@pytest.mark.parametrize("stop", [*PHASES[:-1], None])
def test_purge_goes_on_from_any_phase(spark, store, tmp_path, stop):
    before = store.snapshot()
    archive = str(tmp_path / "archive")
    first = Purge(store, archive, ["chunks", "jobs"]).run(stop_after=stop)
    assert first["phase"] == (stop or "complete")
    entry = Purge(Store(spark, str(tmp_path / "store")), archive, ["chunks", "jobs"]).run()
    assert entry["phase"] == "complete" and store.read("chunks").count() == store.read("jobs").count() == 0
    assert store.snapshot()["accounts"] == before["accounts"] and rows(store.read("accounts")) == [(1, "a"), (2, None)]
    back = Store(spark, str(tmp_path / "back"))
    restore(spark, f"{archive}/backup", back, after={"jobs": lambda df: df})
    assert back.snapshot() == before


def test_purge_after_a_lost_run(spark, store, tmp_path):
    """A backup half written, and a table already cleared when the run was lost."""
    archive = str(tmp_path / "archive")
    purge = Purge(store, archive, ["chunks", "jobs"])
    purge.run(stop_after="begun")
    Files(spark, archive).publish(f"backup/{INCOMPLETE}", "x")
    purge.run(stop_after="clearing")
    store.write("chunks", store.read("chunks").limit(0), expected=1)
    assert purge.run()["phase"] == "complete" and store.number("chunks") == 2


def test_purge_refuses_what_changed(spark, store, tmp_path):
    purge = Purge(store, str(tmp_path / "archive"), ["chunks"])
    with pytest.raises(Refused):
        Purge(store, str(tmp_path / "none"), ["nothing"]).run()
    purge.run(stop_after="backed_up")
    store.write("accounts", spark.createDataFrame([(3, "c")], "id long, name string"))
    with pytest.raises(Refused):
        purge.run()
    assert store.read("chunks").count() == 500 and purge.phase() == "backed_up"
    other = Purge(store, str(tmp_path / "archive2"), ["chunks"])
    other.run(stop_after="clearing")
    store.write("chunks", spark.range(1).select("id", F.lit("new").alias("text"), F.lit(None).cast("double").alias("x")))
    with pytest.raises(Refused):
        other.run()
    assert rows(store.read("chunks")) == [(0, "new", None)]


def test_work_is_done_once(spark, tmp_path):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "bad"), (5, None), (6, "flaky"), (7, "")], "i int, content string")
    calls = tmp_path / "calls"
    calls.mkdir()

    def work(text, folder=str(calls)):
        import pathlib
        import uuid

        first = not list(pathlib.Path(folder).glob(f"{text or 'empty'}-*"))
        pathlib.Path(folder, f"{text or 'empty'}-{uuid.uuid4().hex}").write_text("")
        if text == "bad" or (text == "flaky" and first):
            raise ValueError(f"cannot read {text}")
        return text.upper()

    memo = Memo(spark, str(tmp_path / "memo"))
    n = lambda: len(list(calls.iterdir()))
    got = {r["i"]: (r["status"], r["result"], r["error"]) for r in memo.run(items, work, "v1", "2024-01-01", ["i"]).collect()}
    assert got == {1: ("done", "A", None), 2: ("done", "B", None), 3: ("done", "A", None), 4: ("failed", None, "ValueError: cannot read bad"), 5: ("done", "", None), 6: ("done", "FLAKY", None), 7: ("done", "", None)}
    assert n() == 7 and memo.spent("2024-01-01") == 5  # bad and flaky twice
    again = {r["i"]: (r["status"], r["result"], r["error"]) for r in memo.run(items, work, "v1", "2024-01-02", ["i"]).collect()}
    assert again == got and n() == 7 and memo.log.last() == 1
    memo.run(items, work, "v1", "2024-01-02", ["i"], again=True).collect()
    assert n() == 9
    memo.run(items, work, "v2", "2024-01-02", ["i"]).collect()
    assert n() == 15  # another version: all anew, bad twice


def test_budget_of_a_day(spark, tmp_path):
    memo = Memo(spark, str(tmp_path / "memo"))
    items = spark.createDataFrame([(i, f"c{i}") for i in range(10)], "i int, content string")
    states = lambda df: [r["status"] for r in df.orderBy("i").collect()]
    assert states(memo.run(items, str.upper, "v", "d1", ["i"], budget=4)) == ["done"] * 4 + ["deferred"] * 6
    assert states(memo.run(items, str.upper, "v", "d1", ["i"], budget=6)) == ["done"] * 6 + ["deferred"] * 4
    assert states(memo.run(items, str.upper, "v", "d1", ["i"], budget=6)) == ["done"] * 6 + ["deferred"] * 4
    assert states(memo.run(items, str.upper, "v", "d2", ["i"], budget=9)) == ["done"] * 10 and memo.spent("d2") == 4


def test_another_run_came_first(spark, tmp_path):
    memo, other = Memo(spark, str(tmp_path / "memo")), Memo(spark, str(tmp_path / "memo"))
    items = spark.createDataFrame([(1, "a")], "i int, content string")
    seen = memo.log.last
    memo.log.last = lambda: 0
    other.run(items, str.upper, "v", "d", ["i"])
    with pytest.raises(Conflict):
        memo.run(items.withColumn("content", F.lit("z")), str.upper, "v", "d", ["i"])
    memo.log.last = seen
    assert memo.run(items, str.upper, "v", "d", ["i"]).first()["result"] == "A"


def test_ranges(spark):
    got = {r[0]: [tuple(x) for x in r[1]] for r in spark.createDataFrame([(0,), (1,), (7,), (16,), (17,)], "n int").select("n", page_ranges(F.col("n"))).collect()}
    assert got == {0: [], 1: [(1, 1)], 7: [(i, i) for i in range(1, 8)], 16: [(i, i + 1) for i in range(1, 16, 2)], 17: [(i, min(i + 1, 17)) for i in range(1, 18, 2)]}
    parts = spark.createDataFrame([("a", 3, 4, "failed", None), ("a", 1, 2, "done", "x"), ("b", 1, 1, "failed", None), ("c", 2, 2, "done", "q"), ("c", 1, 1, "done", "p")], "k string, first int, last int, status string, result string")
    assert rows(merged(parts, "k")) == [("a", "partial", "x", ["第 3-4 页解析未完成，该范围请核对原文件。"]), ("b", "failed", "", ["第 1-1 页解析未完成，该范围请核对原文件。"]), ("c", "ready", "p\nq", [])]
