"""The index of words gives what a scan of all texts gives, whatever happened to the chunks since it was built."""

import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestore.functions.text import segmented
from lodestore.operators.postings import Postings, bucket
from lodestore.operators.retrieval import lexical, lexical_of
from lodestore.sources.commits import CommitLog, Conflict, drop_unnamed, read_active, write_generation

TEXTS = {(1, 0): "alpha beta alpha", (1, 1): "beta AX-210 gamma", (2, 0): "", (2, 1): None, (3, 0): "delta alpha ax-210 ax", (4, 0): "the the the the"}


def chunks(spark, texts):
    return spark.createDataFrame([(d, o, t) for (d, o), t in texts.items()], "doc_id long, ordinal int, text string")


def plain(spark, texts, words):
    found = chunks(spark, texts).select("doc_id", "ordinal", segmented(F.coalesce("text", F.lit(""))).alias("t")).collect()
    counts = {(r["doc_id"], r["ordinal"]): sum(Counter(r["t"])[w] for w in words) for r in found}
    return {k: round(0.1 * n, 9) for k, n in counts.items() if n}


def asked(index, words):
    return {(r["doc_id"], r["ordinal"]): round(r["value"], 9) for r in index.ranked(words).collect()}


def test_updates_and_compaction(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "i"), buckets=8, spread=2)
    assert asked(index, ["alpha"]) == {} and index.indexed().count() == 0
    index.build(chunks(spark, TEXTS))
    queries = (["alpha"], ["ax-210", "ax"], ["the", "beta"], ["nothing"], ["alpha", "beta", "gamma", "delta", "the", "ax-210"])
    check = lambda texts: [asked(index, q) for q in queries] == [plain(spark, texts, q) for q in queries]
    assert check(TEXTS) and index.update(chunks(spark, TEXTS)) == {"written": 0, "dropped": 0} and index.log.last() == 1
    changed = {k: t for k, t in TEXTS.items() if k != (4, 0)} | {(1, 0): "beta beta", (2, 1): "alpha", (9, 3): "the gamma"}
    assert index.update(chunks(spark, changed)) == {"written": 3, "dropped": 1} and check(changed)
    back = changed | {(1, 0): TEXTS[1, 0], (4, 0): "the"}
    assert index.update(chunks(spark, back)) == {"written": 2, "dropped": 0} and check(back)
    index.compact()
    assert check(back) and len(index.log.entry()["segments"]) == 1 and {tuple(r)[:2] for r in index.indexed().collect()} == set(back)
    again = Postings(spark, str(tmp_path / "i"), buckets=99)
    assert again.buckets == 8 and asked(again, ["the"]) == plain(spark, back, ["the"])
    assert len(drop_unnamed(spark, str(tmp_path / "i"), keep=1)) == 8 and check(back)
    assert index.update(chunks(spark, {})) == {"written": 0, "dropped": len(back)} and check({})


def test_only_the_buckets_of_the_words_are_read(spark, tmp_path):
    index = Postings(spark, str(tmp_path / "i"), buckets=16, spread=1)
    index.build(chunks(spark, {(i, 0): f"w{i} w{i + 1} common" for i in range(200)}))
    found = index.postings(["w7", "w9"])
    wanted = {f"bucket={bucket(w, 16)}" for w in ("w7", "w9")}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket#" in plan[plan.index("PartitionFilters") :] and "In(word, [w7,w9])" in plan and "text" not in plan
    paths = [r[0] for r in index._table(index.log.entry()["segments"][0]["postings"], "postings").filter(F.col("bucket").isin([bucket(w, 16) for w in ("w7", "w9")])).select("_metadata.file_path").distinct().collect()]
    assert {p.split("/")[-2] for p in paths} == wanted
    assert {(r["word"], r["doc_id"]) for r in found.collect()} == {("w7", 7), ("w7", 6), ("w9", 9), ("w9", 8)}


def test_ranks_are_those_of_a_scan(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text"))
    index = Postings(spark, str(tmp_path / "i"))
    index.build(lines)
    some = docs.filter("doc_id % 3 > 0")
    scan = lexical(lines.join(some.select("doc_id"), "doc_id", "left_semi").withColumn("chunk_id", F.struct("doc_id", "ordinal")), ["the", "reor"], pool=50)
    got = lexical_of(index, ["the", "reor"], some, pool=50)
    assert sorted((r["doc_id"], r["ordinal"], r["rank"]) for r in got.collect()) == sorted((*r["chunk_id"], r["rank"]) for r in scan.collect())


def test_of_two_updates_one_wins(spark, tmp_path):
    index, other = (Postings(spark, str(tmp_path / "i"), buckets=4) for _ in range(2))
    index.build(chunks(spark, TEXTS))
    seen = other.log.last()
    index.update(chunks(spark, TEXTS | {(5, 0): "new"}))
    with pytest.raises(Conflict):
        other.log.append({"buckets": 4, "segments": []}, seen)
    assert asked(other, ["new"]) == {(5, 0): 0.1}


def test_two_writers_of_a_generation(spark, tmp_path):
    folder = str(tmp_path / "g")
    assert write_generation(spark.range(10), folder, 1) == 1
    results, start = [], threading.Barrier(6)

    def write(k):
        data = spark.range(100 * k, 100 * k + 50)
        start.wait()
        try:
            results.append((k, write_generation(data, folder, 2, expected=1)))
        except Conflict:
            results.append((k, None))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(1, 7)]
    for t in threads:
        t.start()
    seen = set()
    while any(t.is_alive() for t in threads):
        rows = sorted(r[0] for r in read_active(spark, folder).collect())
        seen.add((len(rows), rows[0] // 100))
    for t in threads:
        t.join()
    (winner,) = [k for k, n in results if n == 2]
    assert sorted(r[0] for r in read_active(spark, folder).collect()) == list(range(100 * winner, 100 * winner + 50))
    assert seen <= {(10, 0), (50, winner)} and sum(n is None for _, n in results) == 5
    assert len([n for n in CommitLog(spark, folder).files.names("") if n.startswith("generation-2")]) == 1
    assert not [n for n in CommitLog(spark, folder).files.names("_commits") if n.startswith(".") and not n.endswith(".crc")]


def test_unfenced_writers_all_commit(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "l"))
    threads = [threading.Thread(target=lambda: log.update(lambda s: {"n": (s or {"n": 0})["n"] + 1}, tries=50)) for _ in range(5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert log.last() == 5 and log.entry() == {"n": 5}


def test_texts_are_cut_once(spark, tmp_path):
    times = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def words(text):
        times.add(1)
        return text.split()

    index = Postings(spark, str(tmp_path / "once"), buckets=4, tokens=words)
    index.build(spark.createDataFrame([(i, 0, f"a b{i % 3} a") for i in range(20)], "doc_id long, ordinal int, text string"))
    assert times.value == 20
    assert sorted(map(tuple, index.postings(["a", "b1"]).filter("doc_id < 2").collect())) == [("a", 0, 0, 2), ("a", 1, 0, 2), ("b1", 1, 0, 1)]
    assert {r["n"] for r in index.indexed().collect()} == {3}
