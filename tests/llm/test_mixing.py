from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lodestore.llm import mixing
from tests.conftest import rows
from tests.llm.conftest import same


def test_same_as_sql(docs, duck):
    mine = mixing.mix(docs, bins=16).select("doc_id", "size", "source_size", "target", "taken")
    other = duck.execute(mixing.SQL.format(docs="documents"))
    assert rows(mine.columns, map(tuple, mine.collect())) == rows([d[0] for d in other.description], other.fetchall())


@pytest.mark.parametrize("bins", [1, 7, 1024])
def test_laws(docs, bins):
    found = mixing.mix(docs, bins=bins).collect()
    per = defaultdict(list)
    for r in found:
        assert r["taken"] <= 2 * r["size"]
        per[r["source"]].append(r)
    total = sum(r["size"] for r in found)
    assert abs(sum(p[0]["target"] for p in per.values()) - 1.5 * total) < 1e-6 * total
    for p in per.values():
        assert p[0]["target"] <= 2 * p[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in p) - p[0]["target"]) <= max(r["size"] for r in p) / 2 + 1e-6


def test_rows_are_repeated_as_often_as_taken(docs):
    wanted = {(r["doc_id"], r["epochs"]) for r in mixing.mix(docs).collect() if r["epochs"]}
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert {(r["doc_id"], r["count"]) for r in got.groupBy("doc_id").count().collect()} == wanted


def test_good_documents_are_drawn_first(spark):
    base = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "plain words here").otherwise("b$d wo$ds h$re").alias("text"), F.when(F.col("id") % 8 < 6, "a").otherwise("b").alias("source"))
    extra = mixing.mix(base).filter("source = 'a'").groupBy(F.col("doc_id") % 2).agg(F.avg("epochs").alias("mean")).collect()
    means = {r[0]: r["mean"] for r in extra}
    assert means[0] > means[1]


def test_awkward(awkward, clashing, empty):
    found = mixing.mix(awkward).collect()
    assert len(found) == awkward.count() and all(r["taken"] == r["epochs"] * r["size"] <= 2 * r["size"] for r in found)
    assert same(mixing.mix(awkward), mixing.mix(clashing))
    assert same(mixing.mixed(awkward), mixing.mixed(clashing).select(awkward.columns))
    assert mixing.mix(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_only_empty_texts(spark):
    blank = spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")
    assert {(r["size"], r["target"], r["taken"]) for r in mixing.mix(blank).collect()} == {(0, 0.0, 0)}
