import math
import random

import numpy as np
import pytest

from lodestore.llm import registry, topk
from tests.conftest import rows
from tests.llm.conftest import same

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(table, k=5, every=50, scale=256):
    kept = [(i, [math.floor(scale * c) for c in x]) for i, x, _ in table if x is not None and all(c is not None and math.isfinite(c) for c in x)]
    out = []
    for a, (i, q) in enumerate(kept):
        if i is not None and i % every == 0:
            scored = sorted((-sum(s * t for s, t in zip(q, x, strict=False)), -math.inf if j is None else j, j) for b, (j, x) in enumerate(kept) if b != a)
            out += [(i, r, j, max(-(1 << 63), min(-score, (1 << 63) - 1))) for r, (score, _, j) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def drawn(seed, n=300, width=8):
    rng = random.Random(seed)
    table = [(i, [rng.gauss(0, 0.3) for _ in range(width)], 0) for i in range(n)]
    table += [(1000 + i, [0.5] * width, 1) for i in range(60)] + [(50, table[50][1], 2), (50, table[50][1], 2), (100, [0.1] * width, 2)]
    table += [(None, [0.4] * width, 3), (150, None, 3), (200, [None] * width, 3), (2050, [float("nan")] * width, 3), (2100, [float("inf")] * width, 3), (2150, [0.2] * (width - 3), 3), (2200, [], 3), (2250, [0.0] * width, 3), (-50, [0.3] * (width + 2), 3)]
    return table


@pytest.mark.parametrize("lane", [1 << 16, 64])
def test_against_brute_force(spark, monkeypatch, lane):
    monkeypatch.setattr(topk, "LANE", lane)
    monkeypatch.setattr(topk, "BAND", max(4, lane // 16))
    monkeypatch.setattr(topk, "SMALL", lane)
    table = drawn(1)
    got = sorted((tuple(r) for r in topk.search(spark.createDataFrame(table, SCHEMA)).collect()), key=str)
    assert got == brute(table)


def test_sums_beyond_doubles_and_longs(spark):
    table = [(0, [1e12, 3.0, 1.0], 0), (1, [1e12, 3.0, -1.0], 0), (2, [1e12, 3.0, 2.0], 0), (50, [1e4, 1e4, 0.0], 0), (51, [-1e4, 1e3, 1.0], 0), (100, [-1e12, 1.0, 0.0], 0)]
    got = sorted((tuple(r) for r in topk.search(spark.createDataFrame(table, SCHEMA)).collect()), key=str)
    exact, clipped = [r for r in brute(table) if r[0] == 50], {r[:1] + r[3:] for r in brute(table)}
    assert [r for r in got if r[0] == 50] == exact and {r[:1] + r[3:] for r in got} == clipped


def test_few_and_no_rows(spark):
    one = spark.createDataFrame([(0, [1.0], 0), (1, [2.0], 0)], SCHEMA)
    assert [tuple(r) for r in topk.search(one).collect()] == [(0, 1, 1, 131072)]
    assert topk.search(one.limit(0)).count() == 0 and topk.search(one.filter("vec_id = 1")).count() == 0
    assert topk.search(spark.createDataFrame([(0, None, 0)], SCHEMA)).count() == 0


def test_other_columns_do_not_matter(spark):
    table = spark.createDataFrame(drawn(2, 60), SCHEMA)
    clash = table.selectExpr("*", "'c' AS row", "'c' AS id", "'c' AS x", "'c' AS lane", "'c' AS score", "'c' AS query", "'c' AS rank")
    assert same(topk.search(table), topk.search(clash))


def test_most_rows_stay_unread_when_few_can_win():
    rng = np.random.default_rng(3)
    values = np.floor(256 * rng.normal(0, 0.02, (5000, 4)))
    values[:10] += 2000
    lane, read = topk.Lane(np.arange(5000), np.arange(5000), values), []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            read.append(out.size // 4)
            return out

    lane.values = values.view(Counted)
    at, scores = lane.best(np.array([1.0, 2.0, 1.0, 3.0]), 0, 5, None)
    every = sorted(((-float(v @ [1, 2, 1, 3]), i) for i, v in enumerate(values) if i), key=lambda t: t)[:5]
    assert list(zip((-np.asarray(scores)).tolist(), at.tolist(), strict=True)) == every and sum(read) < 500


def test_query_against_sql(spark, duck, sf):
    mine = registry.op11_exact_topk(spark, sf)
    other = duck.execute(registry.oracle_sql()["op11_exact_topk"])
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows([d[0] for d in other.description], other.fetchall())
