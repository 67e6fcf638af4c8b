"""Trees of digests: equal for equal tables in any order, and leading to the rows that differ."""

import hashlib
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestore.operators import merkle as mk

SCHEMA = "k long, name string, amount double"


def drawn(seed, n=400):
    rng = random.Random(seed)
    return [(rng.randint(0, 300), rng.choice(["a", "b", None, "é\n"]), rng.choice([1.5, None, -2.0])) for _ in range(n)] + [(1, "same", 0.5)] * 200


def plain_leaves(rows, depth):
    """JSON of a row with its nulls, keys sorted; rows by digest, each with how often it stands."""
    counts = Counter(hashlib.sha256(json.dumps({"amount": a, "k": k, "name": n}, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for k, n, a in rows)
    ranges = {}
    for row, n in sorted(counts.items()):
        ranges.setdefault(row[:depth], []).append((row, n))
    return {p: (sum(n for _, n in own), hashlib.sha256("\n".join(f"{r}:{n}" for r, n in own).encode()).hexdigest()) for p, own in ranges.items()}


@pytest.mark.parametrize("depth", [0, 1, 2])
def test_tree(spark, depth):
    rows = drawn(1)
    df = spark.createDataFrame(rows, SCHEMA)
    nodes = {(r["depth"], r["prefix"]): (r["n_rows"], r["digest"]) for r in mk.tree(mk.leaves(df, depth), depth).collect()}
    level = plain_leaves(rows, depth)
    assert {p: v for (d, p), v in nodes.items() if d == depth} == level
    for d in range(depth - 1, -1, -1):
        above = {}
        for p in sorted(level):
            above.setdefault(p[:d], []).append(p)
        level = {q: (sum(level[p][0] for p in own), hashlib.sha256("\n".join(f"{p}:{level[p][1]}" for p in own).encode()).hexdigest()) for q, own in above.items()}
        assert {p: v for (e, p), v in nodes.items() if e == d} == level
    shuffled = spark.createDataFrame(random.Random(2).sample(rows, len(rows)), SCHEMA).repartition(7)
    assert mk.root(mk.tree(mk.leaves(shuffled, depth), depth)) == nodes[0, ""] and nodes[0, ""][0] == len(rows)


def test_changes(spark):
    rows = drawn(3)
    other = [r for r in rows if r != rows[5]] + [(999, "new", 1.0), rows[7], rows[7]]
    a, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA)
    want = Counter(rows)
    want.subtract(other)
    expected = sorted((("before" if n > 0 else "after"), abs(n), *r) for r, n in want.items() if n)
    for depth in (0, 2):
        got = [tuple(r) for r in mk.changes(a, b, depth).select("side", "times", "k", "name", "amount").collect()]
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert mk.changes(a, a.repartition(3), 2).count() == 0
    none = a.limit(0)
    assert mk.root(mk.tree(mk.leaves(none, 1), 1)) == (0, "") and mk.changes(a, none, 1).agg(F.sum("times")).first()[0] == len(rows)


def test_only_leaves_that_differ_are_named(spark):
    rows = [(i, "x", 1.0) for i in range(3000)]
    a = spark.createDataFrame(rows, SCHEMA)
    b = spark.createDataFrame([*rows[:-1], (2999, "y", 1.0)], SCHEMA)
    found = {r[0] for r in mk.differing(mk.tree(mk.leaves(a, 2), 2), mk.tree(mk.leaves(b, 2), 2), 2).collect()}
    one, two = plain_leaves(rows, 2), plain_leaves([*rows[:-1], (2999, "y", 1.0)], 2)
    assert found == {p for p in one | two if one.get(p) != two.get(p)} and 1 <= len(found) <= 2


def test_depth():
    assert [mk.depth_for(n) for n in (0, 4096, 4097, 65536, 65537, 10**9)] == [0, 0, 1, 1, 2, 5]


def test_changes_sort_no_rows(spark):
    """Both tables meet in one hashed sum: rows are neither sorted by digest nor joined with those of the other table."""
    rows = drawn(4)
    a, b = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([*rows[1:], (7, "ü", -0.0), (7, "ü", 0.0)], SCHEMA)
    plan = mk.changes(a.drop("amount"), b.drop("amount"), 1)._jdf.queryExecution()
    assert "SortAggregate" not in plan.executedPlan().toString() and "FullOuter" not in plan.optimizedPlan().toString()
    found = mk.changes(a, b, 1).filter("k = 7 and side = 'after' and name = 'ü'")
    assert sorted(map(str, found.select("amount").collect())) == ["Row(amount=-0.0)", "Row(amount=0.0)"]
