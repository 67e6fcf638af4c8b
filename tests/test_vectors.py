"""The pruned search finds what a full scan finds, and reads less where vectors lie in clusters."""

import math
import random

import pytest

from lodestore.operators.vectors import VectorIndex

SCHEMA = "doc_id long, ordinal int, embedding array<float>"


def drawn(seed, clusters=20, each=60, width=16, spread=0.12):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(clusters)]
    rows = [(i * each + k, 0, [c + rng.gauss(0, spread) for c in centres[i]]) for i in range(clusters) for k in range(each)]
    return rows + [(90_000, 0, None), (90_001, 0, [0.0] * width), (90_002, 1, [float("nan")] * width), (90_003, 0, rows[0][2]), (90_003, 1, rows[0][2])]


def plain(rows, query, near):
    out = []
    for d, o, x in rows:
        if x is not None and any(x) and all(map(math.isfinite, x)):
            distance = 1 - sum(a * b for a, b in zip(x, query, strict=True)) / math.sqrt(sum(a * a for a in x) * sum(b * b for b in query))
            if distance < near:
                out.append((d, o, pytest.approx(distance, abs=1e-8)))
    return sorted(out, key=lambda r: r[:2])


def asked(index, query, near):
    return sorted(((r["doc_id"], r["ordinal"], r["distance"]) for r in index.near(query, near).collect()), key=lambda r: r[:2])


def test_against_a_full_scan(spark, tmp_path):
    frame = spark.createDataFrame(drawn(1), SCHEMA)
    rows = [(r["doc_id"], r["ordinal"], None if r["embedding"] is None else list(r["embedding"])) for r in frame.collect()]
    index = VectorIndex(spark, str(tmp_path / "v"))
    index.build(frame, clusters=24, sample=500)
    for at, near in ((0, 0.05), (70, 0.2), (500, 0.65), (3, 2.1)):
        assert asked(index, rows[at][2], near) == plain(rows, rows[at][2], near)
    few = index.clusters_near(rows[0][2], 0.05)[0]
    assert 1 <= len(few) <= 4
    plan = index.near(rows[0][2], 0.05)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cluster#" in plan[plan.index("PartitionFilters") :]
    more = spark.createDataFrame([(70_000 + i, 0, [10.0 * (i == j) - 3.0 for j in range(16)]) for i in range(16)], SCHEMA)
    index.add(more)
    both = rows + [(r["doc_id"], r["ordinal"], list(r["embedding"])) for r in more.collect()]
    assert asked(index, both[-1][2], 0.3) == plain(both, both[-1][2], 0.3) and asked(index, rows[0][2], 0.65) == plain(both, rows[0][2], 0.65)


@pytest.mark.parametrize("rows", [[], [(1, 0, None)]])
def test_nothing_to_find(spark, tmp_path, rows):
    index = VectorIndex(spark, str(tmp_path / "v"))
    assert index.near([1.0, 0.0], 0.65).count() == 0
    index.build(spark.createDataFrame(rows, SCHEMA))
    assert index.near([1.0, 0.0], 0.65).count() == 0
