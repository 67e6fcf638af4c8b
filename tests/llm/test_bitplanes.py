import hashlib
import math
import random

import numpy as np

from lodestore.llm import bitplanes, registry
from tests.conftest import rows
from tests.llm.conftest import same

SCHEMA = "vec_id long, embedding array<double>, label int"
COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def brute(table, k=8, rounds=10):
    kept = [(i, [math.floor(1024 * c) for c in x]) for i, x, _ in table if x is not None and len(x) == 64 and all(c is not None and math.isfinite(c) for c in x)]
    key = lambda v: (hashlib.sha256(f"3:{'' if v[0] is None else v[0]}".encode()).hexdigest(), v[1])
    centroids = [x for _, x in sorted(kept, key=key)[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(near(x)[1], []).append(x)
        for j, own in members.items():
            centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [near(x) for _, x in kept]
    most = (1 << 63) - 1
    within = {j: min(most, sum(d for d, c in last if c == j)) for j in range(len(centroids))}
    shown = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, min(d, most), within[j], min(most, sum(e for e, _ in last)), shown[j]) for (i, _), (d, j) in zip(kept, last, strict=True)), key=str)


def drawn(seed, n=200):
    rng = random.Random(seed)
    table = [(i, [rng.gauss(i % 3, 0.3) for _ in range(64)], 0) for i in range(n)]
    table += [(1000 + i, [0.5] * 64, 1) for i in range(70)] + [(7, table[7][1], 0), (7, [0.25] * 64, 0), (None, [1.0] * 64, 0)]
    return [*table, (300, None, 0), (301, [], 0), (302, [1.0] * 63, 0), (303, [None] * 64, 0), (304, [float("nan")] * 64, 0), (305, [float("-inf")] * 64, 0), (306, [1.0] * 65, 0)]


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_popcounts_give_inner_products():
    rng = np.random.default_rng(1)
    for most in (1, 2, 1000, 1 << 26, 1 << 40, (1 << 63) - 1):
        a, b = rng.integers(-most, most, (20, 64), endpoint=True), rng.integers(-3, 900, (5, 64))
        exact = a.astype(object) @ b.T.astype(object)
        assert (bitplanes.dots(bitplanes.pack(a), bitplanes.pack(b)) == exact).all()
        assert bitplanes.norms(bitplanes.pack(a)).tolist() == (a.astype(object) ** 2).sum(axis=1).tolist()
        assert np.array(bitplanes.summed(bitplanes.pack(a), np.arange(20) % 3, 3), object).tolist() == [a[c::3].astype(object).sum(axis=0).tolist() for c in range(3)]


def test_against_brute_force(spark):
    for seed, n in ((1, 200), (2, 3)):
        table = drawn(seed, 200)[:n]
        assert found(bitplanes.clusters(spark.createDataFrame(table, SCHEMA))) == brute(table)
    table = drawn(3)
    assert found(bitplanes.clusters(spark.createDataFrame(table, SCHEMA).repartition(5))) == brute(table)


def test_wide_components(spark):
    table = [(i, [(-1.0) ** i * 10.0 ** (i % 9) + j for j in range(64)], 0) for i in range(30)]
    assert found(bitplanes.clusters(spark.createDataFrame(table, SCHEMA))) == brute(table)
    far = spark.createDataFrame([(1, [1e300] * 64, 0), (2, [-1e300] * 64, 0), (3, [0.0] * 64, 0)], SCHEMA)
    got = {r["vec_id"]: r for r in bitplanes.clusters(far, k=1, rounds=1).collect()}
    assert [got[i]["distance"] for i in (1, 2, 3)] == [(1 << 63) - 1] * 2 + [64] and got[3]["inertia"] == (1 << 63) - 1


def test_empty_and_other_columns(spark):
    table = spark.createDataFrame(drawn(4, 20), SCHEMA)
    assert bitplanes.clusters(table.limit(0)).collect() == [] and bitplanes.clusters(table.filter("vec_id >= 300 AND vec_id < 400")).collect() == []
    clash = table.selectExpr("*", "'c' AS id", "'c' AS x", "'c' AS planes", "'c' AS cluster", "'c' AS inertia")
    assert same(bitplanes.clusters(table), bitplanes.clusters(clash))


def test_query_against_sql(spark, duck, sf):
    mine = registry.op13_bitplane_clusters(spark, sf)
    other = duck.execute(registry.oracle_sql()["op13_bitplane_clusters"])
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows([d[0] for d in other.description], other.fetchall())
