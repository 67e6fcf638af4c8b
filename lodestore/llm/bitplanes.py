"""Centroid clustering of integer vectors by bit planes.

A vector of 64 integers is kept as bit planes of two's complement: plane j is one 64-bit word with bit j of every
component. Inner products are weighted popcounts of the AND of two planes, so squared distances are exact; sums of
components come from the planes as well. Each round is one pass over the planes, from which a row for each batch,
cluster and component comes back; the driver sees as many numbers as the centroids have components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import materialize, settled

WIDTH = 64
#: Most planes with which every intermediate number of a distance fits in 64 bits; wider ones take Python integers.
NARROW = 28
#: Components beyond are set to these ends, and so are distances and their sums.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def whole(scaled: np.ndarray) -> np.ndarray:
    """Floors of doubles as 64-bit integers, set to the ends of their range where they leave it."""
    floor = np.floor(scaled)
    out = np.clip(floor, -(2.0**63), 2.0**63 - 1024).astype(np.int64)
    out[floor >= 2.0**63] = MOST
    return out


def pack(components: np.ndarray) -> np.ndarray:
    """Planes of rows of ``WIDTH`` integers, least bit first, the sign last: as many as the largest one needs."""
    most = int(np.maximum(components, ~components).max(initial=0))
    planes = np.empty((len(components), most.bit_length() + 1), np.uint64)
    for j in range(planes.shape[1]):
        bits = ((components >> np.int64(min(j, 63))) & 1).astype(np.uint8)
        planes[:, j] = np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]
    return planes


def weights(n: int) -> list[int]:
    return [1 << j for j in range(n - 1)] + [-(1 << (n - 1))]


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows behind the planes ``a`` with all behind ``b``."""
    wide = max(a.shape[1], b.shape[1]) > NARROW
    total = np.zeros((len(a), len(b)), object if wide else np.int64)
    for i, w in enumerate(weights(a.shape[1])):
        for j, v in enumerate(weights(b.shape[1])):
            ones = np.bitwise_count(a[:, i, None] & b[None, :, j])
            total += ones.astype(total.dtype) * (w * v)
    return total


def norms(a: np.ndarray) -> np.ndarray:
    """Squared lengths of the rows behind planes."""
    wide = a.shape[1] > NARROW
    total = np.zeros(len(a), object if wide else np.int64)
    of = weights(a.shape[1])
    for i, w in enumerate(of):
        for j in range(i + 1):
            ones = np.bitwise_count(a[:, i] & a[:, j])
            total += ones.astype(total.dtype) * (w * of[j] * (1 if i == j else 2))
    return total


def nearest(planes: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (of equal ones the smallest) and the squared distance to it."""
    distance = norms(planes)[:, None] - 2 * dots(planes, centroids) + norms(centroids)[None, :]
    cluster = distance.argmin(axis=1)
    return cluster, distance[np.arange(len(planes)), cluster]


def summed(planes: np.ndarray, cluster: np.ndarray, k: int) -> list[list[int]]:
    """Sums of the components, by cluster."""
    member = np.zeros((k, len(planes)))
    member[cluster, np.arange(len(planes))] = 1
    total = np.zeros((k, WIDTH), object)
    for j, w in enumerate(weights(planes.shape[1])):
        bits = np.unpackbits(np.ascontiguousarray(planes[:, j]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += (member @ bits).astype(np.int64).astype(object) * w
    return total.tolist()


def planes_of(column: pa.Array) -> np.ndarray:
    """Planes of a list column; where a row has fewer, its sign plane is repeated."""
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
    n = np.diff(offsets)
    at = np.minimum(np.arange(n.max(initial=1))[None, :], n[:, None] - 1)
    return flat[offsets[:-1, None] + at].view(np.uint64)


def usable(vectors: DataFrame, id_col: str, vector_col: str, length: int | None = None) -> DataFrame:
    """``id`` and ``x`` (doubles) of the vectors that are not null and hold neither null nor non-finite components."""
    x = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.filter(F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (F.lit(True) if length is None else F.size("x") == length))


def packed(vectors: DataFrame, scale: int) -> DataFrame:
    """``id`` and ``planes`` of usable vectors of ``WIDTH`` components, each floor(scale * x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            with np.errstate(over="ignore"):
                planes = pack(whole(x * scale))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * planes.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, planes.view(np.int64).ravel())], names=["id", "planes"])

    return vectors.mapInArrow(run, "id long, planes array<long>")


def _clipped(values: np.ndarray) -> pa.Array:
    return pa.array(values if values.dtype == np.int64 else np.array([min(int(v), MOST) for v in values], np.int64), pa.int64())


def _totals(table: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, int, list[int]]]:
    """By non-empty cluster: its rows, the sum of their squared distances (at ``MOST`` or above: unknown), the sums of their
    components."""
    means = pack(np.array(centroids, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            planes = planes_of(batch.column(1))
            cluster, distance = nearest(planes, means)
            sums = summed(planes, cluster, len(means))
            for c in np.unique(cluster).tolist():
                own = cluster == c
                cells = [int(own.sum()), min(sum(map(int, distance[own])), MOST), *sums[c]]
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(cells), pa.int32()), pa.array(range(len(cells)), pa.int32()), pa.array([Decimal(v) for v in cells], pa.decimal128(38, 0))], names=["cluster", "cell", "value"])

    cells = table.mapInArrow(run, "cluster int, cell int, value decimal(38,0)").groupBy("cluster", "cell").agg(F.sum("value").alias("value"))
    found: dict[int, dict[int, int]] = {}
    for r in cells.collect():
        found.setdefault(r["cluster"], {})[r["cell"]] = int(r["value"])
    return {c: (v[0], v[1], [v[2 + i] for i in range(WIDTH)]) for c, v in found.items()}


@settled
def clusters(vectors: DataFrame, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Lloyd's rounds in exact integers. Returns for each vector ``vec_id``, ``cluster``, ``distance`` (squared),
    ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    Vectors that are null, hold null or non-finite components, or have not exactly 64 of them take no part. Centroids
    start as the ``k`` vectors with the smallest SHA-256 of ``seed``, a colon and the id (a null id: nothing); of rows
    that repeat an id the one whose components come first. With fewer vectors there are fewer centroids, with none no
    rows. Repeated rows are vectors like others. Components that leave 64 bits, distances and their sums are set to the
    end of that range. An empty cluster keeps its centroid. Other columns are not read.
    """
    spark = vectors.sparkSession
    own = usable(vectors, id_col, vector_col, WIDTH)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = own.orderBy(key, "x").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    with np.errstate(over="ignore"):
        centroids = whole(np.array([r["x"] for r in first]) * scale).tolist()
    table = materialize(packed(own, scale), "bit-planes")
    for _ in range(rounds):
        for c, (n, _, sums) in _totals(table, centroids).items():
            centroids[c] = [v // n for v in sums]
    last = _totals(table, centroids)
    means = pack(np.array(centroids, np.int64))
    within = [min(last[c][1], MOST) if c in last else 0 for c in range(len(centroids))]
    inertia = min(sum(v[1] for v in last.values()), MOST)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, distance = nearest(planes_of(batch.column(1)), means)
            columns = [batch.column(0), pa.array(cluster.astype(np.int32)), _clipped(distance), pa.array(within, pa.int64()).take(pa.array(cluster)), pa.array([inertia] * len(cluster), pa.int64()), pa.array(digests).take(pa.array(cluster))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return table.mapInArrow(run, schema)


def oracle(k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3") -> str:
    """DuckDB SQL for ``clusters``: a common table expression for each round."""
    distance = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    parts = [
        f"""v AS MATERIALIZED (
  SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS HUGEINT)) AS x, embedding AS raw FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
)""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), '')), raw) - 1 AS c, x FROM v QUALIFY c < {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(f"a{r} AS MATERIALIZED (SELECT v.nth, arg_min(c.c, ({distance}, c.c)) AS c, min({distance}) AS distance FROM v CROSS JOIN c{r} c GROUP BY v.nth)")
        if r < rounds:
            parts.append(
                f"""m{r} AS (SELECT a.c, i, CAST(sum(v.x[i]) AS HUGEINT) AS total, count(*) AS n FROM a{r} a JOIN v USING (nth) CROSS JOIN (SELECT unnest(range(1, 65)) AS i) GROUP BY a.c, i)"""
            )
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN
  (SELECT c, list((total - ((total % n) + n) % n) // n ORDER BY i) AS x FROM m{r} GROUP BY c) m USING (c))"""
            )
    return f"""WITH {', '.join(parts)}
SELECT v.vec_id, CAST(a.c AS INTEGER) AS cluster, CAST(a.distance AS BIGINT) AS distance, CAST(sum(a.distance) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(list_transform(c.x, lambda e: CAST(e AS VARCHAR)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (nth) JOIN c{rounds} c ON c.c = a.c"""
