"""Exact vector search that skips what cannot be near (VEC01).

Vectors are assigned to the nearest of some centres, fitted on a bounded sample, and kept in a table partitioned by it;
of each cluster the greatest angle to its centre is known. Angles obey the triangle inequality, so a cluster whose
centre is further from the query than this angle and the search's own together holds nothing near, and is not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.sources.commits import CommitLog, written

#: Angles are compared with this much to spare, for rounding.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def fit_centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit vectors; a centre is a unit vector, and one that loses all its vectors stays."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        for c in np.unique(own):
            total = sample[own == c].sum(axis=0)
            length = np.linalg.norm(total)
            if length > 0:
                centres[c] = total / length
    return centres


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


class VectorIndex:
    """The index in ``folder``; rows are (``doc_id``, ``ordinal``, ``embedding``)."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, CommitLog(spark, folder)

    def _assigned(self, vectors: DataFrame, centres: np.ndarray) -> tuple[str, dict[str, float]]:
        """Write the vectors by cluster; the folder, and the greatest angle in each cluster that has any."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(2))
                angles = _angles(x / np.linalg.norm(x, axis=1, keepdims=True), centres) if len(x) else np.zeros((0, len(centres)))
                own = angles.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angles[np.arange(len(x)), own]), pa.array(own.astype(np.int32))], names=["doc_id", "ordinal", "embedding", "angle", "cluster"])

        found = vectors.mapInArrow(run, "doc_id long, ordinal int, embedding array<double>, angle double, cluster int")
        name = written(self.log, found.repartition("cluster", F.pmod(F.xxhash64("doc_id"), F.lit(4))), "vectors", "cluster")
        radii = self._table(name).groupBy("cluster").agg(F.max("angle").alias("radius")).collect()
        return name, {str(r["cluster"]): r["radius"] for r in radii}

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema("doc_id long, ordinal int, embedding array<double>, angle double, cluster int").parquet(self.log.files.at(name))

    @staticmethod
    def _usable(vectors: DataFrame) -> DataFrame:
        """Without those that have no direction: null, empty, all zero, or with null or non-finite components."""
        x = vectors.select(F.col("doc_id").cast("long"), F.col("ordinal").cast("int"), F.col("embedding").cast("array<double>").alias("embedding"))
        finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        return x.filter(F.col("embedding").isNotNull()).filter(finite & F.exists("embedding", lambda v: v != 0))

    def build(self, vectors: DataFrame, clusters: int = 64, sample: int = 20_000) -> None:
        """The index of all vectors. Centres are fitted on at most ``sample`` of them, drawn by a hash of their key."""
        seen, own = self.log.last(), self._usable(vectors)
        drawn = own.orderBy(F.xxhash64("doc_id", "ordinal"), "doc_id", "ordinal").limit(sample).select("embedding").toArrow()
        x = _matrix(drawn.column(0))
        centres = fit_centres(x / np.linalg.norm(x, axis=1, keepdims=True), clusters) if len(x) else np.zeros((0, 0))
        segments = []
        if len(x):
            name, radii = self._assigned(own, centres)
            segments = [{"name": name, "radii": radii}]
        self.log.append({"centres": centres.tolist(), "segments": segments}, seen)

    def add(self, vectors: DataFrame) -> None:
        """More vectors, of other keys, by the centres there are."""
        seen = self.log.last()
        entry = self.log.entry(seen)
        name, radii = self._assigned(self._usable(vectors), np.array(entry["centres"]))
        self.log.append(entry | {"segments": [*entry["segments"], {"name": name, "radii": radii}]}, seen)

    def clusters_near(self, query: list[float], near: float) -> list[list[int]]:
        """Of each segment the clusters that can hold a vector of a cosine distance below ``near``."""
        entry, q = self.log.entry(), np.array(query, float)
        if not entry or not entry["segments"] or not np.linalg.norm(q) > 0:
            return [[] for _ in (entry or {"segments": []})["segments"]]
        away = _angles((q / np.linalg.norm(q))[None, :], np.array(entry["centres"]))[0]
        reach = math.acos(max(-1.0, min(1.0, 1 - near))) + SLACK
        return [sorted(int(c) for c, r in s["radii"].items() if away[int(c)] - r <= reach) for s in entry["segments"]]

    def near(self, query: list[float], near: float) -> DataFrame:
        """``doc_id``, ``ordinal``, ``distance`` (cosine, to nine places) of the vectors nearer than ``near``."""
        q = np.array(query, float)
        length = float(np.linalg.norm(q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(2))
                if len(x):
                    distance = np.round(1 - (x @ q) / (np.linalg.norm(x, axis=1) * length), 9)
                    hit = pa.array(distance < near)
                    yield pa.RecordBatch.from_arrays([c.filter(hit) for c in (batch.column(0), batch.column(1), pa.array(distance))], names=["doc_id", "ordinal", "distance"])

        schema = "doc_id long, ordinal int, distance double"
        parts = [(s, c) for s, c in zip((self.log.entry() or {"segments": []})["segments"], self.clusters_near(query, near), strict=True) if c]
        read = [self._table(s["name"]).filter(F.col("cluster").isin(c)).select("doc_id", "ordinal", "embedding") for s, c in parts]
        return reduce(DataFrame.unionByName, read).mapInArrow(run, schema) if read else self.spark.createDataFrame([], schema)
