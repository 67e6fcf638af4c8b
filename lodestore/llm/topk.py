"""Exact top-k search by inner product, by the threshold algorithm over sorted lists.

Candidates are dealt into lanes and queries into bands, so a task holds one lane and one band, both of bounded size.
In a lane every component has a list of the candidates in order of their values. A query reads all lists from the
side its own component asks for, some places at a time, scores each candidate it has not met before, and stops when
a candidate that stands nowhere above the last places read cannot beat its kth result. It begins with a bound: its
kth score among a bounded sample of the candidates, which no lane's result needs to fall below.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestore.llm.bitplanes import LEAST, MOST, usable
from lodestore.llm.common import materialize, settled

#: Most candidates of a lane, most queries of a band; few rows are still dealt into up to ``LANES`` of ``SMALL``.
LANE, BAND, LANES, SMALL = 1 << 16, 1 << 14, 64, 1 << 10
#: Candidates that give each query its first bound, drawn by a hash of the row.
SAMPLE = 1024
#: Places of each list read in the first step; each later step doubles what has been read.
STEP = 16


def matrix(column: pa.Array | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of a list column, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), max(int(n.max(initial=0)), width or 0)), np.int64)
    flat = column.flatten().to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _exact(*parts: np.ndarray) -> list[np.ndarray]:
    """As doubles, if all inner products of their rows are exact in doubles, else as Python integers."""
    largest = [max(abs(int(p.min(initial=0))), int(p.max(initial=0))) for p in parts]
    kind = float if largest[0] * largest[1] * max(parts[0].shape[1], 1) < 1 << 53 else object
    return [p.astype(kind) for p in parts]


class Lane:
    """Sorted lists of the candidates ``rows`` (numbers), with ``ids`` and ``values``."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray):
        self.rows, self.ids, self.values = rows, ids, values
        self.order = np.argsort(values, axis=0, kind="stable").T.astype(np.int32)
        self.sorted = np.take_along_axis(values, self.order.T.astype(np.int64), 0).T

    def best(self, query: np.ndarray, own: int, k: int, floor: float | int | None) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the ``k`` candidates, other than the row ``own``, of greatest score (ties: smaller id)
        among those whose score is at least ``floor``."""
        m, used = len(self.rows), np.flatnonzero(query != 0)
        at, scores = np.zeros(0, np.int64), np.zeros(0, query.dtype)
        seen = np.zeros(m, bool)
        seen[self.rows == own] = True
        falling = (query[used] > 0)[:, None]
        done, depth = 0, STEP if len(used) else m
        while True:
            depth = min(depth, m)
            if len(used):
                place = np.arange(done, depth)[None, :]
                met = self.order[used[:, None], np.where(falling, m - 1 - place, place)].ravel()
                met = met[~seen[met]]
                seen[met] = True
                fresh = np.unique(met)
            else:
                fresh = np.flatnonzero(~seen)
            score = self.values[fresh] @ query
            if floor is not None:
                fresh, score = fresh[score >= floor], score[score >= floor]
            at, scores = np.concatenate([at, fresh]), np.concatenate([scores, score])
            order = np.lexsort((self.ids[at], -scores)) if scores.dtype != object else np.array(sorted(range(len(at)), key=lambda i: (-scores[i], self.ids[at[i]])), np.int64)
            at, scores = at[order[:k]], scores[order[:k]]
            if depth == m:
                return at, scores
            reach = (self.sorted[used, np.where(falling[:, 0], m - depth, depth - 1)] * query[used]).sum()
            if len(at) == k and (floor is None or scores[-1] > floor):
                floor = scores[-1]
            if floor is not None and reach < floor:
                return at, scores
            done, depth = depth, 2 * depth


def _clip(values: list) -> list[int]:
    return [max(LEAST, min(int(v), MOST)) for v in values]


RESULT = "query bigint, query_id bigint, vec_id bigint, score bigint"


@settled
def search(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every`` its ``k`` rows of greatest inner product, itself left out:
    ``query_id``, ``rank`` (int, from 1), ``vec_id``, ``score`` (long).

    Components are floor(scale * x). Vectors that are null or hold null or non-finite components take no part; a
    shorter vector counts as filled with zeros, an empty one scores 0. Ties go to the smaller id, a null id first; a
    null id is never a query. Repeated rows are rows like others: they are found by each other, and each query row has
    results of its own. Components that leave 64 bits are set to the end of that range, so are scores, after ranking
    inside a lane and before ranking between lanes. Fewer candidates than ``k`` give fewer rows, an empty table none;
    other columns are not read.
    """
    whole = F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    table = materialize(usable(vectors, id_col, vector_col).select(F.monotonically_increasing_id().alias("row"), "id", whole.alias("x")), "vectors")
    asks = F.coalesce(F.col("id") % every == 0, F.lit(False))
    n, n_queries = table.agg(F.count("*"), F.count_if(asks)).first()
    lanes = max(-(-n // LANE), min(LANES, -(-n // SMALL)), 1)
    bands = max(-(-n_queries // BAND), 1)
    sample = table.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("row", "x").toArrow()

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = matrix(sample.column(1))
        rows = sample.column(0).to_numpy()
        for batch in batches:
            queries = matrix(batch.column(2), known.shape[1])
            width = queries.shape[1]
            a, b = _exact(np.pad(known, ((0, 0), (0, width - known.shape[1]))), queries)
            floors = []
            for own, q in zip(batch.column(0).to_numpy(), b, strict=True):
                scores = (a @ q)[rows != own]
                floors.append(None if len(scores) < k else int(np.partition(scores, len(scores) - k)[-k] if scores.dtype != object else sorted(scores)[-k]))
            clipped = pa.array([None if f is None or f < LEAST else min(f, MOST) for f in floors], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, clipped], names=["row", "id", "x", "floor"])

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[list] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            width = max(matrix(left["x"].slice(0, 1)).shape[1], matrix(right["x"].slice(0, 1)).shape[1])
            a, b = matrix(left["x"], width), matrix(right["x"], width)
            width = max(a.shape[1], b.shape[1])
            a, b = _exact(*(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (a, b)))
            ids = left["id"].fill_null(LEAST).to_numpy()
            real = left["id"].to_pylist()
            lane = Lane(left["row"].to_numpy(), ids, a)
            for own, name, q, floor in zip(right["row"].to_pylist(), right["id"].to_pylist(), b, right["floor"].to_pylist(), strict=True):
                at, scores = lane.best(q, own, k, floor)
                for column, values in zip(found, ([own] * len(at), [name] * len(at), [real[i] for i in at], _clip(scores.tolist())), strict=True):
                    column.extend(values)
        return pa.table({c: pa.array(v, pa.int64()) for c, v in zip(("query", "query_id", "vec_id", "score"), found, strict=True)})

    dealt = lambda parts, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(parts)).cast("int")
    everywhere = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    queries = table.filter(asks).mapInArrow(bounded, "row long, id long, x array<long>, floor long")
    left = table.select(dealt(lanes, 1).alias("lane"), everywhere(bands).alias("band"), "row", "id", "x")
    right = queries.select(everywhere(lanes).alias("lane"), dealt(bands, 2).alias("band"), "row", "id", "x", "floor")
    found = left.groupBy("lane", "band").cogroup(right.groupBy("lane", "band")).applyInArrow(met, RESULT)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: Every query row against every other row.
SQL = """WITH v AS (
  SELECT row_number() OVER () AS nth, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), scored AS (
  SELECT q.nth, q.vec_id AS query_id, v.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.x), len(v.x)) + 1), lambda i: q.x[i] * v.x[i])), 0) AS score FROM v q JOIN v ON v.nth <> q.nth WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY nth ORDER BY score DESC, vec_id NULLS FIRST) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM scored QUALIFY rank <= 5"""
