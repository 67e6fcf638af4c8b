"""Hybrid retrieval: lexical and vector candidates, reciprocal rank fusion, paging, bounded reads."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.functions.text import segmented
from lodestore.operators.postings import Postings
from lodestore.operators.vectors import VectorIndex

POOL, PAGE_END, RRF = 1100, 1000, 60
NEAR = 0.65


def lexical_rank(text: Column, words: list[str]) -> Column:
    """A tenth of the number of matching positions: the cover density of a flat OR of single terms (VEC03)."""
    wanted = F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")
    return F.size(F.filter(segmented(text), lambda t: F.array_contains(wanted, t))) * F.lit(0.1)


def cosine_distance(a: Column, b: Column) -> Column:
    """In double precision (VEC01)."""
    d = lambda v: F.transform(v, lambda x: x.cast("double"))
    dot = lambda x, y: F.aggregate(F.zip_with(d(x), d(y), lambda p, q: p * q), F.lit(0.0), lambda s, p: s + p)
    return 1 - dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def valid_vector(v: Column, dimension: int | None = None) -> Column:
    """Not empty, all finite, of the dimension asked for (VEC02)."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (F.size(v) > 0) & finite & (F.lit(True) if dimension is None else F.size(v) == dimension)


def ranked(candidates: DataFrame, *order: Column, pool: int = POOL) -> DataFrame:
    """The first ``pool`` candidates with their rank from 1 (WIN01, ORD01). The limit comes first, so the window sees
    the pool alone."""
    return candidates.orderBy(*order).limit(pool).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def lexical(chunks: DataFrame, words: list[str], pool: int = POOL) -> DataFrame:
    """``chunk_id``, ``rank``. Without words every chunk qualifies, with rank value 0."""
    scored = chunks.select("chunk_id", lexical_rank(F.col("text"), words).alias("value"))
    return ranked(scored.filter("value > 0") if words else scored, F.desc("value"), F.asc("chunk_id"), pool=pool)


def lexical_of(index: Postings, words: list[str], visible: DataFrame, pool: int = POOL) -> DataFrame:
    """``lexical`` from an index: the buckets of the words are read, and no text. ``visible``: ``doc_id`` of the documents
    whose chunks count."""
    scored = index.ranked(words).join(visible.select("doc_id"), "doc_id", "left_semi")
    return ranked(scored, F.desc("value"), F.asc("doc_id"), F.asc("ordinal"), pool=pool).drop("value")


def semantic(vectors: DataFrame, query: list[float], near: float = NEAR, pool: int = POOL) -> DataFrame:
    """``chunk_id``, ``rank`` of vectors nearer than ``near``; the query is a literal, so nothing is joined."""
    literal, length = F.array(*(F.lit(float(x)) for x in query)), math.sqrt(sum(float(x) ** 2 for x in query))
    dot = F.aggregate(F.zip_with("embedding", literal, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, p: s + p)
    own = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    scored = vectors.filter(F.col("embedding").isNotNull()).select("chunk_id", F.round(1 - dot / (own * F.lit(length)), 9).alias("distance"))
    return ranked(scored.filter(F.col("distance") < near), F.asc("distance"), F.asc("chunk_id"), pool=pool)


def semantic_of(index: VectorIndex, query: list[float], visible: DataFrame, near: float = NEAR, pool: int = POOL) -> DataFrame:
    """``semantic`` from an index: ``doc_id``, ``ordinal``, ``rank``; clusters that hold nothing near are not read."""
    found = index.near(query, near).join(visible.select("doc_id"), "doc_id", "left_semi")
    return ranked(found, F.asc("distance"), F.asc("doc_id"), F.asc("ordinal"), pool=pool).drop("distance")


def fused(*lists: DataFrame) -> DataFrame:
    """``chunk_id``, ``score``: the sum of 1 / (60 + rank) over the lists (AGG08, JOI10)."""
    union = lists[0].select("chunk_id", "rank")
    for other in lists[1:]:
        union = union.unionByName(other.select("chunk_id", "rank"))
    return union.groupBy("chunk_id").agg(F.round(F.sum(F.lit(1.0) / (F.lit(RRF) + F.col("rank"))), 9).alias("score"))


def page(scores: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` by score and id, with ``place`` from 1 (ORD02, ORD04)."""
    order = (F.desc("score"), F.asc("chunk_id"))
    return ranked(scores, *order, pool=offset + limit).filter(F.col("rank") > offset).withColumnRenamed("rank", "place")


def hydrated(rows: DataFrame, chunks: DataFrame, excerpt: int = 600) -> DataFrame:
    """Text of a page's rows only; rows that are no longer visible vanish (JOI11, FLT20). A page has at most 20 rows."""
    text = chunks.select("chunk_id", "doc_id", F.left("text", F.lit(excerpt)).alias("excerpt"), (F.length("text") > excerpt).alias("excerpt_truncated"))
    return text.join(F.broadcast(rows), "chunk_id")


def bounded_read(chunks: DataFrame, start: Column, limit: int, max_chars: int) -> DataFrame:
    """Of every document its chunks from ``start`` on, at most ``limit``, while their lengths fit in ``max_chars`` (WIN02).

    ``blocked``: the first chunk alone does not fit; then it is the only row, without text.
    """
    upto = W.partitionBy("doc_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = (
        chunks.filter((F.col("ordinal") >= start) & (F.col("ordinal") < start + limit))
        .withColumn("upto", F.sum(F.length("text")).over(upto)).withColumn("nth", F.row_number().over(W.partitionBy("doc_id").orderBy("ordinal")))
    )
    fits = F.col("upto") <= max_chars
    return found.filter(fits | (F.col("nth") == 1)).select("doc_id", "ordinal", F.when(fits, F.col("text")).alias("text"), (~fits).alias("blocked"))
