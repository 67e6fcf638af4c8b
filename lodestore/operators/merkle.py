"""Fingerprints of tables as trees of digests (AGG19, OPS03, OPS04, SET08).

Rows are put in canonical order, which is that of their SHA-256, so equal tables agree in whatever order and partitions
they come. A leaf is the range of rows whose digests begin with the same hexadecimal digits; its digest is that of its
rows and how often each stands there, and a node's is that of its children. No task sees more than a leaf, repeated
rows are counted before they meet, and a comparison of two trees looks at rows only below nodes that differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.operators.integrity import row_digest
from lodestore.sources.commits import kept

#: Rows of a leaf that ``depth_for`` aims at.
LEAF = 4096


def depth_for(n_rows: int, leaf: int = LEAF) -> int:
    """Digits of a leaf's name for so many rows. Trees compare only if they have the same depth."""
    depth = 0
    while n_rows > leaf << 4 * depth:
        depth += 1
    return depth


def counted_rows(df: DataFrame) -> DataFrame:
    """``row``, the digest of each distinct row, and ``n``, how often it stands."""
    return df.select(row_digest(df.columns).alias("row")).groupBy("row").agg(F.count("*").alias("n"))


def _digest(one: Column) -> Column:
    return F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n").cast("binary"), 256)


def leaves(df: DataFrame, depth: int) -> DataFrame:
    """``prefix``, ``n_rows``, ``digest`` of the ranges that have rows."""
    of = counted_rows(df).groupBy(F.left("row", F.lit(depth)).alias("prefix"))
    return of.agg(F.sum("n").alias("n_rows"), _digest(F.concat_ws(":", "row", F.col("n").cast("string"))).alias("digest"))


def _kept(below: DataFrame) -> DataFrame:
    """Nodes written to the shared folder: they are few, and every level of a comparison reads them."""
    return kept(below, "leaves")


def tree(below: DataFrame, depth: int) -> DataFrame:
    """``depth``, ``prefix``, ``n_rows``, ``digest`` of all nodes above leaves, and of these. An empty table has none."""
    levels = [below]
    for d in range(depth - 1, -1, -1):
        of = levels[-1].groupBy(F.left("prefix", F.lit(d)).alias("prefix"))
        levels.append(of.agg(F.sum("n_rows").alias("n_rows"), _digest(F.concat_ws(":", "prefix", "digest")).alias("digest")))
    named = [t.select(F.lit(depth - k).alias("depth"), "prefix", "n_rows", "digest") for k, t in enumerate(levels)]
    return reduce(DataFrame.unionByName, named)


def root(nodes: DataFrame) -> tuple[int, str]:
    """Rows and digest of the whole table; (0, "") if it is empty."""
    found = nodes.filter("depth = 0").first()
    return (found["n_rows"], found["digest"]) if found else (0, "")


def differing(a: DataFrame, b: DataFrame, depth: int) -> DataFrame:
    """``prefix`` of the leaves in which two trees differ. Level by level, only children of differing nodes are compared."""
    level = lambda t, d, x: t.filter(F.col("depth") == d).select("prefix", F.col("digest").alias(x))
    found = None
    for d in range(depth + 1):
        left, right = level(a, d, "a"), level(b, d, "b")
        if found is not None:
            parent = F.left("prefix", F.lit(d - 1))
            left, right = (t.withColumn("up", parent).join(found.select(F.col("prefix").alias("up")), "up", "left_semi").drop("up") for t in (left, right))
        found = _kept(left.join(right, "prefix", "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("prefix"))
    return found


def changes(before: DataFrame, after: DataFrame, depth: int, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows that stand more often in one table than in the other, with ``side`` (``before``, ``after``) and ``times``, how
    much more. ``trees``: of the two tables, where they are kept; rows in leaves that agree are not compared."""
    a, b = trees or tuple(_kept(tree(_kept(leaves(t, depth)), depth)) for t in (before, after))
    leaf = differing(a, b, depth)
    columns = sorted(before.columns)

    def suspects(df: DataFrame, one: int) -> DataFrame:
        named = df.select(*columns, row_digest(df.columns).alias("_row"), F.lit(one).cast("long").alias("_one"))
        return named.withColumn("prefix", F.left("_row", F.lit(depth))).join(leaf, "prefix", "left_semi")

    both, more = suspects(before, 1).unionByName(suspects(after, -1)), F.sum("_one").alias("_more")
    if any(t in before.schema.simpleString() for t in ("float", "double", "map<")):  # a key would have -0.0 as 0.0
        met = both.groupBy("_row").agg(more, F.first(F.struct(*columns)).alias("_values")).select("_more", "_values.*")
    else:  # sums are hashed, where values taken along would have every row sorted
        met = both.groupBy("_row", *columns).agg(more)
    return met.filter("_more <> 0").select(F.when(F.col("_more") > 0, "before").otherwise("after").alias("side"), F.abs("_more").alias("times"), *columns)
