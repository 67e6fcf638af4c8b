"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame operations only.

A source whose target is r times its size gives floor(r) whole epochs and a fraction of another one. The
fraction is a weighted sample without replacement: each document draws an exponential key divided by its
quality weight, and the documents of least keys are taken while their words fit. The keys of a source are
summed in two steps, first in ``bins`` bins of the key over all rows, then row by row in the one bin in which
the budget ends, so no task sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.llm.common import fresh, materialize, settled

WORD = r"[^\x20\x09-\x0D]+"
#: Characters whose share in a text lowers its quality weight.
MARKS = "|#$%&*!"
LEAST_WEIGHT = 0.25
#: Sources up to this number are broadcast (each row is a name and a few numbers).
BROADCAST_SOURCES = 20_000


def quality_weight(text: Column) -> Column:
    """1 for a text without marks, falling with their share to ``LEAST_WEIGHT``; null and empty texts: 1."""
    n = F.length(text)
    share = F.try_divide(n - F.length(F.translate(text, MARKS, "")), n)
    return F.coalesce(F.greatest(F.lit(LEAST_WEIGHT), 1 - 4 * share), F.lit(1.0))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: str) -> Column:
    """An exponential variable with rate ``weight``, fixed by id, text and seed; so rows that repeat an id, or have
    none, draw keys of their own unless their texts are equal too."""
    name = F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit("|"), F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.lit(f"|{seed}"))
    drawn = F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((drawn + 0.5) / F.lit(float(1 << 52))) / weight


@settled
def mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, bins: int = 1 << 14, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None,
) -> DataFrame:
    """Per row: id, ``source``, ``size`` (words; null text: 0), ``source_size``, ``target`` of its source, ``epochs``
    (times the row is taken, 0 to ``most``) and ``taken`` (words, repeats counted).

    Sources in code point order, null last, have ``weights`` in turn, repeating, and share ``share`` times all
    words; a target stops at ``most`` times its source's size and the excess is shared again by weight. The last
    document of a fraction is taken if at least half of it fits. Rows with equal keys are taken by id, then size;
    copies of one row may be taken apart.

    ``weight_col``: the documents' quality weights, say a classifier's scores; at least ``LEAST_WEIGHT`` is taken, 1
    for null. Without it ``quality_weight`` of the text. Empty and null texts have size 0 and any number of epochs.
    """
    rows, per_source = _allotted(docs, weights, share, most, bins, seed, id_col, text_col, source_col, weight_col)
    found = rows.join(per_source.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source")))
    # A source without a cut is taken whole epochs only: its rest is 0 or below every sum.
    plain = found.filter("cut_bin is null or bin <> cut_bin").withColumn("extra", F.when((F.col("bin") < F.col("cut_bin")) & (F.col("rest") > 0), 1).otherwise(0))
    at = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.col("before") + F.sum("size").over(at)
    edge = found.filter("bin = cut_bin").withColumn("extra", F.when((upto - F.col("size") + F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0), 1).otherwise(0))
    return plain.unionByName(edge).select(
        F.col("doc_id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", (F.col("whole") + F.col("extra")).cast("int").alias("epochs"),
        ((F.col("whole") + F.col("extra")) * F.col("size")).cast("long").alias("taken"),
    )


def _sized(bins: int, seed: str, id_col: str, text_col: str, weight_col: str | None, names: list[str]) -> list[Column]:
    """Size, key and bin of a row, under ``names``."""
    weight = quality_weight(F.col(text_col)) if weight_col is None else F.greatest(F.lit(LEAST_WEIGHT), F.coalesce(F.nanvl(F.col(weight_col).cast("double"), F.lit(1.0)), F.lit(1.0)))
    key = sampling_key(F.col(id_col), F.col(text_col), weight, seed)
    found = [
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"), key,
        F.least(F.lit(bins - 1), F.floor(bins * (1 - F.exp(-key * LEAST_WEIGHT)))).cast("int"),
    ]
    return [c.alias(n) for c, n in zip(found, names, strict=True)]


def _allotted(
    docs: DataFrame, weights: tuple[float, ...], share: float, most: int, bins: int, seed: str, id_col: str, text_col: str, source_col: str, weight_col: str | None
) -> tuple[DataFrame, DataFrame]:
    """The rows without their texts, and of each source its target and where its fraction ends: in the bin ``cut_bin``,
    before which ``before`` words are taken."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).alias("source"), *_sized(bins, seed, id_col, text_col, weight_col, ["size", "key", "bin"]))
    rows = materialize(rows, "mix-rows")
    per_bin = materialize(rows.groupBy("source", "bin").agg(F.sum("size").alias("size")), "mix-bins")
    targets = materialize(_targets(per_bin.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "mix-targets")
    ends = W.partitionBy("source").orderBy("bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = (
        per_bin.withColumn("upto", F.sum("size").over(ends)).join(targets, per_bin["source"].eqNullSafe(targets["source"])).select(targets["*"], "bin", "upto", "size")
        .filter("upto > rest").groupBy("source").agg(F.min(F.struct("bin", (F.col("upto") - F.col("size")).alias("before"))).alias("cut"))
    )
    per_source = targets.join(last, targets["source"].eqNullSafe(last["source"]), "left").select(targets["*"], F.col("cut.bin").alias("cut_bin"), F.col("cut.before").alias("before"))
    return rows, F.broadcast(per_source) if targets.count() <= BROADCAST_SOURCES else per_source


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: int = 2, bins: int = 1 << 14, seed: str = "mix",
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None,
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it (not at all, or up to ``most`` times), with all columns.

    Texts stay where they are: what travels is each source's last document taken. Rows equal to that one in key, id
    and size are taken with it.
    """
    rows, per_source = _allotted(docs, weights, share, most, bins, seed, id_col, text_col, source_col, weight_col)
    edge = rows.join(per_source.withColumnRenamed("source", "_source"), rows["source"].eqNullSafe(F.col("_source")) & (F.col("bin") == F.col("cut_bin")))
    at = W.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    upto = F.col("before") + F.sum("size").over(at)
    taken = edge.withColumn("upto", upto).filter(F.col("upto") - F.col("size") + F.col("size") / 2 <= F.col("rest"))
    point = F.struct(F.col("key").alias("key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.col("size").alias("size"))
    last = taken.groupBy("source").agg(F.max(point).alias("last"))
    size, key, bin_, source, cut, time = fresh(docs, "_size", "_key", "_bin", "_source", "_cut", "_time")
    limits = F.struct("whole", "rest", "cut_bin", "last").alias(cut)
    cuts = materialize(per_source.join(last, per_source["source"].eqNullSafe(last["source"]), "left").select(per_source["source"].alias(source), limits), "mix-cuts")
    cuts = F.broadcast(cuts) if cuts.count() <= BROADCAST_SOURCES else cuts
    sized = docs.select("*", *_sized(bins, seed, id_col, text_col, weight_col, [size, key, bin_])).join(cuts, F.col(source_col).eqNullSafe(F.col(source)))
    here = F.struct(F.col(key).alias("key"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"), F.col(size).alias("size"))
    end = lambda name: F.col(cut).getField(name)
    more = (end("rest") > 0) & ((F.col(bin_) < end("cut_bin")) | ((F.col(bin_) == end("cut_bin")) & (here <= end("last"))))
    times = end("whole") + F.when(more, 1).otherwise(0)
    return sized.withColumn(time, F.explode(F.sequence(F.lit(0), times))).filter(F.col(time) > 0).select(*docs.columns)


def _targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: int) -> DataFrame:
    """Per source: ``target``, ``whole`` epochs and the ``rest`` in words. The windows run over one row a source."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.pmod(F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1)
    level = (most * F.col("source_size")) / F.col("weight")
    full = W.orderBy("level", "source").rowsBetween(W.unboundedPreceding, W.currentRow)
    everything = W.partitionBy(F.lit(0))
    filled = (
        sizes.withColumn("weight", weight).withColumn("level", level)
        .withColumn("all", F.lit(share) * F.sum("source_size").over(everything))
        .withColumn("full", (most * F.sum("source_size").over(full)).cast("double"))
        .withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(full))
        .withColumn("capped", F.col("full") + F.col("level") * F.col("open") <= F.col("all"))
    )
    taken = F.coalesce(F.max(F.when(F.col("capped"), F.col("full"))).over(everything), F.lit(0.0))
    left = F.coalesce(F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything), F.lit(0.0))
    target = F.when(F.col("capped"), (most * F.col("source_size")).cast("double")).otherwise(F.try_divide(F.col("all") - taken, left) * F.col("weight"))
    return filled.withColumn("target", F.least(target, (most * F.col("source_size")).cast("double"))).withColumn(
        "whole", F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.try_divide(F.col("target"), F.col("source_size")))).cast("int")
    ).select("source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


#: The same mix for DuckDB; ``{docs}`` is the relation.
SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '|' || md5(coalesce(text, '')) || '|mix'), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
      / coalesce(greatest(0.25::DOUBLE, 1 - 4 * ((length(text) - length(translate(text, '|#$%&*!', '')))::DOUBLE / nullif(length(text), 0))), 1.0) AS key
  FROM {docs}
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight
  FROM sized GROUP BY source
), levels AS (
  SELECT *, 2 * source_size / weight AS level, 1.5::DOUBLE * sum(source_size) OVER () AS words FROM sources
), filled AS (
  SELECT *, (2 * sum(source_size) OVER upto)::DOUBLE AS filled_to, sum(weight) OVER () - sum(weight) OVER upto AS open FROM levels
  WINDOW upto AS (ORDER BY level, source NULLS FIRST ROWS UNBOUNDED PRECEDING)
), capped AS (
  SELECT *, filled_to + level * open <= words AS capped FROM filled
), shared AS (
  SELECT source, source_size, least((2 * source_size)::DOUBLE, CASE WHEN capped THEN (2 * source_size)::DOUBLE
    ELSE (words - coalesce(max(filled_to) FILTER (WHERE capped) OVER (), 0.0)) / (sum(weight) FILTER (WHERE NOT capped) OVER ()) * weight END) AS target
  FROM capped
), targets AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size) END AS whole FROM shared
), summed AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.whole, t.target - t.whole * t.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((whole + (rest > 0 AND upto - size + size / 2.0 <= rest)::INT) * size)::BIGINT AS taken FROM summed
"""
