"""The queries of this subpackage, for the entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import bitplanes, bpe, chroma, fingerprints, license_scan, mixing, near_dedup, quality, runs, secrets, sharding, substring_dedup, topk
from lodestore.llm.common import materialize, settled, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


@settled
def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media, so each vector of ``embeddings`` is turned into a recording first."""
    found = materialize(chroma.of_vectors(table(spark, sf_dir, "embeddings")), "vector-recordings")
    own = found.select(F.col("id").alias("vec_id"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", " ").cast("binary"), 256).alias("items_sha256"), "edit_offset", "edit_errors")
    return own.join(chroma.search(found).withColumnRenamed("id", "vec_id"), "vec_id", "left")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents")).drop("spans")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), secrets.trained(spark))
    listed = F.array_join(F.transform("findings", lambda x: F.concat_ws(":", x["nth"], x["length"], x["masked"])), ",")
    return found.select("doc_id", "n_candidates", "n_findings", "score", listed.alias("findings"), F.sha2(F.col("redacted").cast("binary"), 256).alias("redacted_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), edited=True, texts=False)


def op13_bitplane_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.clusters(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_quality": op2_quality,
        "op3_license_scan": op3_license_scan,
        "op4_fingerprints": op4_fingerprints,
        "op5_chroma": op5_chroma,
        "op6_source_mixing": op6_source_mixing,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_secret_scan": op9_secret_scan,
        "op10_near_dedup": op10_near_dedup,
        "op11_exact_topk": op11_exact_topk,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_bitplane_clusters": op13_bitplane_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": license_scan.oracle(),
        "op6_source_mixing": mixing.SQL.format(docs="documents"),
        "op8_substring_dedup": substring_dedup.SQL.format(docs="documents"),
        "op10_near_dedup": near_dedup.SQL.format(docs="documents"),
        "op11_exact_topk": topk.SQL,
        "op12_periodic_runs": runs.SQL,
        "op13_bitplane_clusters": bitplanes.oracle(),
    }
