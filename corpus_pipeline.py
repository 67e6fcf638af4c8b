"""From raw documents to token ids, in five stages.

Each stage takes what its predecessor kept, written as Parquet in the shared folder and read again. All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestore.llm import bpe, mixing, near_dedup, quality, secrets
from lodestore.llm.common import drop_materialized, settled, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled ones of the raw table.

    Null and empty texts get the score of no words; repeated rows and repeated ids are judged row by row, by their
    texts; an empty table gives an empty one. Extra columns pass, whatever their names.
    """
    model = quality.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (five-word shingles, similarity 0.8) the document of least id stays.

    Rows are told apart by id and text: of rows that repeat an id only the copies go; rows equal in both become one.
    Rows without an id or without words stay, but for such repetitions. Extra columns pass, whatever their names.
    """
    return near_dedup.deduplicated(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts, and ``n_chars`` counts anew where a text changed; every row stays.

    Null and empty texts stay as they are, so do repeated rows. Extra columns pass, whatever their names.
    """
    return secrets.redacted(docs, secrets.trained(spark), length_col="n_chars")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: documents stay, go, or are repeated.

    A null source is a source of its own, last in order; null and empty texts have no words and stay with the
    whole epochs of their source. Extra columns pass, whatever their names.
    """
    return mixing.mixed(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and back: counts and digests, a row for each row; null texts are empty."""
    return bpe.round_trip(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE encoding and decoding", bpe_stage),
]

#: Trained models and likelihoods are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage by stage; when a stage is written, its intermediate tables and its predecessor are deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = settled(stage)(spark, docs, sf_dir)
        if before is not None:
            drop_materialized(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
