"""Quality and integrity: fact scoring, fingerprints of tables, reconciliation, measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.functions.text import squash_lower


def score_facts(facts: DataFrame, chunks: DataFrame, locator: str) -> DataFrame:
    """Facts (``fact_id``, ``file``, locator, ``contains`` or ``excludes``) against the text at their place (AGG14).

    A fact passes if there are chunks there and the text, without white space and case, contains what it should, or
    does not what it should not.
    """
    at = chunks.groupBy(locator).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda c: c["text"]), "\n").alias("_text"))
    met = facts.join(at, locator, "left")
    wanted = F.coalesce("contains", "excludes")
    inside = F.contains(squash_lower(F.col("_text")), squash_lower(wanted))
    passed = F.col("_text").isNotNull() & F.when(F.col("contains").isNotNull(), inside).otherwise(~inside)
    return met.select("fact_id", "file", F.coalesce(passed, F.lit(False)).alias("passed"))


def score_files(scored: DataFrame) -> DataFrame:
    """Per file: passed, total, percent (two places; null without facts) and whether it is strictly above 95."""
    percent = F.round(100 * F.count_if("passed") / F.count(F.lit(1)), 2)
    return scored.groupBy("file").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"), percent.alias("percent"), (percent > 95).alias("qualified"))


def row_digest(columns: list[str]) -> Column:
    """Of a row: SHA-256 of its canonical JSON, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def table_fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Rows and a sum over row digests that no order changes (AGG19): one aggregate, at any size. Equal tables are equal
    in both; the sum is of the digests' leading 60 bits, in decimals.

    It is comparable with fingerprints made here only. A SHA-256 over all sorted rows, as a single machine makes it, would
    pass the whole table through one task.
    """
    value = F.conv(F.substring(row_digest(df.columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(value), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest")).select(F.lit(name).alias("table_name"), "n_rows", "digest")


def compare_snapshots(before: DataFrame, after: DataFrame, may_be_added: tuple[str, ...] = ()) -> DataFrame:
    """Tables of either snapshot with ``same``, ``changed``, ``missing``, ``added`` or ``unexpected`` (OPS03, OPS04)."""
    b = before.select("table_name", F.col("n_rows").alias("b_rows"), F.col("digest").alias("b_digest"))
    met = b.join(after, "table_name", "full")
    status = (
        F.when(F.col("b_digest").isNull(), F.when(F.col("table_name").isin(*may_be_added), "added").otherwise("unexpected") if may_be_added else F.lit("unexpected"))
        .when(F.col("digest").isNull(), "missing").when((F.col("b_digest") == F.col("digest")) & (F.col("b_rows") == F.col("n_rows")), "same").otherwise("changed")
    )
    return met.select("table_name", status.alias("status"))


def reconcile(references: DataFrame, files: DataFrame) -> DataFrame:
    """References (``path``, ``size``, ``sha256``) against a listing of the same columns (JOI14, SET04, SNK03, OPS05)."""
    r = references.select("path", F.col("size").alias("r_size"), F.col("sha256").alias("r_sha"))
    f = files.select("path", F.col("size").alias("f_size"), F.col("sha256").alias("f_sha"))
    status = (
        F.when(F.col("r_sha").isNull(), "unreferenced").when(F.col("f_sha").isNull(), "missing")
        .when(F.col("r_size") != F.col("f_size"), "wrong_size").when(F.col("r_sha") != F.col("f_sha"), "wrong_content").otherwise("ok")
    )
    return r.join(f, "path", "full").select("path", status.alias("status"))


#: Device names that no file may have.
DEVICES = ("CON", "PRN", "AUX", "NUL", *(f"{d}{k}" for d in ("COM", "LPT") for k in range(1, 10)))


def copy_status(asked: DataFrame, standing: DataFrame, longest: int = 240) -> DataFrame:
    """``status`` of copies to be made (``name``, ``digest``) beside those that stand in a folder (OPS06): ``unsafe`` or
    ``reserved`` names, ``copied`` under a free one, ``identical_copy_exists``, or ``conflict`` with other contents."""
    held = standing.groupBy(F.col("name").alias("_name")).agg(F.min("digest").alias("_low"), F.max("digest").alias("_high"))
    name = F.col("name")
    unsafe = (name == "") | name.isin(".", "..") | name.rlike(r'[/\\:\x00-\x1f<>|?*"]') | name.rlike("[ .]$") | (F.length(name) > longest)
    status = (
        F.when(unsafe, "unsafe").when(F.upper(F.split_part(name, F.lit("."), F.lit(1))).isin(*DEVICES), "reserved").when(F.col("_name").isNull(), "copied")
        .when((F.col("_low") == F.col("digest")) & (F.col("_high") == F.col("digest")), "identical_copy_exists").otherwise("conflict")
    )
    return asked.join(held, name == F.col("_name"), "left").withColumn("status", status).drop("_name", "_low", "_high")


def nearest_rank(value: str, p: float) -> Column:
    """The ceil(n * p)-th of the sorted values (AGG15)."""
    return F.expr(f"percentile_disc({p}) within group (order by {value})")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that are in one table and not in the other, as often as they are more there (SET08)."""
    return a.exceptAll(b).withColumn("side", F.lit("before")).unionByName(b.exceptAll(a).withColumn("side", F.lit("after")))
