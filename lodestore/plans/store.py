"""Queries of kept results, backup, restore and purge. What they write goes to a folder of their own that is deleted."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.operators.memo import Memo, merged, page_ranges
from lodestore.plans.base import query, table
from lodestore.sources.commits import Files
from lodestore.sources.shared import derived, shared_folder
from lodestore.sources.store import Purge, Store, backup, restore


@contextmanager
def own_folder(spark: SparkSession) -> Iterator[str]:
    folder = f"{shared_folder(spark)}/lodestore-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        Files(spark, folder).delete("")


def parsed(text: str) -> str:
    """The stand-in for a parser: fails on a range that shouts, else gives the length and digest of it."""
    if "!!" in text:
        raise ValueError("unreadable")
    return f"{len(text)} {hashlib.sha256(text.encode()).hexdigest()}"


def line_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files whose pages are their lines: ``doc_id``, ``first``, ``last``, ``content`` of each range."""
    lines = F.split("text", "\n")
    files = table(spark, sf_dir, "documents").select("doc_id", lines.alias("lines"), F.explode(page_ranges(F.size(lines))).alias("r"))
    return files.select("doc_id", "r.first", "r.last", F.array_join(F.slice("lines", F.col("r.first"), F.col("r.last") - F.col("r.first") + 1), "\n").alias("content"))


@query(
    "segmented_parse_src20_vis01",
    """WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT doc_id, l, greatest(1, len(l) // 8) AS size, unnest(range(1, len(l) + 1, greatest(1, len(l) // 8))) AS first FROM d),
    x AS (SELECT doc_id, first, least(first + size - 1, len(l)) AS last, array_to_string(l[first:first + size - 1], chr(10)) AS content FROM r),
    y AS (SELECT *, contains(content, '!!') AS failed, length(content) || ' ' || sha256(content) AS result FROM x)
    SELECT doc_id, CASE WHEN bool_and(failed) THEN 'failed' WHEN bool_or(failed) THEN 'partial' ELSE 'ready' END AS state, sha256(coalesce(string_agg(result, chr(10) ORDER BY first) FILTER (NOT failed), '')) AS text_sha256,
      coalesce(string_agg('第 ' || first || '-' || last || ' 页解析未完成，该范围请核对原文件。', '|' ORDER BY first) FILTER (failed), '') AS warnings FROM y GROUP BY doc_id""",
)
def segmented_parse(spark, sf_dir):
    """Ranges of pages worked on by content, once a session and state of the table; failures are warnings."""
    source, items = table(spark, sf_dir, "documents"), line_ranges(spark, sf_dir)
    folder = derived(source, "parsed", lambda f: Memo(spark, f).run(items, parsed, "lines-1", "2024-01-01", ["doc_id", "first"]))
    done = Memo(spark, folder).run(items, parsed, "lines-1", "2024-01-01", ["doc_id", "first"])
    return merged(done, "doc_id").select("doc_id", "state", F.sha2(F.col("text"), 256).alias("text_sha256"), F.array_join("warnings", "|").alias("warnings"))


def filled(spark: SparkSession, sf_dir: str, folder: str) -> Store:
    """A store with orders as jobs, customers as accounts, and documents."""
    store = Store(spark, folder)
    state = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("complete")
    store.write("jobs", table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"), (F.col("o_orderkey") % 4).alias("generation"), F.when(state == "running", F.col("o_orderdate").cast("string")).alias("lease_until")))
    store.write("accounts", table(spark, sf_dir, "customer"))
    store.write("documents", table(spark, sf_dir, "documents"))
    return store


@query(
    "restored_jobs_snk03_ops04",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'queued' ELSE 'complete' END AS state, o_orderkey % 4 + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS generation, CAST(NULL AS VARCHAR) AS lease_until FROM orders",
)
def restored_jobs(spark, sf_dir):
    """The jobs of a store after its backup was restored to an empty one; kept once a session and state of the tables."""

    def make(folder: str) -> None:
        with own_folder(spark) as scratch:
            backup(filled(spark, sf_dir, f"{scratch}/store"), f"{scratch}/backup")
            restore(spark, f"{scratch}/backup", Store(spark, folder), exactly=["accounts", "documents", "jobs"])

    return Store(spark, derived(table(spark, sf_dir, "orders"), "restored", make)).read("jobs")


@query(
    "purge_mut12",
    "SELECT 'accounts' AS table_name, true AS protected, (SELECT count(*) FROM customer) AS n_before, (SELECT count(*) FROM customer) AS n_after, true AS same UNION ALL SELECT 'documents', false, (SELECT count(*) FROM documents), 0, (SELECT count(*) FROM documents) = 0 UNION ALL SELECT 'jobs', false, (SELECT count(*) FROM orders), 0, (SELECT count(*) FROM orders) = 0",
)
def purge(spark, sf_dir):
    """The tables of a store before and after the purge of its content; one row a table."""
    with own_folder(spark) as scratch:
        entry = Purge(filled(spark, sf_dir, f"{scratch}/store"), f"{scratch}/archive", ["documents", "jobs"]).run()
    rows = [(n, n not in entry["content"], b["rows"], entry["after"][n]["rows"], b == entry["after"][n]) for n, b in entry["before"].items()]
    return spark.createDataFrame(rows, "table_name string, protected boolean, n_before long, n_after long, same boolean")
