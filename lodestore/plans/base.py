"""Registration of queries, and the tables that stand in for a document store.

A query is a function of (spark, sf_dir); its oracle is SQL that DuckDB runs on the same tables. Documents, their
owners, states and grants are derived from the columns of ``documents`` by fixed rules, the same in both.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.operators.postings import Postings
from lodestore.operators.security import Principal
from lodestore.sources.shared import derived

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


ALICE = Principal("u7", {"src0": "publisher", "src1": "member", "src2": "member", "src3": "member"})
BOUND = Principal("u7", {"src3": "member", "src4": "publisher", "src7": "publisher"}, restricted=True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.col("lang").alias("category_id"), F.col("source").alias("organization_id"),
        F.concat(F.lit("u"), i % 50).alias("created_by"),
        F.when(i % 5 == 0, "private").otherwise("department").alias("visibility"),
        F.when(i % 10 == 0, "draft").when(i % 10 == 1, "superseded").when(i % 10 == 2, "withdrawn").otherwise("published").alias("state"),
        F.concat(F.lit("AX-"), i % 40).alias("model"),
        F.when(i % 17 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (i % 365).cast("int"))).alias("business_date"),
        F.left(F.element_at(F.split("text", "\n"), 1), F.lit(80)).alias("title"),
    )


def grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter("doc_id % 13 = 0").select("doc_id", F.lit("u7").alias("principal_id"))


#: More than a text can have lines, so ids of chunks never meet.
LINES = 1 << 31


def chunks_of(docs: DataFrame) -> DataFrame:
    """A chunk is a line; its id orders by document and line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text")).withColumn("chunk_id", F.col("doc_id") * LINES + F.col("ordinal"))


def chunk_index(spark: SparkSession, sf_dir: str) -> Postings:
    """The index of the chunks of all documents, in whatever state; made once a session and state of the table."""
    source = table(spark, sf_dir, "documents")
    return Postings(spark, derived(source, "postings", lambda folder: Postings(spark, folder).build(chunks_of(source.select("doc_id", "text")))))


#: The same for DuckDB, as common table expressions.
KB = """kb AS (
  SELECT doc_id, text, lang AS category_id, source AS organization_id, 'u' || (doc_id % 50) AS created_by,
    CASE WHEN doc_id % 5 = 0 THEN 'private' ELSE 'department' END AS visibility,
    CASE doc_id % 10 WHEN 0 THEN 'draft' WHEN 1 THEN 'superseded' WHEN 2 THEN 'withdrawn' ELSE 'published' END AS state,
    'AX-' || (doc_id % 40) AS model, CASE WHEN doc_id % 17 <> 0 THEN DATE '2024-01-01' + (doc_id % 365)::INT END AS business_date,
    left(string_split(text, chr(10))[1], 80) AS title
  FROM documents
), grants AS (SELECT doc_id, 'u7' AS principal_id FROM documents WHERE doc_id % 13 = 0)"""


def readable_sql(p: Principal, alias: str = "kb") -> str:
    quoted = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")" if xs else "(NULL)"
    rule = (
        f"({alias}.created_by = '{p.id}' OR {alias}.organization_id IN {quoted(p.publishes)} OR ({alias}.visibility = 'department' AND {alias}.organization_id IN {quoted(p.organizations)})"
        f" OR EXISTS (SELECT 1 FROM grants g WHERE g.doc_id = {alias}.doc_id AND g.principal_id = '{p.id}'))"
    )
    return rule + (f" AND {alias}.organization_id IN {quoted(p.organizations)}" if p.restricted else "")


CHUNKS = "SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal"
SEGMENTED = r"list_concat(regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+'), regexp_extract_all(lower({0}), '[a-z0-9]+(?:[-_.][a-z0-9]+)+'))"
