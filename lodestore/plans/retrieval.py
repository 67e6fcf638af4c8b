"""Queries of retrieval and access (W1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.functions import text as tx
from lodestore.operators import retrieval as rt
from lodestore.operators import security as sec
from lodestore.operators.vectors import VectorIndex
from lodestore.plans.base import LINES, ALICE, BOUND, CHUNKS, KB, SEGMENTED, chunk_index, chunks_of, documents, grants, query, readable_sql, table
from lodestore.sources.shared import derived

#: The query text of the registered searches, and its keywords.
TEXT = "The reor of the tion"
WORDS = ["the", "reor", "of", "tion"]


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """One row: the vector that stands for the embedded query."""
    return list(table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0])


def visible(spark: SparkSession, sf_dir: str, who=ALICE) -> DataFrame:
    return sec.visible(documents(spark, sf_dir), grants(spark, sf_dir), who)


def vectors(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Vectors stand on the first chunk of the document of the same id."""
    found = table(spark, sf_dir, "embeddings").withColumn("doc_id", F.col("vec_id")).join(docs.select("doc_id"), "doc_id", "left_semi")
    return found.select((F.col("doc_id") * LINES).alias("chunk_id"), "embedding")


LEXICAL = f"""lexical AS (
  SELECT chunk_id, row_number() OVER (ORDER BY value DESC, chunk_id) AS rank FROM (
    SELECT doc_id * 2147483648 + ordinal AS chunk_id, 0.1::DOUBLE * len(list_filter({SEGMENTED.format('text')}, lambda t: t IN ('the', 'reor', 'of', 'tion'))) AS value FROM chunks)
  WHERE value > 0 ORDER BY value DESC, chunk_id LIMIT 1100
)"""
SEMANTIC = """semantic AS (
  SELECT chunk_id, row_number() OVER (ORDER BY distance, chunk_id) AS rank FROM (
    SELECT vec_id * 2147483648 AS chunk_id, round(list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 9) AS distance
    FROM embeddings WHERE vec_id IN (SELECT doc_id FROM visible))
  WHERE distance < {near} ORDER BY distance, chunk_id LIMIT 1100
)"""
VISIBLE = f"{KB}, visible AS (SELECT * FROM kb WHERE state = 'published' AND {readable_sql(ALICE)}), chunks AS ({CHUNKS} FROM visible)"
HYBRID = f"""WITH {VISIBLE}, {LEXICAL}, {SEMANTIC.format(near=1.0)},
fused AS (SELECT chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT * FROM lexical UNION ALL SELECT * FROM semantic) GROUP BY chunk_id),
page AS (SELECT chunk_id, score, row_number() OVER (ORDER BY score DESC, chunk_id) AS place FROM fused)
SELECT p.chunk_id, c.doc_id, p.score, p.place, left(c.text, 600) AS excerpt, length(c.text) > 600 AS excerpt_truncated
FROM page p JOIN chunks c ON p.chunk_id = c.doc_id * 2147483648 + c.ordinal """


def lexical_ranks(spark: SparkSession, sf_dir: str, words: list[str], docs: DataFrame, pool: int = rt.POOL) -> DataFrame:
    """``chunk_id``, ``rank`` from the index of chunks."""
    found = rt.lexical_of(chunk_index(spark, sf_dir), words, docs, pool)
    return found.select((F.col("doc_id") * LINES + F.col("ordinal")).alias("chunk_id"), "rank")


def hybrid(spark: SparkSession, sf_dir: str, offset: int, limit: int) -> DataFrame:
    docs = visible(spark, sf_dir)
    chunks = chunks_of(docs)
    scores = rt.fused(lexical_ranks(spark, sf_dir, WORDS, docs), rt.semantic(vectors(spark, sf_dir, docs), query_vector(spark, sf_dir), near=1.0))
    return rt.hydrated(rt.page(scores, offset, limit), chunks).select("chunk_id", "doc_id", "score", "place", "excerpt", "excerpt_truncated")


@query("hybrid_search_agg08", HYBRID + "WHERE place <= 20")
def hybrid_search(spark, sf_dir):
    return hybrid(spark, sf_dir, 0, 20)


@query("hybrid_page_ord04", HYBRID + "WHERE place > 20 AND place <= 40")
def hybrid_page(spark, sf_dir):
    return hybrid(spark, sf_dir, 20, 20)


@query("lexical_vec03", f"WITH {VISIBLE}, {LEXICAL} SELECT chunk_id, rank FROM lexical")
def lexical(spark, sf_dir):
    return lexical_ranks(spark, sf_dir, WORDS, visible(spark, sf_dir)).select("chunk_id", F.col("rank").cast("long"))


@query("lexical_no_words", f"WITH {VISIBLE} SELECT doc_id * 2147483648 + ordinal AS chunk_id, row_number() OVER (ORDER BY doc_id, ordinal) AS rank FROM chunks ORDER BY doc_id, ordinal LIMIT 1100")
def lexical_no_words(spark, sf_dir):
    return rt.lexical(chunks_of(visible(spark, sf_dir)), []).select("chunk_id", F.col("rank").cast("long"))


@query("vector_vec01", f"WITH {VISIBLE}, {SEMANTIC.format(near=0.65)} SELECT chunk_id, rank FROM semantic")
def vector(spark, sf_dir):
    docs = visible(spark, sf_dir)
    return rt.semantic(vectors(spark, sf_dir, docs), query_vector(spark, sf_dir)).select("chunk_id", F.col("rank").cast("long"))


def vector_index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The index of all vectors, each on the first chunk of the document of its id."""
    source = table(spark, sf_dir, "embeddings")
    return VectorIndex(spark, derived(source, "vectors", lambda folder: VectorIndex(spark, folder).build(source.select(F.col("vec_id").alias("doc_id"), F.lit(0).alias("ordinal"), "embedding"))))


@query("vector_pruned_vec01", f"WITH {VISIBLE}, {SEMANTIC.format(near=0.65)} SELECT chunk_id, rank FROM semantic")
def vector_pruned(spark, sf_dir):
    """The same search by the index, which reads the clusters that can hold something near."""
    found = rt.semantic_of(vector_index(spark, sf_dir), query_vector(spark, sf_dir), visible(spark, sf_dir))
    return found.select((F.col("doc_id") * LINES + F.col("ordinal")).alias("chunk_id"), F.col("rank").cast("long"))


@query("vector_loose_vec01", f"WITH {VISIBLE}, {SEMANTIC.format(near=1.0)} SELECT chunk_id, rank FROM semantic")
def vector_loose(spark, sf_dir):
    docs = visible(spark, sf_dir)
    return rt.semantic(vectors(spark, sf_dir, docs), query_vector(spark, sf_dir), near=1.0).select("chunk_id", F.col("rank").cast("long"))


@query("vector_valid_vec02", "SELECT vec_id, len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND len(embedding) = 64 AS valid FROM embeddings")
def vector_valid(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", rt.valid_vector(F.col("embedding"), 64).alias("valid"))


@query("visible_flt01", f"WITH {KB} SELECT doc_id, organization_id, visibility FROM kb WHERE state = 'published' AND {readable_sql(ALICE)}")
def visible_documents(spark, sf_dir):
    return visible(spark, sf_dir).select("doc_id", "organization_id", "visibility")


@query("visible_restricted_flt01", f"WITH {KB} SELECT doc_id, organization_id, visibility FROM kb WHERE state = 'published' AND {readable_sql(BOUND)}")
def visible_restricted(spark, sf_dir):
    return visible(spark, sf_dir, BOUND).select("doc_id", "organization_id", "visibility")


@query(
    "filtered_flt02_flt03_flt04",
    f"WITH {KB} SELECT doc_id, model, business_date::VARCHAR AS business_date FROM kb WHERE state = 'published' AND {readable_sql(ALICE)} AND category_id = 'en' AND lower(trim(model)) = 'ax-7' AND business_date BETWEEN DATE '2024-02-01' AND DATE '2024-11-30'",
)
def filtered(spark, sf_dir):
    return sec.matching(visible(spark, sf_dir), category="en", model=" ＡＸ-7 ", since="2024-02-01", until="2024-11-30").select("doc_id", "model", F.col("business_date").cast("string"))


@query(
    "files_search_flt05_ord03",
    f"""WITH {VISIBLE} SELECT doc_id, title, CASE WHEN lower(trim(model)) = '%an_%' THEN 2 ELSE 0 END AS rank FROM visible
    WHERE lower(title) LIKE '%an_%' OR lower(model) = '%an_%' OR doc_id IN (SELECT doc_id FROM chunks WHERE list_contains({SEGMENTED.format('text')}, 'an'))
    ORDER BY rank DESC, doc_id DESC LIMIT 26""",
)
def files_search(spark, sf_dir):
    """Wildcards of the request act as wildcards; words match any chunk of the document."""
    docs, asked = visible(spark, sf_dir), "%an_%"
    hit = chunk_index(spark, sf_dir).holding(["an"]).withColumn("hit", F.lit(True))
    found = docs.join(hit, "doc_id", "left").filter(F.lower("title").like(asked) | (F.lower("model") == asked) | F.col("hit"))
    return found.select("doc_id", "title", F.when(F.lower(F.btrim("model")) == asked, 2).otherwise(0).alias("rank")).orderBy(F.desc("rank"), F.desc("doc_id")).limit(26)


@query(
    "version_visibility_flt11",
    f"""WITH {KB} SELECT doc_id, state, CASE state WHEN 'draft' THEN organization_id IN ('src0') OR created_by = 'u7'
    WHEN 'published' THEN {readable_sql(ALICE)} ELSE organization_id IN ('src0') END AS seen FROM kb""",
)
def version_visibility(spark, sf_dir):
    docs = sec.with_grant(documents(spark, sf_dir), grants(spark, sf_dir), ALICE)
    return docs.select("doc_id", "state", sec.may_see_version(ALICE, F.col("granted"), True).alias("seen"))


@query(
    "scope_flt12",
    f"WITH {KB} SELECT doc_id FROM kb WHERE state = 'draft' AND (created_by = 'u7' OR organization_id IN ('src0')) AND (NULL::VARCHAR IS NULL OR category_id = NULL)",
)
def scope(spark, sf_dir):
    wanted = F.lit(None).cast("string")
    docs = documents(spark, sf_dir).filter((F.col("state") == "draft") & ((F.col("created_by") == ALICE.id) | F.col("organization_id").isin(ALICE.publishes)))
    return docs.filter(wanted.isNull() | (F.col("category_id") == wanted)).select("doc_id")


@query(
    "context_search",
    f"""WITH {KB}, chunks AS ({CHUNKS} FROM kb WHERE state = 'published' AND {readable_sql(ALICE)} AND category_id = 'fr') SELECT doc_id * 2147483648 + ordinal AS chunk_id FROM chunks
    WHERE len(list_filter({SEGMENTED.format('text')}, lambda t: t = 'de')) > 0 ORDER BY len(list_filter({SEGMENTED.format('text')}, lambda t: t = 'de')) DESC, chunk_id LIMIT 5""",
)
def context_search(spark, sf_dir):
    """A search within one category."""
    return lexical_ranks(spark, sf_dir, ["de"], sec.matching(visible(spark, sf_dir), category="fr"), pool=5).select("chunk_id")


@query(
    "bounded_read_win02",
    """SELECT conv_id AS doc_id, turn AS ordinal, CASE WHEN upto <= 300 THEN text END AS text, upto > 300 AS blocked FROM (
      SELECT *, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth
      FROM conversations WHERE turn >= 1 AND turn < 6) WHERE upto <= 300 OR nth = 1""",
)
def bounded_read(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ordinal"), "text")
    return rt.bounded_read(turns, F.lit(1), 5, 300)


@query(
    "page_look_ahead_ord05_snk02",
    f"WITH {KB} SELECT array_to_string(list(doc_id ORDER BY doc_id DESC)[1:10], ',') AS items, count(*) > 10 AS has_more, CASE WHEN count(*) > 10 THEN 10 END AS next_offset FROM (SELECT doc_id FROM kb WHERE state = 'draft' ORDER BY doc_id DESC LIMIT 11)",
)
def page_look_ahead(spark, sf_dir):
    """One row more than the page tells whether there is a next one."""
    rows = documents(spark, sf_dir).filter("state = 'draft'").select("doc_id").orderBy(F.desc("doc_id")).limit(11)
    listed = F.sort_array(F.collect_list("doc_id"), asc=False)
    return rows.agg(F.array_join(F.slice(listed, 1, 10), ",").alias("items"), (F.count(F.lit(1)) > 10).alias("has_more"), F.when(F.count(F.lit(1)) > 10, 10).alias("next_offset"))


@query(
    "keywords_str02_str03",
    rf"""SELECT item_id, array_to_string(list_distinct_in_order, ' ') AS words, array_to_string(list_transform(list_distinct_in_order, lambda t: '"' || t || '"'), ' OR ') AS quoted FROM (
      SELECT item_id, list_filter(seg, lambda t, i: list_position(seg, t) = i) AS list_distinct_in_order FROM (SELECT item_id, {SEGMENTED.format('text')} AS seg FROM benchmark))""",
)
def keywords(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(tx.keywords(F.col("text")), " ").alias("words"), tx.quoted_query(F.col("text")).alias("quoted"))


@query("normalized_str01")
def normalized(spark, sf_dir):
    """NFKC and full case folding, beyond SQL; held against Python in the tests."""
    from lodestore.functions.unicode import normalize

    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(normalize(F.col("text")).cast("binary"), 256).alias("normalized_sha256"))


@query(
    "reranked_by_document_win01",
    f"""WITH {VISIBLE} SELECT doc_id, ordinal, rank FROM (SELECT doc_id, ordinal, row_number() OVER (PARTITION BY doc_id ORDER BY length(text) DESC, ordinal) AS rank FROM chunks) WHERE rank <= 2""",
)
def reranked(spark, sf_dir):
    chunks = chunks_of(visible(spark, sf_dir))
    ranked = chunks.select("doc_id", "ordinal", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc(F.length("text")), "ordinal")).alias("rank"))
    return ranked.filter("rank <= 2")
