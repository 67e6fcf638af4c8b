"""The corpus of references for naming, and the search in it (NAM02, ORD09).

A reference fits filenames if a folded value of it stands within them (or they within it), or if they share identifiers.
Either needs a key in common, so references are proposed by an index and only proposals are scored: what stands within
the other is one of its stretches of that length, so both are joined on digests of stretches. Few pairs are proposed that
do not fit, however many values there are. References of the same value differ in place alone, so of each value only
as many as can be chosen are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.functions.text import fold, shared_identifiers
from lodestore.operators.security import Principal

PROJECTS, DOCUMENTS, LEAST, NEWEST = 12, 6, 2, 500
#: Letters of the shortest value that counts within a source, and of the shortest source that counts within a value.
VALUE, SOURCE = 4, 6


def corpus(documents: DataFrame, who: Principal, organization: str, newest: int = NEWEST) -> DataFrame:
    """Of documents (``state``, ``created_by``, ``visibility``, ``organization_id``, ``created_at``, ``needs_review``) those by
    which names of an organization are judged: published, or own drafts (all drafts, for a publisher) that need no
    review; visible in the department or own; the newest ones only. ``position`` counts from the newest (NAM02)."""
    publisher = F.lit(organization in who.publishes)
    mine = F.col("created_by") == who.id
    known = (F.col("state") == "published") | ((F.col("state") == "draft") & (mine | publisher) & ~F.coalesce("needs_review", F.lit(False)))
    seen = (F.col("visibility") == "department") | mine | publisher
    order = (F.desc("created_at"), F.asc("doc_id"))
    best = documents.filter((F.col("organization_id") == organization) & known & seen).orderBy(*order).limit(newest)
    return best.withColumn("position", F.row_number().over(W.orderBy(*order)).cast("long"))


def _identifiers(text: Column) -> Column:
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9-]{4,}"), F.lit(0)), lambda t: t.rlike("[0-9]")))


def _lengths(folded: DataFrame, least: int) -> list[int]:
    """The different lengths, from ``least`` on, of the texts ``folded``: as many as the longest has letters at most."""
    size = F.length("folded").alias("size")
    return sorted(r["size"] for r in folded.select(size).distinct().filter(F.col("size") >= least).collect())


def _stretches(text: Column, lengths: list[int]) -> Column:
    """Digests of all stretches of a text that have one of the lengths."""
    n = F.length(text)
    known = F.array(*(F.lit(k) for k in lengths)).cast("array<int>")
    of = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.xxhash64(F.substr(text, i, k)))
    return F.array_distinct(F.flatten(F.transform(F.filter(known, lambda k: k <= n), of)))


def value_score(value: Column, source: Column) -> Column:
    """100 and up to 40 where the folded value, of four letters at least, is within the source, or the source, of six at
    least, within it; else ten for each identifier that both have."""
    term, folded = fold(value), fold(source)
    within = (F.length(term) >= VALUE) & (F.contains(folded, term) | (F.contains(term, folded) & (F.length(folded) >= SOURCE)))
    return F.greatest(F.when(within, 100 + F.least(F.length(term), F.lit(40))).otherwise(0), 10 * F.size(shared_identifiers(value, source)))


def listed_values(references: DataFrame, projects: int = PROJECTS, documents: int = DOCUMENTS) -> DataFrame:
    """``value``, ``is_project``, ``refs`` (position, id): of each value the first references, as many as can be chosen.

    Of references of one value those behind have the same score by it and a later place, so only another value could
    have them chosen.
    """
    each = references.select("reference_id", "is_project", "position", F.explode(F.array_distinct(F.array_compact("values"))).alias("value")).filter("value <> ''")
    nth = F.row_number().over(W.partitionBy("value", "is_project").orderBy("position", "reference_id"))
    first = each.withColumn("_nth", nth).filter(F.col("_nth") <= max(projects, documents)).filter(F.col("_nth") <= F.when(F.col("is_project"), projects).otherwise(documents))
    return first.groupBy("value", "is_project").agg(F.collect_list(F.struct("position", "reference_id")).alias("refs"))


def proposed(requests: DataFrame, values: DataFrame) -> DataFrame:
    """Distinct pairs (``request_id``, ``value``) that have a key in common; every pair of a score above 0 is among them.

    Joins are merges here and in ``selected``: what a table becomes when its texts are taken apart is many times the size
    of its files, by which the planner would have it broadcast through the driver.
    """
    known = values.select("value", fold(F.col("value")).alias("folded")).distinct()
    asked = requests.select("request_id", fold(F.col("source")).alias("folded"), "source")
    whole = lambda df, name, least: df.filter(F.length("folded") >= least).select(name, F.xxhash64("folded").alias("key"))
    parts = lambda df, name, lengths: df.select(name, F.explode(_stretches(F.col("folded"), lengths)).alias("key"))
    value_in_source = parts(asked, "request_id", _lengths(known, VALUE)).join(whole(known, "value", VALUE).hint("merge"), "key").select("request_id", "value")
    source_in_value = whole(asked, "request_id", SOURCE).join(parts(known, "value", _lengths(asked, SOURCE)).hint("merge"), "key").select("request_id", "value")
    tokens = lambda df, key, text: df.select(key, F.explode(_identifiers(F.col(text))).alias("token"))
    sharing = tokens(asked, "request_id", "source").join(tokens(known, "value", "value").hint("merge"), "token").select("request_id", "value")
    return value_in_source.unionByName(source_in_value).unionByName(sharing).distinct()


def selected(requests: DataFrame, references: DataFrame, projects: int = PROJECTS, documents: int = DOCUMENTS, least: int = LEAST) -> DataFrame:
    """For each request (``request_id``, ``source``) its references (``reference_id``, ``is_project``, ``position``,
    ``values``): the best projects, the best documents, and, where fewer than ``least`` of these score, the first documents
    of all. Returns ``request_id``, ``reference_id``, ``is_project``, ``score``; equal scores go by position."""
    values = listed_values(references, projects, documents)
    scored = proposed(requests, values).join(requests.select("request_id", "source").hint("merge"), "request_id").withColumn("score", value_score(F.col("value"), F.col("source"))).filter("score > 0").drop("source")
    hits = scored.join(values.hint("merge"), "value").select("request_id", "is_project", "score", F.inline("refs")).withColumn("fills", F.lit(False))
    first = references.filter("NOT is_project").orderBy("position", "reference_id").limit(least).select("reference_id", "position").collect()
    if first:
        kind = references.schema
        fill = F.array(*(F.struct(F.lit(r["position"]).cast(kind["position"].dataType).alias("position"), F.lit(r["reference_id"]).cast(kind["reference_id"].dataType).alias("reference_id")) for r in first))
        hits = hits.unionByName(requests.select("request_id", F.lit(False).alias("is_project"), F.lit(0).alias("score"), F.inline(fill), F.lit(True).alias("fills")))
    each = hits.groupBy("request_id", "is_project", "reference_id", "position").agg(F.max("score").alias("score"), F.bool_or("fills").alias("fills"))
    kind = W.partitionBy("request_id", "is_project")
    most = F.when(F.col("is_project"), projects).otherwise(documents)
    best = (F.col("score") > 0) & (F.row_number().over(kind.orderBy(F.desc("score"), "position", "reference_id")) <= most)
    ranked = each.withColumn("_best", best).withColumn("_n", F.least(F.count_if(F.col("score") > 0).over(kind), most))
    kept = ranked.filter(F.col("_best") | (F.col("fills") & (F.col("_n") < least)))
    return kept.select("request_id", "reference_id", "is_project", F.when(F.col("_best"), F.col("score")).otherwise(0).alias("score"))
