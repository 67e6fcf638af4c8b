"""Lifecycle as a fold of append-only events: later events win, conflicts are flags and not exceptions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.functions.text import renamed


def latest(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last event of every key (MUT08): an aggregate, so a key of many events is reduced before it is shuffled."""
    rest = [c for c in events.columns if c not in key]
    state = F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("_state")
    return events.groupBy(*key).agg(state).select(*key, *(F.col(f"_state.{c}").alias(c) for c in rest))


def first(events: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first event of every key: uploads by idempotency key, one-use credentials (MUT01, IDN06, WIN03)."""
    rest = [c for c in events.columns if c not in key]
    state = F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("_state")
    return events.groupBy(*key).agg(state).select(*key, *(F.col(f"_state.{c}").alias(c) for c in rest))


def idempotent(requests: DataFrame, key: list[str], order: list[str], digest: str) -> DataFrame:
    """The first request of every key, and whether another one differs from it (MUT01)."""
    return first(requests, key, order).join(requests.groupBy(*key).agg((F.countDistinct(digest) > 1).alias("conflict"), F.count(F.lit(1)).alias("requests")), key)


#: What may follow from which state.
STEPS = {"publish": ("draft", "published"), "withdraw": ("published", "withdrawn"), "restore": ("withdrawn", "published"), "reject": ("draft", "rejected")}


def versions(events: DataFrame, document: str, order: list[str]) -> DataFrame:
    """State of every version (``version``, ``action``, ``expected`` revision) after its document's events (MUT03-05).

    A fold over the ordered events of a document: a step that does not fit the version's state, or whose expected
    revision is not the document's, is refused. Publishing supersedes the version published before; both it and
    restoring and withdrawing raise the revision. The array of one document's events is in one row.
    """
    entry = F.struct(*order, "version", "action", "expected")
    grouped = events.groupBy(document).agg(F.array_sort(F.collect_list(entry)).alias("_events"))
    start = F.struct(
        F.lit(0).alias("revision"), F.lit(-1).cast("long").alias("active"), F.map_from_arrays(F.array().cast("array<bigint>"), F.array().cast("array<string>")).alias("states"), F.lit(0).alias("refused")
    )

    def step(s: Column, e: Column) -> Column:
        state = F.coalesce(F.element_at(s["states"], e["version"]), F.lit("draft"))
        known = F.lit(False)
        for action, (before, _) in STEPS.items():
            also = (state == "superseded") if action == "restore" else F.lit(False)
            known = known | ((e["action"] == action) & ((state == before) | also))
        ok = known & ((e["expected"] == s["revision"]) | e["expected"].isNull())
        after = F.when(e["action"] == "withdraw", "withdrawn").when(e["action"] == "reject", "rejected").otherwise("published")
        activates = ok & (after == "published")
        keep = F.map_filter(s["states"], lambda k, v: k != e["version"])
        superseded = F.transform_values(keep, lambda k, v: F.when(activates & (v == "published"), "superseded").otherwise(v))
        new = F.map_concat(superseded, F.map_from_arrays(F.array(e["version"]), F.array(F.when(ok, after).otherwise(state))))
        active = F.when(activates, e["version"]).when(ok & (e["action"] == "withdraw") & (s["active"] == e["version"]), F.lit(-1).cast("long")).otherwise(s["active"])
        return F.struct(
            (s["revision"] + F.when(ok & (e["action"] != "reject"), 1).otherwise(0)).alias("revision"), active.alias("active"), new.alias("states"), (s["refused"] + F.when(ok, 0).otherwise(1)).alias("refused")
        )

    folded = grouped.select(document, F.aggregate("_events", start, step).alias("s"))
    return folded.select(document, F.col("s.revision").alias("revision"), F.nullif(F.col("s.active"), F.lit(-1)).alias("active"), F.col("s.refused").alias("refused"), F.col("s.states").alias("states"))


def running(events: DataFrame, key: str, order: list[str], published: Column) -> DataFrame:
    """The same for the common case as windows: ``superseded`` marks a published event that a later one follows (MUT03)."""
    after = W.partitionBy(key).orderBy(*order).rowsBetween(1, W.unboundedFollowing)
    return events.withColumn("superseded", published & F.coalesce(F.max(published.cast("int")).over(after) == 1, F.lit(False)))


def claimable(jobs: DataFrame, as_of: Column, most: int = 3) -> Column:
    """Queued and due, or running with a lease run out, with attempts left (FLT10, STM01)."""
    due = F.coalesce(F.col("next_attempt_at") <= as_of, F.lit(True))
    return (F.col("attempts") < most) & (((F.col("state") == "queued") & due) | ((F.col("state") == "running") & (F.col("lease_until") < as_of)))


def claim(jobs: DataFrame, as_of: Column, slots: int = 5, heavy_slots: int = 2, most: int = 3) -> DataFrame:
    """The jobs to start now (STM01): oldest first while slots are free, of heavy ones while theirs are.

    Free slots are counted in one row; what is ranked is limited to ``slots`` light and heavy jobs each, first.
    """
    live = (F.col("state") == "running") & (F.col("lease_until") >= as_of)
    used = jobs.agg(F.count_if(live).alias("used"), F.count_if(live & F.col("heavy")).alias("used_heavy"))
    order = ("created_at", "job_id")
    ready = jobs.filter(claimable(jobs, as_of, most))
    heads = ready.filter(~F.col("heavy")).orderBy(*order).limit(slots).unionByName(ready.filter("heavy").orderBy(*order).limit(heavy_slots))
    numbered = heads.crossJoin(F.broadcast(used)).withColumn("nth_heavy", F.sum(F.col("heavy").cast("int")).over(W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    fits = numbered.filter(~F.col("heavy") | (F.col("nth_heavy") <= heavy_slots - F.col("used_heavy")))
    return fits.withColumn("position", F.row_number().over(W.orderBy(*order))).filter(F.col("position") <= slots - F.col("used")).select("job_id", "heavy", "position")


def backoff(attempts: Column) -> Column:
    """Seconds: 30, doubled with every attempt, at most 1800 (STM04)."""
    return F.least(F.lit(1800), F.lit(30) * F.pow(F.lit(2), F.least(attempts - 1, F.lit(6)))).cast("long")


def anchored_windows(events: DataFrame, key: list[str], at: str, seconds: int) -> DataFrame:
    """Windows that begin with the first event after the last one ended, per key (STM05, STM07): not tumbling ones.

    A fold over the ordered times of a key.
    """
    times = events.groupBy(*key).agg(F.array_sort(F.collect_list(F.unix_micros(F.col(at).cast("timestamp")))).alias("_t"))
    empty = F.array().cast("array<struct<start:bigint,n:bigint>>")
    one = lambda t: F.struct(t.alias("start"), F.lit(1).cast("long").alias("n"))

    def step(done: Column, t: Column) -> Column:
        last = F.element_at(done, -1)
        inside = (F.size(done) > 0) & (t < last["start"] + seconds * 1_000_000)
        grown = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), (last["n"] + 1).alias("n"))))
        return F.when(inside, grown).otherwise(F.concat(done, F.array(one(t))))

    return times.select(*key, F.inline(F.aggregate("_t", empty, lambda s, t: F.when(F.size(s) > 0, step(s, t)).otherwise(F.array(one(t)))))).withColumnRenamed("n", "events")


def publish_outcome(title_ok: Column, accept_incomplete: Column) -> Column:
    """What asking to publish a version comes to (MUT03), from the columns ``expected``, ``base``, ``revision``, ``state``,
    ``needs_review``, ``reviewed``, ``suffix``, ``job_state`` and ``processing``; the first gate that is shut decides.

    Else ``content`` where the text is searchable, or ``file_only``.
    """
    done = F.col("processing").isin("ready", "stored_only")
    cad = F.col("suffix").isin(".dwg", ".dxf") & ~F.coalesce((F.col("job_state") == "complete") & (done | (F.col("processing") == "partial")), F.lit(False))
    return (
        F.when((F.col("expected") != F.col("revision")) | (F.col("base") != F.col("revision")), "revision_conflict").when(F.col("state") != "draft", "version_conflict")
        .when(F.col("needs_review"), "naming_review").when(~title_ok & ~F.col("reviewed"), "generic_title").when(cad, "drawing_incomplete")
        .when(~done & ~accept_incomplete, "incomplete").when(F.col("processing") == "ready", "content").otherwise("file_only")
    )


def live_challenges(challenges: DataFrame, limits: DataFrame, at: Column, most: int = 60) -> DataFrame:
    """Challenges (``key``, ``expires_at``) that stay when expired ones are deleted, and whose address has not failed more
    than ``most`` times in its window (OPS09). ``limits``: one row a key with its ``failures``."""
    blocked = limits.filter(F.col("failures") > most).select("key")
    return challenges.filter(F.col("expires_at") >= at).join(blocked, "key", "left_anti")


def promoted(documents: DataFrame, promotions: DataFrame) -> DataFrame:
    """Titles after projects got other names (MUT10): ``title`` of every document linked to a promoted project
    (``project_id``, ``previous``, ``official``) has its first part renamed; the former name stays an alias."""
    renames = promotions.select(F.col("project_id").alias("_of"), F.col("previous").alias("_previous"), F.col("official").alias("_official"))
    met = documents.join(renames, F.col("project_id") == F.col("_of"), "left")
    title = F.when(F.col("_of").isNotNull(), renamed(F.col("title"), F.col("_previous"), F.col("_official"))).otherwise(F.col("title"))
    return met.withColumn("title", title).withColumn("former", F.col("_previous")).drop("_of", "_previous", "_official")


#: What a replacement has in common with the document it replaces.
INHERITED = ("category_id", "title", "visibility", "product", "model", "project", "business_date")


def submission_outcome(fields: tuple[str, ...] = INHERITED) -> Column:
    """What becomes of a submission (MUT02), of rows with ``upload_state``, ``same_request``, ``duplicate_of``, ``member``,
    ``naming_pending``, ``document_id``, ``category_known``, ``doc_found``, ``doc_readable``, ``doc_organization_id``,
    ``organization_id``, ``base_revision``, and of each field what was asked for and, as ``doc_<field>``, what the document
    has. Checks in this order; a replacement must leave every field as it is, nulls included.
    """
    replaces = F.col("document_id").isNotNull()
    differs = reduce(lambda a, b: a | b, (~F.col(f).eqNullSafe(F.col(f"doc_{f}")) for f in fields))
    return (
        F.when(F.col("upload_state") == "pending", "upload_incomplete").when(F.col("upload_state") == "submitted", F.when(F.col("same_request"), "repeated").otherwise("version_conflict"))
        .when(F.col("duplicate_of").isNotNull(), "duplicate").when(~F.col("member"), "not_found").when(F.col("naming_pending") & replaces, "invalid_argument").when(~F.col("category_known"), "invalid_argument")
        .when(replaces & ~(F.coalesce("doc_found", F.lit(False)) & F.coalesce(F.col("doc_organization_id") == F.col("organization_id"), F.lit(False)) & F.coalesce("doc_readable", F.lit(False))), "not_found")
        .when(replaces & differs, "metadata_differs").when(~replaces & (F.col("base_revision") != 0), "invalid_argument").otherwise("created")
    )
