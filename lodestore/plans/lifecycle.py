"""Queries of catalog, lifecycle and queue (W3, W4)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.functions.text import generic_title_named
from lodestore.operators import lifecycle as lc
from lodestore.plans.base import KB, documents, query, table
from lodestore.streaming import timers as tm
from lodestore.streaming.timers import Leases

#: Jobs made of orders; all times are compared with one instant.
AS_OF = "1995-06-01 00:00:00"
JOBS = f"""jobs AS (SELECT o_orderkey AS job_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'complete' END AS state, (o_orderkey % 4)::INT AS attempts,
  o_orderdate + INTERVAL 2 DAY AS next_attempt_at, o_orderdate + INTERVAL 400 DAY AS lease_until, o_orderpriority LIKE '1%' AS heavy FROM orders)"""


def jobs(spark, sf_dir):
    day = lambda n: F.col("o_orderdate") + F.expr(f"INTERVAL {n} DAY")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("complete").alias("state"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempts"), day(2).alias("next_attempt_at"), day(400).alias("lease_until"), F.col("o_orderpriority").like("1%").alias("heavy"),
    )


def as_of():
    return F.lit(AS_OF).cast("timestamp_ntz")


@query("status_counts_agg01_ops07", "SELECT count(*) AS total, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS viewed, count(*) FILTER (event_type = 'click') AS click FROM events")
def status_counts(spark, sf_dir):
    kinds = {"signup": "signup", "purchase": "purchase", "error": "error", "view": "viewed", "click": "click"}
    return table(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("total"), *(F.count_if(F.col("event_type") == k).alias(n) for k, n in kinds.items()))


@query("review_counts_agg02_flt06", f"WITH {KB} SELECT count(*) FILTER (created_by = 'u0' OR organization_id = 'src0') AS total, count(*) FILTER (organization_id = 'src0' AND NOT coalesce(('{{\"r\":' || (doc_id % 20 = 0)::VARCHAR || '}}')::JSON->>'r' = 'true', false)) AS reviewable FROM kb WHERE state = 'draft'")
def review_counts(spark, sf_dir):
    review = F.parse_json(F.concat(F.lit('{"naming":{"needs_review":'), (F.col("doc_id") % 20 == 0).cast("string"), F.lit("}}")))
    needs = F.coalesce(F.variant_get(review, "$.naming.needs_review", "boolean"), F.lit(False))
    mine = F.col("organization_id") == "src0"
    return documents(spark, sf_dir).filter("state = 'draft'").agg(F.count_if((F.col("created_by") == "u0") | mine).alias("total"), F.count_if(mine & ~needs).alias("reviewable"))


@query("slots_agg03", f"WITH {JOBS} SELECT count(*) FILTER (live) AS used, count(*) FILTER (live AND heavy) AS used_heavy, count(*) FILTER (live) < 5 AS free FROM (SELECT *, state = 'running' AND lease_until >= TIMESTAMP '{AS_OF}' AS live FROM jobs)")
def slots(spark, sf_dir):
    live = (F.col("state") == "running") & (F.col("lease_until") >= as_of())
    return jobs(spark, sf_dir).agg(F.count_if(live).alias("used"), F.count_if(live & F.col("heavy")).alias("used_heavy"), (F.count_if(live) < 5).alias("free"))


CLAIM = f"""WITH {JOBS}, used AS (SELECT count(*) FILTER (live) AS u, count(*) FILTER (live AND heavy) AS uh FROM (SELECT *, state = 'running' AND lease_until >= TIMESTAMP '2003-01-01' AS live FROM jobs)),
ready AS (SELECT * FROM jobs WHERE attempts < 3 AND ((state = 'queued' AND next_attempt_at <= TIMESTAMP '2003-01-01') OR (state = 'running' AND lease_until < TIMESTAMP '2003-01-01'))),
heads AS (SELECT * FROM (SELECT * FROM ready WHERE NOT heavy ORDER BY created_at, job_id LIMIT 50) UNION ALL SELECT * FROM (SELECT * FROM ready WHERE heavy ORDER BY created_at, job_id LIMIT 20)),
numbered AS (SELECT *, sum(heavy::INT) OVER (ORDER BY created_at, job_id ROWS UNBOUNDED PRECEDING) AS nh FROM heads, used)
SELECT job_id, heavy, position FROM (SELECT *, row_number() OVER (ORDER BY created_at, job_id) AS position FROM numbered WHERE NOT heavy OR nh <= 20 - uh) WHERE position <= 50 - u"""


@query("claim_stm01_win09_flt10", CLAIM)
def claim(spark, sf_dir):
    return lc.claim(jobs(spark, sf_dir), F.lit("2003-01-01").cast("timestamp_ntz"), slots=50, heavy_slots=20).withColumn("position", F.col("position").cast("long"))


@query("expired_flt10", f"WITH {JOBS} SELECT job_id, lease_until < TIMESTAMP '{AS_OF}' AS expired, next_attempt_at <= TIMESTAMP '{AS_OF}' AS due FROM jobs WHERE state <> 'complete'")
def expired(spark, sf_dir):
    return jobs(spark, sf_dir).filter("state <> 'complete'").select("job_id", (F.col("lease_until") < as_of()).alias("expired"), (F.col("next_attempt_at") <= as_of()).alias("due"))


@query("retry_stm03_stm04", "SELECT job_id, attempts, CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END AS next_state, CASE WHEN attempts < 3 THEN least(1800, 30 * 2 ** least(greatest(attempts, 1) - 1, 6))::BIGINT ELSE 0 END AS wait FROM (SELECT o_orderkey AS job_id, (o_orderkey % 9)::INT AS attempts FROM orders)")
def retry(spark, sf_dir):
    n = (F.col("o_orderkey") % 9).cast("int")
    failed = n >= 3
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), n.alias("attempts"), F.when(failed, "failed").otherwise("queued").alias("next_state"), F.when(~failed, lc.backoff(F.greatest(n, F.lit(1)))).otherwise(0).alias("wait"))


@query("daily_budget_stm06", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS calls, count(*) > 300 AS spent FROM events GROUP BY 1")
def daily_budget(spark, sf_dir):
    day = F.window("ts", "1 day")["start"]
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.date_format(day, "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("calls"), (F.count(F.lit(1)) > 300).alias("spent"))


ANCHORED = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events WHERE {where}),
w AS (SELECT user_id, n, t AS start FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.n, CASE WHEN e.t < w.start + {us} THEN w.start ELSE e.t END FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1)
SELECT user_id, start, count(*) AS events FROM w GROUP BY user_id, start"""


@query("limiter_stm05", ANCHORED.format(where="event_type = 'error'", us=86400 * 3 * 1_000_000))
def limiter(spark, sf_dir):
    """Failures in windows anchored at the first one; three days here, as the events are sparse."""
    return lc.anchored_windows(table(spark, sf_dir, "events").filter("event_type = 'error'"), ["user_id"], "ts", 86400 * 3)


@query("failover_stm07", ANCHORED.format(where="event_type IN ('error', 'click')", us=86400 * 1_000_000))
def failover(spark, sf_dir):
    """A failover lasts from its first failure and is not extended."""
    return lc.anchored_windows(table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "click")), ["user_id"], "ts", 86400)


@query(
    "cooldown_stm07",
    """WITH e AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 12 HOUR THEN 0 ELSE 1 END AS s FROM events WHERE event_type = 'error'),
    g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS spell FROM e) SELECT user_id, spell::BIGINT AS spell, count(*) AS failures, epoch_us(max(ts) + INTERVAL 12 HOUR) AS ends FROM g GROUP BY user_id, spell""",
)
def cooldown(spark, sf_dir):
    """A cooldown is extended by every failure within it: gaps and islands."""
    by = W.partitionBy("user_id").orderBy("ts")
    errors = table(spark, sf_dir, "events").filter("event_type = 'error'").select("user_id", "ts")
    half = F.expr("INTERVAL 12 HOUR")
    marked = errors.withColumn("s", F.when(F.col("ts") <= F.lag("ts").over(by) + half, 0).otherwise(1))
    spells = marked.withColumn("spell", F.sum("s").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return spells.groupBy("user_id", "spell").agg(F.count(F.lit(1)).alias("failures"), F.unix_micros((F.max("ts") + half).cast("timestamp")).alias("ends"))


#: The events are days apart, so are these leases.
LEASES = Leases(lease=3 * 86400, most=3, wait=86400, keep=20 * 86400)


def job_events(spark, sf_dir):
    """Events as those of a job for each user; the fence they bring is the number of claims before them, up to three."""
    kind = F.col("event_type")
    action = F.when(kind == "click", "claim").when(kind == "view", "renew").when(kind == "purchase", "finish").when(kind == "error", "fail").otherwise("defer")
    before = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    events = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), action.alias("action"))
    return events.withColumn("fence", F.greatest(F.lit(1), F.least(F.lit(3), F.sum((F.col("action") == "claim").cast("long")).over(before))).cast("long"))


@query(
    "lease_timers_stm02_stm03",
    """WITH RECURSIVE a AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS sec, CASE event_type WHEN 'click' THEN 'claim' WHEN 'view' THEN 'renew' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'defer' END AS action,
        row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    e AS (SELECT *, greatest(1, least(3, sum((action = 'claim')::INT) OVER (PARTITION BY user_id ORDER BY k ROWS UNBOUNDED PRECEDING))) AS given FROM a),
    w AS (
      SELECT user_id, 0::BIGINT AS n, 0::BIGINT AS sec, '' AS action, false AS ok, 0::BIGINT AS fence, 0::BIGINT AS attempts, -1::BIGINT AS until, 0::BIGINT AS due, false AS done, NULL::BIGINT AS last, NULL::BIGINT AS told, 0::BIGINT AS told_fence, 0::BIGINT AS told_attempts FROM e WHERE n = 1
      UNION ALL
      SELECT user_id, n, sec, action, ok, CASE WHEN ok AND action = 'claim' THEN fence + 1 ELSE fence END, CASE WHEN ok AND action = 'claim' THEN attempts + 1 WHEN ok AND action = 'defer' THEN attempts - 1 ELSE attempts END,
        CASE WHEN NOT ok THEN until WHEN action IN ('claim', 'renew') THEN sec + 259200 ELSE -1 END, CASE WHEN ok AND action IN ('finish', 'fail', 'defer') THEN sec + 86400 ELSE due END,
        CASE WHEN ok AND action IN ('finish', 'fail', 'defer') THEN action = 'finish' OR (action = 'fail' AND attempts >= 3) ELSE done END, sec, told, told_fence, told_attempts
      FROM (SELECT *, CASE WHEN action = 'claim' THEN NOT done AND until < 0 AND sec >= due AND attempts < 3 ELSE until >= 0 AND given = fence END AS ok FROM (
        SELECT user_id, n, sec, action, given, told, told_fence, told_attempts, until, CASE WHEN gone THEN 0 ELSE fence END AS fence, CASE WHEN gone THEN 0 ELSE attempts END AS attempts, CASE WHEN gone THEN 0 ELSE due END AS due, NOT gone AND done AS done FROM (
          SELECT e.user_id, e.n, e.sec, e.action, e.given, w.fence, w.attempts, CASE WHEN w.until >= 0 AND w.until < e.sec THEN w.until END AS told, w.fence AS told_fence, w.attempts AS told_attempts, CASE WHEN w.until < e.sec THEN -1 ELSE w.until END AS until,
            CASE WHEN w.until >= 0 AND w.until < e.sec THEN w.until ELSE w.due END AS due, CASE WHEN w.until >= 0 AND w.until < e.sec THEN w.attempts >= 3 ELSE w.done END AS done,
            w.until < e.sec AND coalesce(CASE WHEN w.until >= 0 THEN w.until ELSE w.last END + 1728000 < e.sec, false) AS gone
          FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))))
    SELECT user_id::VARCHAR AS key, sec AS "at", action, CASE WHEN ok THEN 'accepted' ELSE 'rejected' END AS outcome, fence, attempts FROM w WHERE n > 0 UNION ALL SELECT user_id::VARCHAR, told, 'lease', 'expired', told_fence, told_attempts FROM w WHERE told IS NOT NULL""",
)
def lease_timers(spark, sf_dir):
    """Leases, retries and leases that ran out before the next event; ``streaming.timers.stream`` gives the same rows."""
    return tm.batch(job_events(spark, sf_dir), LEASES, "user_id", "ts", "event_id")


@query("fresh_stm09", "SELECT user_id, arg_max(event_id, ts) AS event_id, max(ts) >= (SELECT max(ts) FROM events) - INTERVAL 2 DAY AS fresh FROM events GROUP BY user_id")
def fresh(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    newest = events.agg(F.max("ts").alias("newest"))
    last = lc.latest(events.select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"])
    return last.crossJoin(F.broadcast(newest)).select("user_id", "event_id", (F.col("ts") >= F.col("newest") - F.expr("INTERVAL 2 DAY")).alias("fresh"))


@query("quarantine_stm10", "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 20 DAY")
def quarantine(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    newest = events.agg(F.max("ts").alias("newest"))
    return events.crossJoin(F.broadcast(newest)).filter(F.col("ts") < F.col("newest") - F.expr("INTERVAL 20 DAY")).select("event_id")


@query("ordered_json_agg04", "SELECT o_custkey, to_json(list({'k': o_orderkey, 's': o_orderstatus} ORDER BY o_orderkey))::VARCHAR AS items FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, '[]' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def ordered_json(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))))).alias("items"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")).join(per, "o_custkey", "left").select("o_custkey", F.coalesce("items", F.lit("[]")).alias("items"))


@query("filtered_array_agg05", "SELECT o_custkey, array_to_string(list_sort(list_filter(list(o_orderpriority), lambda p: NOT starts_with(p, '1'))), ',') AS kept FROM orders GROUP BY o_custkey")
def filtered_array(spark, sf_dir):
    listed = F.array_sort(F.filter(F.collect_list("o_orderpriority"), lambda p: ~F.startswith(p, F.lit("1"))))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(listed, ",").alias("kept"))


@query("distinct_agg06", "SELECT DISTINCT lang, source FROM documents")
def distinct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", "source").distinct()


@query("corpus_counts_agg07", "SELECT (SELECT count(*) FROM documents) AS documents, (SELECT coalesce(sum(n_chars), 0)::BIGINT FROM documents) AS chars, (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM conversations) AS turns")
def corpus_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))
    count = lambda name, alias: F.broadcast(table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias(alias)))
    return docs.crossJoin(count("pages", "pages")).crossJoin(count("conversations", "turns"))


@query("review_queue_ord06_joi03", f"WITH {KB} SELECT kb.doc_id, o.o_orderstatus AS job FROM kb LEFT JOIN orders o ON kb.doc_id = o.o_orderkey WHERE state = 'draft' ORDER BY CASE WHEN coalesce(o.o_orderstatus, 'F') = 'F' THEN 0 WHEN o.o_orderstatus = 'P' THEN 1 ELSE 2 END, kb.doc_id LIMIT 21")
def review_queue(spark, sf_dir):
    """Ready and idle first, then what needs review, then the rest."""
    job = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("job"))
    drafts = documents(spark, sf_dir).filter("state = 'draft'").select("doc_id").join(job, "doc_id", "left")
    return drafts.orderBy(F.when(F.coalesce("job", F.lit("F")) == "F", 0).when(F.col("job") == "P", 1).otherwise(2), "doc_id").limit(21)


@query("priorities_ord07", "SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END, o_orderkey) AS place FROM orders QUALIFY place <= 100")
def priorities(spark, sf_dir):
    state = F.col("o_orderstatus")
    order = (F.when(state == "P", 0).when(state == "O", 1).otherwise(2), F.col("o_orderkey"))
    top = table(spark, sf_dir, "orders").orderBy(*order).limit(100)
    return top.select("o_orderkey", F.row_number().over(W.orderBy(*order)).cast("long").alias("place"))


@query("fixed_order_ord08", "SELECT source, row_number() OVER (ORDER BY CASE source WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 WHEN 'src2' THEN 2 ELSE 3 END, source) AS place FROM (SELECT DISTINCT source FROM documents)")
def fixed_order(spark, sf_dir):
    """A fixed list first, the unknown last, then by name; one row an organization."""
    known = F.array(F.lit("src3"), F.lit("src1"), F.lit("src2"))
    place = F.array_position(known, F.col("source"))
    names = table(spark, sf_dir, "documents").select("source").distinct()
    return names.select("source", F.row_number().over(W.orderBy(F.when(place == 0, 99).otherwise(place), "source")).cast("long").alias("place"))


# Mutations: events are append-only, a snapshot is their fold.


@query("upserts_mut08", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def upserts(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return lc.latest(events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("idempotent_mut01", "SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id, count(DISTINCT props) > 1 AS conflict, count(*) AS requests FROM events GROUP BY user_id, event_type")
def idempotent(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "props")
    return lc.idempotent(events, ["user_id", "event_type"], ["ts", "event_id"], "props").select("user_id", "event_type", "event_id", "conflict", "requests")


@query("duplicates_mut02_win03", f"WITH {KB} SELECT k.doc_id, f.first AS duplicate_of FROM kb k JOIN (SELECT sha256(text) AS h, min(doc_id) AS first FROM kb WHERE state <> 'withdrawn' GROUP BY 1) f ON sha256(k.text) = f.h WHERE k.doc_id <> f.first")
def duplicates(spark, sf_dir):
    """The earliest document of the same content that is not withdrawn."""
    docs = documents(spark, sf_dir).select("doc_id", "state", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    firsts = docs.filter("state <> 'withdrawn'").groupBy("h").agg(F.min("doc_id").alias("duplicate_of"))
    return docs.join(firsts, "h").filter("doc_id <> duplicate_of").select("doc_id", "duplicate_of")


@query(
    "submissions_mut02",
    f"""WITH {KB}, d AS (SELECT sha256(text) AS h, min(doc_id) AS first FROM kb WHERE state <> 'withdrawn' GROUP BY 1),
    s AS (SELECT k.doc_id, CASE WHEN k.doc_id % 23 = 1 THEN 'pending' WHEN k.doc_id % 23 = 2 THEN 'submitted' ELSE 'ready' END AS upload_state, k.doc_id % 2 = 0 AS same_request, CASE WHEN d.first <> k.doc_id THEN d.first END AS duplicate_of, k.organization_id IN ('src0', 'src1', 'src2', 'src3') AS member,
      k.doc_id % 19 = 3 AS naming_pending, CASE WHEN k.doc_id % 3 <> 0 THEN k.doc_id - 1 END AS document_id, k.category_id <> 'es' AS category_known, k.doc_id % 4 AS base_revision, k.organization_id, k.category_id, k.visibility, k.model, k.business_date FROM kb k LEFT JOIN d ON sha256(k.text) = d.h)
    SELECT s.doc_id, CASE WHEN upload_state = 'pending' THEN 'upload_incomplete' WHEN upload_state = 'submitted' THEN CASE WHEN same_request THEN 'repeated' ELSE 'version_conflict' END WHEN duplicate_of IS NOT NULL THEN 'duplicate' WHEN NOT member THEN 'not_found'
      WHEN naming_pending AND document_id IS NOT NULL THEN 'invalid_argument' WHEN NOT category_known THEN 'invalid_argument' WHEN document_id IS NOT NULL AND (o.doc_id IS NULL OR o.organization_id <> s.organization_id OR o.state = 'withdrawn') THEN 'not_found'
      WHEN document_id IS NOT NULL AND (s.category_id IS DISTINCT FROM o.category_id OR s.visibility IS DISTINCT FROM o.visibility OR s.model IS DISTINCT FROM CASE WHEN s.doc_id % 2 = 0 THEN s.model ELSE o.model END OR s.business_date IS DISTINCT FROM CASE WHEN s.doc_id % 2 = 0 THEN s.business_date ELSE o.business_date END) THEN 'metadata_differs'
      WHEN document_id IS NULL AND base_revision <> 0 THEN 'invalid_argument' ELSE 'created' END AS outcome FROM s LEFT JOIN kb o ON o.doc_id = s.document_id""",
)
def submissions(spark, sf_dir):
    """Documents submitted anew, two in three as replacements of the one before; duplicates by content come first."""
    i, docs = F.col("doc_id"), documents(spark, sf_dir).withColumn("h", F.sha2(F.col("text").cast("binary"), 256))
    firsts = docs.filter("state <> 'withdrawn'").groupBy("h").agg(F.min("doc_id").alias("first"))
    asked = docs.join(firsts, "h", "left").select(
        i, F.when(i % 23 == 1, "pending").when(i % 23 == 2, "submitted").otherwise("ready").alias("upload_state"), (i % 2 == 0).alias("same_request"), F.when(F.col("first") != i, F.col("first")).alias("duplicate_of"), F.col("organization_id").isin("src0", "src1", "src2", "src3").alias("member"),
        (i % 19 == 3).alias("naming_pending"), F.when(i % 3 != 0, i - 1).alias("document_id"), (F.col("category_id") != "es").alias("category_known"), (i % 4).alias("base_revision"), "organization_id", "category_id", "visibility", "model", "business_date",
    )
    old = docs.select(i.alias("document_id"), F.lit(True).alias("doc_found"), (F.col("state") != "withdrawn").alias("doc_readable"), *(F.col(c).alias(f"doc_{c}") for c in ("organization_id", "category_id", "visibility", "model", "business_date")))
    met = asked.join(old, "document_id", "left")
    same = {f"doc_{c}": F.when(i % 2 == 0, F.col(c)).otherwise(F.col(f"doc_{c}")) for c in ("model", "business_date")}  # every second one keeps to its document
    return met.withColumns(same).select("doc_id", lc.submission_outcome(("category_id", "visibility", "model", "business_date")).alias("outcome"))


VERSION_EVENTS = "SELECT user_id % 200 AS doc, (event_id % 3)::BIGINT AS version, CASE event_type WHEN 'signup' THEN 'publish' WHEN 'purchase' THEN 'publish' WHEN 'error' THEN 'withdraw' WHEN 'view' THEN 'restore' ELSE 'reject' END AS action, ts, event_id FROM events"


@query(
    "version_fold_mut03_mut04_mut05",
    """WITH RECURSIVE e AS (SELECT user_id % 200 AS doc, event_id % 3 AS v, CASE WHEN event_type IN ('signup', 'purchase') THEN 'publish' WHEN event_type = 'error' THEN 'withdraw' WHEN event_type = 'view' THEN 'restore' ELSE 'reject' END AS action,
      CASE WHEN event_id % 5 = 0 THEN event_id % 7 END AS expected, row_number() OVER (PARTITION BY user_id % 200 ORDER BY ts, event_id) AS n FROM events),
    w AS (
      SELECT doc, 0::BIGINT AS n, 0 AS revision, -1::BIGINT AS active, NULL::VARCHAR AS s0, NULL::VARCHAR AS s1, NULL::VARCHAR AS s2, 0 AS refused FROM e WHERE n = 1
      UNION ALL
      SELECT doc, n, revision + (ok AND action <> 'reject')::INT, CASE WHEN ok AND after = 'published' THEN v WHEN ok AND action = 'withdraw' AND active = v THEN -1 ELSE active END,
        """
    + ", ".join(f"CASE WHEN v = {k} THEN CASE WHEN ok THEN after ELSE st END WHEN ok AND after = 'published' AND s{k} = 'published' THEN 'superseded' ELSE s{k} END" for k in range(3))
    + """, refused + (NOT ok)::INT
      FROM (SELECT *, (expected IS NULL OR expected = revision) AND CASE action WHEN 'publish' THEN st = 'draft' WHEN 'withdraw' THEN st = 'published' WHEN 'restore' THEN st IN ('withdrawn', 'superseded') ELSE st = 'draft' END AS ok, CASE action WHEN 'withdraw' THEN 'withdrawn' WHEN 'reject' THEN 'rejected' ELSE 'published' END AS after
        FROM (SELECT e.*, w.revision, w.active, w.s0, w.s1, w.s2, w.refused, coalesce(CASE e.v WHEN 0 THEN w.s0 WHEN 1 THEN w.s1 ELSE w.s2 END, 'draft') AS st FROM w JOIN e ON e.doc = w.doc AND e.n = w.n + 1))
    )
    SELECT doc, revision, CASE WHEN active >= 0 THEN active END AS active, refused, concat_ws(',', '0:' || s0, '1:' || s1, '2:' || s2) AS states FROM w QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC) = 1""",
)
def version_fold(spark, sf_dir):
    """Publish, withdraw, restore and reject with revision checks; the SQL follows the events of a document one by one."""
    kind = F.col("event_type")
    action = F.when(kind.isin("signup", "purchase"), "publish").when(kind == "error", "withdraw").when(kind == "view", "restore").otherwise("reject")
    events = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 200).alias("doc"), (F.col("event_id") % 3).alias("version"), action.alias("action"), F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 7).cast("int")).alias("expected"), "ts", "event_id"
    )
    return lc.versions(events, "doc", ["ts", "event_id"]).select("doc", "revision", "active", "refused", F.array_join(F.array_sort(F.transform(F.map_entries("states"), lambda e: F.concat_ws(":", e["key"], e["value"]))), ",").alias("states"))


@query("superseded_mut03", "SELECT o_orderkey, o_orderstatus = 'F' AND coalesce(max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) = 1, false) AS superseded FROM orders")
def superseded(spark, sf_dir):
    return lc.running(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], F.col("o_orderstatus") == "F").select("o_orderkey", "superseded")


@query("renames_mut06_mut10", f"WITH {KB}, r AS (SELECT user_id AS doc_id, arg_max('E' || event_id, (ts, event_id)) AS title FROM events WHERE event_type = 'click' GROUP BY user_id), gone AS (SELECT DISTINCT user_id AS doc_id FROM events WHERE event_type = 'signup' AND value > 90) SELECT kb.doc_id, coalesce(r.title, kb.title) AS title FROM kb LEFT JOIN r USING (doc_id) WHERE kb.doc_id NOT IN (SELECT doc_id FROM gone)")
def renames(spark, sf_dir):
    """The last rename wins, deletions remove."""
    events = table(spark, sf_dir, "events")
    names = lc.latest(events.filter("event_type = 'click'").select(F.col("user_id").alias("doc_id"), "ts", "event_id"), ["doc_id"], ["ts", "event_id"]).select("doc_id", F.concat(F.lit("E"), "event_id").alias("name"))
    gone = events.filter("event_type = 'signup' and value > 90").select(F.col("user_id").alias("doc_id")).distinct()
    docs = documents(spark, sf_dir).select("doc_id", "title").join(gone, "doc_id", "left_anti").join(names, "doc_id", "left")
    return docs.select("doc_id", F.coalesce("name", "title").alias("title"))


@query("chunk_edits_mut07", "WITH e AS (SELECT user_id AS conv_id, (event_id % 4)::BIGINT AS turn, arg_max('edited ' || event_id, (ts, event_id)) AS text FROM events WHERE event_type = 'view' GROUP BY 1, 2) SELECT c.conv_id, c.turn, coalesce(e.text, c.text) AS text, e.text IS NOT NULL AS edited FROM conversations c LEFT JOIN e USING (conv_id, turn)")
def chunk_edits(spark, sf_dir):
    events = table(spark, sf_dir, "events").filter("event_type = 'view'").select(F.col("user_id").alias("conv_id"), (F.col("event_id") % 4).alias("turn"), "ts", "event_id")
    edits = lc.latest(events, ["conv_id", "turn"], ["ts", "event_id"]).select("conv_id", "turn", F.concat(F.lit("edited "), "event_id").alias("new"))
    return table(spark, sf_dir, "conversations").join(edits, ["conv_id", "turn"], "left").select("conv_id", "turn", F.coalesce("new", "text").alias("text"), F.col("new").isNotNull().alias("edited"))


@query("memberships_mut09", "SELECT c_custkey, list_last AS organization, CASE WHEN organization_was = 'BUILDING' AND list_last = 'BUILDING' THEN 'publisher' ELSE 'member' END AS role FROM (SELECT c_custkey, c_mktsegment AS organization_was, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'DEFAULT' END AS list_last FROM customer)")
def memberships(spark, sf_dir):
    """A replaced membership keeps the publisher's role where the organization stays."""
    new = F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("DEFAULT")
    return table(spark, sf_dir, "customer").select("c_custkey", new.alias("organization"), F.when((F.col("c_mktsegment") == "BUILDING") & (new == "BUILDING"), "publisher").otherwise("member").alias("role"))


@query("families_mut11", "SELECT user_id, min(ts) FILTER (n = 2) IS NOT NULL AS revoked, count(*) AS uses FROM (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) GROUP BY user_id")
def families(spark, sf_dir):
    """The second use of a one-use credential revokes its family."""
    n = F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    used = table(spark, sf_dir, "events").select("user_id", n.alias("n"))
    return used.groupBy("user_id").agg((F.max("n") >= 2).alias("revoked"), F.count(F.lit(1)).alias("uses"))


@query("generation_snk01_joi02", f"WITH {KB}, c AS (SELECT doc_id, unnest([0, 1]) AS generation, text FROM kb) SELECT c.doc_id, c.generation, length(c.text) AS n FROM c JOIN kb ON c.doc_id = kb.doc_id AND c.generation = kb.doc_id % 2")
def generation(spark, sf_dir):
    """Chunks of the active generation only."""
    docs = documents(spark, sf_dir)
    chunks = docs.select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("generation"), F.length("text").alias("n"))
    return chunks.join(docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("generation")), ["doc_id", "generation"])


@query(
    "publish_gates_mut03",
    """WITH v AS (SELECT doc_id, (doc_id % 3)::INT AS expected, (doc_id % 3)::INT AS base, CASE WHEN doc_id % 19 = 0 THEN 9 ELSE (doc_id % 3)::INT END AS revision, CASE WHEN doc_id % 10 = 1 THEN 'superseded' ELSE 'draft' END AS state,
      doc_id % 7 = 3 AS needs_review, doc_id % 4 = 0 AS reviewed, CASE doc_id % 6 WHEN 0 THEN '.dwg' WHEN 1 THEN '.dxf' ELSE '.pdf' END AS suffix, CASE doc_id % 5 WHEN 0 THEN 'queued' WHEN 1 THEN NULL ELSE 'complete' END AS job_state,
      CASE doc_id % 8 WHEN 0 THEN 'partial' WHEN 1 THEN 'stored_only' WHEN 2 THEN 'failed' ELSE 'ready' END AS processing, doc_id % 9 <> 2 AS title_ok, doc_id % 16 = 2 AS accepts FROM documents)
    SELECT doc_id, CASE WHEN expected <> revision OR base <> revision THEN 'revision_conflict' WHEN state <> 'draft' THEN 'version_conflict' WHEN needs_review THEN 'naming_review' WHEN NOT title_ok AND NOT reviewed THEN 'generic_title'
      WHEN suffix IN ('.dwg', '.dxf') AND (job_state IS DISTINCT FROM 'complete' OR processing = 'failed') THEN 'drawing_incomplete' WHEN processing IN ('partial', 'failed') AND NOT accepts THEN 'incomplete' WHEN processing = 'ready' THEN 'content' ELSE 'file_only' END AS outcome FROM v""",
)
def publish_gates(spark, sf_dir):
    """Every gate in turn; titles are generic where their type is (FLT07)."""
    i = F.col("doc_id")
    pick = lambda n, values, other: reduce(lambda c, v: c.when(i % n == v[0], v[1]), values[1:], F.when(i % n == values[0][0], values[0][1])).otherwise(other)
    revision = (i % 3).cast("int")
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", revision.alias("expected"), revision.alias("base"), F.when(i % 19 == 0, 9).otherwise(revision).alias("revision"), pick(10, [(1, "superseded")], "draft").alias("state"), (i % 7 == 3).alias("needs_review"),
        (i % 4 == 0).alias("reviewed"), pick(6, [(0, ".dwg"), (1, ".dxf")], ".pdf").alias("suffix"), pick(5, [(0, "queued"), (1, None)], "complete").alias("job_state"),
        pick(8, [(0, "partial"), (1, "stored_only"), (2, "failed")], "ready").alias("processing"), F.concat(F.lit("Kiln_"), F.when(i % 9 == 2, "资料").otherwise("图纸"), F.lit(".pdf")).alias("title"), (i % 16 == 2).alias("accepts"),
    )
    return rows.select("doc_id", lc.publish_outcome(~generic_title_named(F.col("title")), F.col("accepts")).alias("outcome"))


@query(
    "challenges_ops09",
    "SELECT event_id FROM events WHERE event_type = 'click' AND ts + INTERVAL 3 DAY >= (SELECT max(ts) FROM events) AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) > 2)",
)
def challenges(spark, sf_dir):
    """Clicks as challenges of three days, errors as failures of their users."""
    events = table(spark, sf_dir, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0]).cast("timestamp_ntz")
    limits = events.filter("event_type = 'error'").groupBy(F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("failures"))
    opened = events.filter("event_type = 'click'").select("event_id", F.col("user_id").alias("key"), (F.col("ts") + F.expr("INTERVAL 3 DAYS")).alias("expires_at"))
    return lc.live_challenges(opened, limits, now, most=2).select("event_id")


@query("promotions_mut10", "SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN 'W' || o_custkey || substr(t, length('P' || o_custkey) + 1) ELSE t END AS title, CASE WHEN o_custkey % 5 = 0 THEN 'P' || o_custkey END AS former FROM (SELECT o_orderkey, o_custkey, 'P' || o_custkey || '_' || o_orderpriority AS t FROM orders)")
def promotions(spark, sf_dir):
    """A project's promotion reaches all documents linked to it."""
    k = F.col("o_custkey")
    linked = table(spark, sf_dir, "orders").select("o_orderkey", k.alias("project_id"), F.concat(F.lit("P"), k, F.lit("_"), "o_orderpriority").alias("title"))
    promoted = table(spark, sf_dir, "customer").filter("c_custkey % 5 = 0").select(F.col("c_custkey").alias("project_id"), F.concat(F.lit("P"), "c_custkey").alias("previous"), F.concat(F.lit("W"), "c_custkey").alias("official"))
    return lc.promoted(linked, promoted).select("o_orderkey", "title", "former")
