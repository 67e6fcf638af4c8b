"""Queries of joins, sets, identities, resolution and integrity (W3, W5, W6)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.functions import contract
from lodestore.operators import identity as ident
from lodestore.operators import integrity as it
from lodestore.operators import merkle as mk
from lodestore.operators import naming as nm
from lodestore.operators import resolve as rs
from lodestore.operators import security as sec
from lodestore.plans.base import ALICE, KB, chunks_of, documents, grants, query, readable_sql, table
from lodestore.plans.text import FOLD, names
from lodestore.sources.commits import kept


@query("star_joi01", "SELECT c.c_custkey, n.n_name, count(*) AS orders, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY ALL")
def star(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    per = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return per.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "orders", "total")


@query("semi_joi04", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')")
def semi(spark, sf_dir):
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(open_, "c_custkey", "left_semi")


@query("anti_joi05", "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def anti(spark, sf_dir):
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(large, "c_custkey", "left_anti")


@query("self_join_joi06", "SELECT a.c_custkey, b.c_name AS creator, n.n_name AS identity FROM customer a LEFT JOIN customer b ON b.c_custkey = a.c_custkey // 10 AND b.c_custkey <> a.c_custkey LEFT JOIN nation n ON n.n_nationkey = a.c_nationkey AND a.c_acctbal > 0")
def self_join(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    a, b = customer.alias("a"), customer.alias("b")
    creator = a.join(b, (F.col("b.c_custkey") == F.floor(F.col("a.c_custkey") / 10)) & (F.col("b.c_custkey") != F.col("a.c_custkey")), "left")
    return creator.join(nation, (F.col("n_nationkey") == F.col("a.c_nationkey")) & (F.col("a.c_acctbal") > 0), "left").select("a.c_custkey", F.col("b.c_name").alias("creator"), F.col("n_name").alias("identity"))


@query("lateral_suffix_joi07", "SELECT DISTINCT o_orderkey FROM orders, (SELECT unnest(['LOW', 'URGENT']) AS key) WHERE right(o_orderpriority, length(key) + 1) = '-' || key AND NOT (o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linenumber = 5))")
def lateral_suffix(spark, sf_dir):
    keys = F.explode(F.array(F.lit("LOW"), F.lit("URGENT")))
    fifth = table(spark, sf_dir, "lineitem").filter("l_linenumber = 5").select(F.col("l_orderkey").alias("o_orderkey"), F.lit(True).alias("fifth")).distinct()
    hits = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", keys.alias("key")).filter(F.endswith("o_orderpriority", F.concat(F.lit("-"), "key")))
    return hits.join(fifth, "o_orderkey", "left").filter(~((F.col("o_orderstatus") == "F") & F.col("fifth").isNull())).select("o_orderkey").distinct()


@query("draft_projects_joi08_flt14", "WITH p AS (SELECT p_partkey, p_name || ' ' || p_partkey % 1500 AS name FROM part), d AS (SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN name WHEN 1 THEN name || ', north' ELSE 'other ' || name END || '_x' AS title FROM p), m AS (SELECT d.doc_id, p.p_partkey AS project_id FROM d JOIN p ON split_part(d.title, '_', 1) = p.name OR starts_with(split_part(d.title, '_', 1), p.name || ',')) SELECT doc_id, min(project_id) AS project_id FROM m GROUP BY doc_id HAVING count(*) = 1")
def draft_projects(spark, sf_dir):
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    part = part.select("p_partkey", F.concat_ws(" ", "p_name", F.col("p_partkey") % 1500).alias("name"))
    title = F.concat(F.when(k == 0, F.col("name")).when(k == 1, F.concat("name", F.lit(", north"))).otherwise(F.concat(F.lit("other "), "name")), F.lit("_x"))
    return rs.linked_drafts(part.select(F.col("p_partkey").alias("doc_id"), title.alias("title")), part.select("name", F.col("p_partkey").alias("project_id")))


@query("links_joi15", f"WITH {KB} SELECT kb.doc_id * 3 % 997 AS link, doc_id FROM kb WHERE state = 'published' AND {readable_sql(ALICE)} ORDER BY link, doc_id LIMIT 50")
def links(spark, sf_dir):
    """Link targets that may be read, at most fifty."""
    seen = sec.visible(documents(spark, sf_dir), grants(spark, sf_dir), ALICE)
    return seen.select((F.col("doc_id") * 3 % 997).alias("link"), "doc_id").orderBy("link", "doc_id").limit(50)


@query("fact_scores_agg14", f"WITH {KB}, f AS (SELECT doc_id AS fact_id, category_id AS file, doc_id, CASE WHEN doc_id % 3 <> 0 THEN CASE doc_id % 3 WHEN 1 THEN 'The ' ELSE 'and in' END END AS has, CASE WHEN doc_id % 3 = 0 THEN 'que' END AS lacks FROM kb), s AS (SELECT f.file, CASE WHEN has IS NOT NULL THEN contains(t, lower(regexp_replace(has, '\\s+', '', 'g'))) ELSE NOT contains(t, lacks) END AS passed FROM f JOIN (SELECT doc_id, lower(regexp_replace(text, '\\s+', '', 'g')) AS t FROM kb) USING (doc_id)) SELECT file, count(*) FILTER (passed) AS passed, count(*) AS total, round(100 * count(*) FILTER (passed) / count(*)::DOUBLE, 2) AS percent, round(100 * count(*) FILTER (passed) / count(*)::DOUBLE, 2) > 95 AS qualified FROM s GROUP BY file")
def fact_scores(spark, sf_dir):
    docs, k = documents(spark, sf_dir), F.col("doc_id") % 3
    facts = docs.select(F.col("doc_id").alias("fact_id"), F.col("category_id").alias("file"), "doc_id", F.when(k == 1, "The ").when(k == 2, "and in").alias("contains"), F.when(k == 0, "que").alias("excludes"))
    return it.score_files(it.score_facts(facts, chunks_of(docs), "doc_id"))


@query("percentiles_agg15_agg16", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(median(value), 9) AS median FROM events GROUP BY event_type")
def percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(it.nearest_rank("value", 0.5).alias("p50"), it.nearest_rank("value", 0.95).alias("p95"), it.nearest_rank("value", 0.99).alias("p99"), F.round(F.median("value"), 9).alias("median"))


@query("acceptance_agg17_agg18", "SELECT user_id % 10 AS worker, round(avg(CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0.0 END), 9) AS correct, round(max(value), 6) AS peak, bool_or(event_type = 'purchase') AS seen, count(DISTINCT event_type) = 5 AS balanced FROM events GROUP BY 1")
def acceptance(spark, sf_dir):
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("worker")).agg(
        F.round(F.avg(F.when(kind != "error", 1.0).otherwise(0.0)), 9).alias("correct"), F.round(F.max("value"), 6).alias("peak"), F.bool_or(kind == "purchase").alias("seen"), (F.countDistinct(kind) == 5).alias("balanced")
    )


@query("hits_agg17", "WITH b AS (SELECT item_id, left(text, 40) AS head FROM benchmark), h AS (SELECT item_id, min(doc_id) AS first FROM b JOIN documents d ON contains(d.text, b.head) GROUP BY item_id) SELECT count(*) AS items, count(h.first) AS found, round(count(h.first) / count(*)::DOUBLE, 9) AS rate FROM b LEFT JOIN h USING (item_id)")
def hits(spark, sf_dir):
    """Share of benchmark passages whose first 40 characters some document holds."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return share_held(items.select("item_id", F.left("text", F.lit(40)).alias("passage")), docs)


@query("whole_hits_agg17", "WITH h AS (SELECT item_id, min(doc_id) AS first FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id) SELECT count(*) AS items, count(h.first) AS found, round(count(h.first) / count(*)::DOUBLE, 9) AS rate FROM benchmark LEFT JOIN h USING (item_id)")
def whole_hits(spark, sf_dir):
    """Share of whole benchmark passages that some document holds."""
    return share_held(table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")), table(spark, sf_dir, "documents"))


def share_held(items, docs):
    """``items``, ``found`` and ``rate`` of passages that a text contains: joined on their rarest key, then compared.

    The first and last word of a passage may be parts of a document's words, so keys are of those between: three in a row,
    or the one or two there are. Of a passage's keys the one that fewest documents hold proposes documents; one that
    none holds proves that the passage is nowhere. Keys are joined by digests, and the few that documents have in common
    with passages are written once. Only passages of one or two words are compared with all documents.
    """
    words = F.split("passage", " ")
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    run = lambda w, i, k: F.xxhash64(*(F.get(w, i + j) for j in range(k)))
    runs = lambda w, k: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: run(w, i, k))
    listed = items.select("item_id", "passage", inner.alias("w"))  # a column, or each step of the lambda would split again
    of = lambda w, ks: F.flatten(F.array(*(F.when(F.size(w) >= k, runs(w, k)).otherwise(F.array().cast("array<bigint>")) for k in ks)))
    keyed = listed.filter(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(3)))
    sizes = sorted(r["k"] for r in keyed.select("k").distinct().collect())  # of 1, 2, 3; runs of no other size are looked for
    keyed = keyed.select("item_id", "passage", F.explode(F.array_distinct(F.when(F.col("k") == 3, runs(F.col("w"), 3)).when(F.col("k") == 2, runs(F.col("w"), 2)).otherwise(runs(F.col("w"), 1)))).alias("key"))
    split = docs.select("doc_id", F.split("text", " ").alias("w"))
    met = split.select("doc_id", F.explode(of(F.col("w"), sizes)).alias("key")) if sizes else split.select("doc_id", F.lit(0).cast("long").alias("key")).limit(0)
    met = kept(met.join(keyed.select("key").distinct(), "key", "left_semi").distinct(), "met")
    often = met.groupBy("key").agg(F.count("*").alias("n"))
    rarest = keyed.join(often, "key", "left").groupBy("item_id", "passage").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("key"))).alias("r")).filter("r.n > 0")
    near = met.join(rarest.select("item_id", "passage", F.col("r.key").alias("key")), "key")
    found = docs.select("doc_id", "text").join(near, "doc_id").filter(F.contains("text", "passage")).select("item_id")
    few = docs.select("text").join(listed.filter(F.size("w") == 0).select("item_id", "passage"), F.contains("text", "passage")).select("item_id")
    found = found.unionByName(few).distinct().withColumn("hit", F.lit(1))
    return items.join(found, "item_id", "left").agg(F.count(F.lit(1)).alias("items"), F.count("hit").alias("found"), F.round(F.count("hit") / F.count(F.lit(1)), 9).alias("rate"))


@query("fingerprint_agg19", "SELECT 'region' AS table_name, count(*) AS n_rows, sum(('0x' || substr(sha256('{\"r_name\":\"' || r_name || '\",\"r_regionkey\":' || r_regionkey || '}'), 1, 15))::BIGINT)::VARCHAR AS digest FROM region")
def fingerprint(spark, sf_dir):
    return it.table_fingerprint(table(spark, sf_dir, "region").select("r_name", "r_regionkey"), "region")


@query("cardinality_agg21", "SELECT count(DISTINCT o_orderkey) = count(*) AS all_found, count(*) FILTER (o_orderstatus = 'P') > 0 AS one_left FROM orders")
def cardinality(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg((F.countDistinct("o_orderkey") == F.count(F.lit(1))).alias("all_found"), (F.count_if(F.col("o_orderstatus") == "P") > 0).alias("one_left"))


@query("reconcile_joi14_set04_snk03_ops05", "WITH r AS (SELECT doc_id AS path, n_chars AS size, md5(text) AS sha FROM documents WHERE doc_id % 7 <> 0), f AS (SELECT doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN n_chars + 1 ELSE n_chars END AS size, CASE WHEN doc_id % 5 = 0 THEN md5(text || '!') ELSE md5(text) END AS sha FROM documents WHERE doc_id % 13 <> 0) SELECT coalesce(r.path, f.path)::VARCHAR AS path, CASE WHEN r.sha IS NULL THEN 'unreferenced' WHEN f.sha IS NULL THEN 'missing' WHEN r.size <> f.size THEN 'wrong_size' WHEN r.sha <> f.sha THEN 'wrong_content' ELSE 'ok' END AS status FROM r FULL JOIN f ON r.path = f.path")
def reconcile(spark, sf_dir):
    docs, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    sha = lambda c: F.md5(c.cast("binary"))
    references = docs.filter(i % 7 != 0).select(i.cast("string").alias("path"), F.col("n_chars").alias("size"), sha(F.col("text")).alias("sha256"))
    files = docs.filter(i % 13 != 0).select(i.cast("string").alias("path"), F.when(i % 11 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("size"), sha(F.when(i % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("sha256"))
    return it.reconcile(references, files)


@query("snapshots_ops03_ops04", "SELECT * FROM (VALUES ('nation', 'same'), ('region', 'changed'), ('part', 'added'), ('supplier', 'missing')) t(table_name, status)")
def snapshots(spark, sf_dir):
    of = lambda name, df=None: it.table_fingerprint(table(spark, sf_dir, name) if df is None else df, name)
    before = of("nation").unionByName(of("region")).unionByName(of("supplier"))
    after = of("nation").unionByName(of("region", table(spark, sf_dir, "region").withColumn("r_name", F.lower("r_name")))).unionByName(of("part"))
    return it.compare_snapshots(before, after, may_be_added=("part",))


@query("protected_set08", "(SELECT n_name, n_regionkey, 'before' AS side FROM (SELECT n_name, n_regionkey FROM nation EXCEPT ALL SELECT n_name, CASE WHEN n_nationkey = 3 THEN 0 ELSE n_regionkey END FROM nation)) UNION ALL (SELECT n_name, n_regionkey, 'after' AS side FROM (SELECT n_name, CASE WHEN n_nationkey = 3 THEN 0 ELSE n_regionkey END AS n_regionkey FROM nation EXCEPT ALL SELECT n_name, n_regionkey FROM nation))")
def protected(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    new = nation.select("n_name", F.when(F.col("n_nationkey") == 3, 0).otherwise(F.col("n_regionkey")).cast("int").alias("n_regionkey"))
    return it.same_rows(nation.select("n_name", F.col("n_regionkey").cast("int").alias("n_regionkey")), new)


@query("effective_set01_idn01", "WITH m AS (SELECT c_custkey AS principal_id, c_mktsegment AS organization_id, CASE WHEN c_custkey % 4 = 0 THEN 'publisher' ELSE 'member' END AS role FROM customer UNION ALL SELECT c_custkey, d, 'member' FROM customer, (SELECT unnest(['BUILDING', 'MACHINERY']) AS d)) SELECT principal_id, organization_id, max(CASE role WHEN 'publisher' THEN 2 ELSE 1 END) = 2 AS publisher FROM m GROUP BY ALL")
def effective(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    own = customer.select(F.col("c_custkey").alias("principal_id"), F.col("c_mktsegment").alias("organization_id"), F.when(F.col("c_custkey") % 4 == 0, "publisher").otherwise("member").alias("role"))
    found = sec.effective(own, ["BUILDING", "MACHINERY"], customer.select(F.col("c_custkey").alias("principal_id")))
    return found.select("principal_id", "organization_id", (F.col("role") == "publisher").alias("publisher"))


@query("scope_sets_set02", "SELECT o_custkey, array_to_string(list_sort(list_distinct(list_concat(list(DISTINCT o_orderpriority), ['5-LOW']))), ',') AS asked, len(list_filter(list(DISTINCT o_orderpriority), lambda p: p NOT IN ('5-LOW', '1-URGENT', '2-HIGH'))) = 0 AS allowed FROM orders GROUP BY o_custkey")
def scope_sets(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    mine = F.array(F.lit("5-LOW"), F.lit("1-URGENT"), F.lit("2-HIGH"))
    return per.select("o_custkey", F.array_join(F.array_sort(F.array_union("p", F.array(F.lit("5-LOW")))), ",").alias("asked"), (F.size(F.array_except("p", mine)) == 0).alias("allowed"))


@query("pages_left_set05", "SELECT page_id FROM pages WHERE contains(html, '<p') EXCEPT SELECT page_id FROM pages WHERE contains(html, '<table') INTERSECT SELECT page_id FROM pages WHERE length(html) > 500")
def pages_left(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    ids = lambda c: pages.filter(c).select("page_id")
    return ids(F.contains("html", F.lit("<p"))).exceptAll(ids(F.contains("html", F.lit("<table"))).intersect(ids(F.length("html") > 500)))


@query("union_without_known_set07", "SELECT c_custkey AS id, lower(c_name) AS key FROM customer UNION ALL SELECT s_suppkey, lower(s_name) FROM supplier WHERE replace(lower(s_name), 'supplier', 'customer') NOT IN (SELECT lower(c_name) FROM customer)")
def union_without_known(spark, sf_dir):
    """Raster text joins native text unless its squashed key is known."""
    native = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lower("c_name").alias("key"))
    raster = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("key"), F.replace(F.lower("s_name"), F.lit("supplier"), F.lit("customer")).alias("known"))
    return native.unionByName(raster.join(native.select(F.col("key").alias("known")), "known", "left_anti").select("id", "key"))


TREE = "SELECT c_custkey AS id, CASE WHEN c_custkey % 97 = 0 OR c_custkey // 3 = c_custkey THEN NULL ELSE c_custkey // 3 END AS parent FROM customer"


@query("ancestors_hie01", f"WITH RECURSIVE n AS ({TREE}), a AS (SELECT id, id AS ancestor, 0 AS depth FROM n UNION ALL SELECT a.id, n.parent, a.depth + 1 FROM a JOIN n ON a.ancestor = n.id WHERE n.parent IS NOT NULL) SELECT * FROM a")
def ancestors(spark, sf_dir):
    return sec.ancestors(tree(spark, sf_dir))


def tree(spark, sf_dir):
    up = F.floor(F.col("c_custkey") / 3)
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when((F.col("c_custkey") % 97 == 0) | (up == F.col("c_custkey")), None).otherwise(up).alias("parent"))


@query("tree_pages_hie02_win10", f"WITH RECURSIVE n AS ({TREE}), a AS (SELECT id, id AS root, parent FROM n UNION ALL SELECT a.id, n.id, n.parent FROM a JOIN n ON a.parent = n.id), r AS (SELECT id, root FROM a WHERE parent IS NULL OR parent NOT IN (SELECT id FROM n)) SELECT id, root, dense_rank() OVER (ORDER BY root) AS branch FROM r QUALIFY branch <= 3")
def tree_pages(spark, sf_dir):
    """Whole branches by their root; the rank runs over the roots, of which there are few."""
    nodes = tree(spark, sf_dir)
    up = sec.ancestors(nodes)
    known = nodes.select(F.col("id").alias("ancestor"), "parent")
    roots = up.join(known, "ancestor").join(nodes.select(F.col("id").alias("parent"), F.lit(True).alias("has")), "parent", "left").filter("has is null").select("id", F.col("ancestor").alias("root"))
    ranked = roots.select("root").distinct().select("root", F.dense_rank().over(W.orderBy("root")).cast("long").alias("branch")).filter("branch <= 3")
    return roots.join(F.broadcast(ranked), "root").select("id", "root", "branch")


@query(
    "principals_idn01",
    """WITH able AS (SELECT c_custkey AS p, CASE WHEN c_custkey % 50 = 0 THEN 'superadmin' ELSE 'user' END AS kind FROM customer WHERE c_custkey % 7 <> 1 AND c_custkey % 11 <> 2 AND (c_custkey % 3 <> 0 OR c_custkey % 2 = 0)),
    own AS (SELECT o_custkey AS p, o_orderpriority AS o, max(CASE WHEN o_orderstatus = 'P' THEN 2 ELSE 1 END) AS r FROM orders GROUP BY 1, 2),
    every AS (SELECT DISTINCT o_orderpriority AS o FROM orders)
    SELECT p AS principal_id, o AS organization_id, CASE WHEN max(r) = 2 THEN 'publisher' ELSE 'member' END AS role FROM (
      SELECT p, o, 2 AS r FROM able, every WHERE kind = 'superadmin' UNION ALL SELECT p, o, r FROM own JOIN able USING (p) WHERE kind = 'user'
      UNION ALL SELECT p, unnest(['1-URGENT', '5-LOW']) AS o, 1 AS r FROM able WHERE kind = 'user') GROUP BY p, o""",
)
def loaded_principals(spark, sf_dir):
    """Customers as accounts, orders as memberships."""
    k = F.col("c_custkey")
    accounts = table(spark, sf_dir, "customer").select(k.alias("principal_id"), F.when(k % 50 == 0, "superadmin").otherwise("user").alias("account_role"), F.when(k % 7 == 1, "disabled").otherwise("active").alias("status"), (k % 3 != 0).alias("has_password"), (k % 2 == 0).alias("bound"), (k % 11 != 2).alias("active"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("principal_id"), F.col("o_orderpriority").alias("organization_id"), F.when(F.col("o_orderstatus") == "P", "publisher").otherwise("member").alias("role"))
    return sec.load_principals(accounts, accounts, orders, orders.select("organization_id").distinct(), ["1-URGENT", "5-LOW"])


_NOW = "1996-01-01 00:00:00"
ACCOUNTS = "SELECT c_custkey AS p, CASE WHEN c_custkey % 50 = 0 THEN 'superadmin' WHEN c_custkey % 2 = 0 THEN 'manager' ELSE 'user' END AS kind, CASE WHEN c_custkey % 13 = 1 THEN 'disabled' ELSE 'active' END AS status FROM customer"
MEMBERS = "SELECT DISTINCT o_custkey AS p, o_orderpriority AS o, CASE WHEN o_orderstatus = 'P' THEN 'publisher' ELSE 'member' END AS r FROM orders"


def accounts_of(spark, sf_dir):
    k = F.col("c_custkey")
    role = F.when(k % 50 == 0, "superadmin").when(k % 2 == 0, "manager").otherwise("user")
    return table(spark, sf_dir, "customer").select(k.alias("principal_id"), role.alias("account_role"), F.when(k % 13 == 1, "disabled").otherwise("active").alias("status"))


def members_of(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("principal_id"), F.col("o_orderpriority").alias("organization_id"), F.when(F.col("o_orderstatus") == "P", "publisher").otherwise("member").alias("role")).distinct()


@query(
    "bound_identities_idn02",
    f"""WITH a AS ({ACCOUNTS}), m AS ({MEMBERS}),
    i AS (SELECT c_custkey AS p, CASE WHEN c_custkey % 17 = 3 THEN 'other' ELSE 'own' END AS company, c_custkey % 7 <> 2 AS enabled, TIMESTAMP '{_NOW}' - INTERVAL 1 HOUR * (c_custkey % 40) AS verified_at, CASE c_custkey % 5 WHEN 0 THEN [] WHEN 1 THEN ['2-HIGH', '5-LOW'] ELSE ['3-MEDIUM'] END AS orgs FROM customer WHERE c_custkey % 3 <> 0),
    s AS (SELECT a.*, i.orgs, CASE WHEN i.p IS NULL THEN CASE WHEN kind = 'superadmin' AND a.p IN (150, 300, 600) THEN 'unbound' ELSE 'none' END WHEN company = 'own' AND enabled AND verified_at > TIMESTAMP '{_NOW}' - INTERVAL 1 DAY THEN 'bound' ELSE 'none' END AS state FROM a LEFT JOIN i ON a.p = i.p),
    own AS (SELECT p, kind, unnest(list_distinct(list_concat(orgs, ['1-URGENT', '5-LOW']))) AS o FROM s WHERE state = 'bound' AND kind <> 'superadmin'),
    inside AS (SELECT p, o, CASE WHEN kind = 'manager' AND EXISTS (SELECT 1 FROM m WHERE m.p = own.p AND m.o = own.o AND r = 'publisher') THEN 'publisher' ELSE 'member' END AS r FROM own),
    more AS (SELECT p, '4-NOT SPECIFIED' AS o, 'member' AS r FROM s WHERE state = 'bound' AND kind <> 'superadmin' AND p % 4 = 0 UNION SELECT p, '1-URGENT', 'member' FROM s WHERE state = 'bound' AND kind <> 'superadmin' AND p % 6 = 0)
    SELECT p AS principal_id, o AS organization_id, r AS role, true AS bound FROM inside UNION ALL SELECT p, o, r, true FROM more WHERE (p, o) NOT IN (SELECT (p, o) FROM inside)
    UNION ALL SELECT s.p, m.o, m.r, state = 'bound' FROM s JOIN m ON s.p = m.p WHERE state <> 'none' AND kind = 'superadmin'""",
)
def bound_identities(spark, sf_dir):
    """Customers as accounts with identities that are verified up to forty hours ago; a day keeps them fresh."""
    k, now = F.col("c_custkey"), F.lit(_NOW).cast("timestamp_ntz")
    synced = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.lit("2-HIGH"), F.lit("5-LOW"))).otherwise(F.array(F.lit("3-MEDIUM")))
    identities = table(spark, sf_dir, "customer").filter(k % 3 != 0).select(
        k.alias("principal_id"), F.when(k % 17 == 3, "other").otherwise("own").alias("company"), (k % 7 != 2).alias("enabled"), (now - F.make_interval(hours=(k % 40).cast("int"))).alias("verified_at"), synced.alias("organization_ids")
    )
    every = table(spark, sf_dir, "customer").select(k.alias("principal_id"))
    extensions = every.filter("principal_id % 4 = 0").withColumn("organization_id", F.lit("4-NOT SPECIFIED")).unionByName(every.filter("principal_id % 6 = 0").withColumn("organization_id", F.lit("1-URGENT")))
    return ident.effective_identities(accounts_of(spark, sf_dir), identities, members_of(spark, sf_dir), extensions, ["1-URGENT", "5-LOW"], now, "own", 86400, [150, 300, 600])


@query(
    "invitation_status_idn05",
    f"""WITH a AS ({ACCOUNTS}), m AS ({MEMBERS}),
    i AS (SELECT o_orderkey AS id, o_custkey AS p, CASE WHEN o_orderkey % 3 = 0 THEN 50 ELSE 2 * (1 + o_orderkey % 40) END AS by, o_orderdate AS issued, o_orderkey % 11 = 5 AS used, o_orderkey % 13 = 7 AS revoked, o_orderdate + INTERVAL 2000 DAY <= TIMESTAMP '{_NOW}' AS expired FROM orders)
    SELECT id AS invitation_id, CASE WHEN used THEN 'used' WHEN revoked OR row_number() OVER (PARTITION BY i.p ORDER BY issued DESC, id DESC) > 1 THEN 'revoked' WHEN expired THEN 'expired' WHEN t.p IS NULL OR t.status = 'disabled' THEN 'disabled'
      WHEN b.status = 'active' AND (b.kind = 'superadmin' OR (b.kind = 'manager' AND t.kind = 'user' AND NOT EXISTS (SELECT 1 FROM m WHERE m.p = i.p AND m.o NOT IN (SELECT o FROM m x WHERE x.p = i.by AND x.r = 'publisher')))) THEN 'valid' ELSE 'without_authority' END AS status
    FROM i LEFT JOIN a t ON t.p = i.p LEFT JOIN a b ON b.p = i.by""",
)
def invitation_status(spark, sf_dir):
    """Orders as invitations of their customers, issued by managers and one superadmin."""
    k, now = F.col("o_orderkey"), F.lit(_NOW).cast("timestamp_ntz")
    when = lambda c: F.when(c, F.col("o_orderdate"))
    issued = table(spark, sf_dir, "orders").select(
        k.alias("invitation_id"), F.col("o_custkey").alias("principal_id"), F.when(k % 3 == 0, 50).otherwise(2 * (1 + k % 40)).cast("long").alias("created_by"), F.col("o_orderdate").alias("issued_at"), when(k % 11 == 5).alias("used_at"),
        when(k % 13 == 7).alias("revoked_at"), (F.col("o_orderdate") + F.expr("INTERVAL 2000 DAYS")).alias("expires_at"),
    )
    return ident.valid_invitations(issued, accounts_of(spark, sf_dir), members_of(spark, sf_dir), now)


@query(
    "branches_hie02_win10",
    """WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 <> 0 AND c_custkey // 3 <> c_custkey AND c_custkey // 3 IN (SELECT c_custkey FROM customer) THEN c_custkey // 3 END AS parent FROM customer),
    a AS (SELECT id, id AS root, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.id, a.root, a.depth + 1 FROM n JOIN a ON n.parent = a.id)
    SELECT id AS principal_id, root, depth, branch FROM (SELECT *, dense_rank() OVER (ORDER BY root) AS branch FROM a) WHERE branch BETWEEN 6 AND 25""",
)
def branches(spark, sf_dir):
    """Customers as accounts created by others; every tenth is a superadmin. The second page of twenty branches, after five."""
    k = F.col("c_custkey")
    accounts = table(spark, sf_dir, "customer").select(k.alias("principal_id"), F.floor(k / 3).alias("created_by"), F.when(k % 10 == 0, "superadmin").otherwise("user").alias("role"))
    return ident.branch_page(ident.branches(accounts), 5, 20).select("principal_id", "root", "depth", "branch")


@query("account_scope_flt13", "WITH m AS (SELECT o_custkey AS account_id, o_orderpriority AS o FROM orders) SELECT c_custkey AS account_id FROM customer WHERE EXISTS (SELECT 1 FROM m WHERE account_id = c_custkey AND o IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) AND NOT EXISTS (SELECT 1 FROM m WHERE account_id = c_custkey AND o NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW'))")
def account_scope(spark, sf_dir):
    accounts = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account_id"))
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("account_id"), F.col("o_orderpriority").alias("organization_id"))
    return sec.within(accounts, members, ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])


@query("tokens_idn02_idn03_idn04", "SELECT c_custkey, c_acctbal > 0 AS active, sha256(c_name) AS token FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus <> 'O' OR o_orderdate + INTERVAL 90 DAY > TIMESTAMP '1996-01-01'")
def tokens(spark, sf_dir):
    """Credentials joined on the token's digest, those without an end or with one in the future."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.sha2(F.col("c_name").cast("binary"), 256).alias("token"))
    ends = F.when(F.col("o_orderstatus") == "O", F.col("o_orderdate") + F.expr("INTERVAL 90 DAY"))
    used = table(spark, sf_dir, "orders").select("o_custkey", ends.alias("ends"))
    return customer.join(used, F.col("c_custkey") == F.col("o_custkey")).filter(F.col("ends").isNull() | (F.col("ends") > F.lit("1996-01-01").cast("timestamp_ntz"))).select("c_custkey", (F.col("c_acctbal") > 0).alias("active"), "token")


@query("invitations_idn05", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS invitation, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) = 'O' AS valid FROM orders GROUP BY o_custkey")
def invitations(spark, sf_dir):
    """Issuing revokes earlier ones: the latest of each principal, if unused."""
    from lodestore.operators.lifecycle import latest

    return latest(table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("invitation"), (F.col("o_orderstatus") == "O").alias("valid"))


@query("one_use_idn06", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS used_by FROM events WHERE event_type = 'click' GROUP BY user_id")
def one_use(spark, sf_dir):
    from lodestore.operators.lifecycle import first

    return first(table(spark, sf_dir, "events").filter("event_type = 'click'").select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("used_by"))


@query("access_codes_idn07_ord05", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'revoked' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'expired' ELSE 'active' END AS status FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 21")
def access_codes(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "P", "revoked").when(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz"), "expired").otherwise("active")
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(21).select("o_orderkey", status.alias("status"))


@query("batch_issue_idn08_idn09", "SELECT r_regionkey, n, md5(r_name || '/' || n) AS id, r_name || '-' || lpad(n::VARCHAR, 3, '0') AS name FROM region, (SELECT unnest(range(1, 13)) AS n)")
def batch_issue(spark, sf_dir):
    """Numbered credentials of a batch with ids that a replay repeats."""
    made = table(spark, sf_dir, "region").select("r_regionkey", "r_name", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("n"))
    return made.select("r_regionkey", F.col("n").cast("long").alias("n"), F.md5(F.concat_ws("/", "r_name", "n").cast("binary")).alias("id"), F.concat("r_name", F.lit("-"), F.lpad(F.col("n").cast("string"), 3, "0")).alias("name"))


@query("providers_ops01", "WITH m AS (SELECT n_nationkey AS position, n_name, n_regionkey, n_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0) AS cooling FROM nation) SELECT n_regionkey, arg_min(n_name, position) FILTER (NOT cooling) AS active, count(*) FILTER (cooling) AS cooling FROM m GROUP BY n_regionkey")
def providers(spark, sf_dir):
    """The first model of each provider that is not cooling down."""
    down = table(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(True).alias("cooling")).distinct()
    models = table(spark, sf_dir, "nation").join(down, "n_nationkey", "left").withColumn("cooling", F.coalesce("cooling", F.lit(False)))
    return models.groupBy("n_regionkey").agg(F.min_by(F.when(~F.col("cooling"), F.col("n_name")), F.when(~F.col("cooling"), F.col("n_nationkey"))).alias("active"), F.count_if("cooling").alias("cooling"))


#: Of the copies that stand in the folder already, under the names of the even parts: every fourth has other contents.
STANDING = "SELECT p_name AS name, md5(p_name || CASE WHEN p_partkey % 4 = 0 THEN '!' ELSE '' END) AS digest FROM part WHERE p_partkey % 2 = 0"


@query(
    "upload_copies_ops06",
    f"""WITH asked AS (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'con.txt' WHEN 4 THEN p_name || '?' WHEN 7 THEN p_name || ' ' ELSE p_name END AS name, md5(p_name) AS digest FROM part),
    standing AS (SELECT name, min(digest) AS low, max(digest) AS high FROM ({STANDING}) GROUP BY name)
    SELECT p_partkey, CASE WHEN regexp_matches(a.name, '[/\\:\x00-\x1f<>|?*"]') OR regexp_matches(a.name, '[ .]$') OR length(a.name) > 240 THEN 'unsafe' WHEN upper(split_part(a.name, '.', 1)) IN ('CON', 'PRN', 'AUX', 'NUL') THEN 'reserved'
      WHEN s.name IS NULL THEN 'copied' WHEN s.low = a.digest AND s.high = a.digest THEN 'identical_copy_exists' ELSE 'conflict' END AS status FROM asked a LEFT JOIN standing s ON a.name = s.name""",
)
def upload_copies(spark, sf_dir):
    """Names for copies against the folder's listing, by contents."""
    i, name = F.col("p_partkey"), F.col("p_name")
    asked = table(spark, sf_dir, "part").select(i, F.when(i % 9 == 0, "con.txt").when(i % 9 == 4, F.concat(name, F.lit("?"))).when(i % 9 == 7, F.concat(name, F.lit(" "))).otherwise(name).alias("name"), F.md5(name.cast("binary")).alias("digest"))
    standing = table(spark, sf_dir, "part").filter("p_partkey % 2 = 0").select(name.alias("name"), F.md5(F.concat(name, F.when(i % 4 == 0, "!").otherwise("")).cast("binary")).alias("digest"))
    return it.copy_status(asked, standing).select("p_partkey", "status")


@query("upload_names_ops06", r"SELECT p_partkey, CASE WHEN n IN ('CON', 'NUL', 'AUX') THEN 'reserved' WHEN regexp_matches(n, '[/\\:<>|?*]') THEN 'unsafe' WHEN p_partkey % 4 = 1 THEN 'identical' WHEN p_partkey % 4 = 2 THEN 'conflict' ELSE 'copy' END AS outcome FROM (SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'CON' WHEN 4 THEN p_name || '?' ELSE p_name END AS n FROM part)")
def upload_names(spark, sf_dir):
    i = F.col("p_partkey")
    name = F.when(i % 9 == 0, "CON").when(i % 9 == 4, F.concat("p_name", F.lit("?"))).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select(i, F.when(name.isin("CON", "NUL", "AUX"), "reserved").when(name.rlike(r"[/\\:<>|?*]"), "unsafe").when(i % 4 == 1, "identical").when(i % 4 == 2, "conflict").otherwise("copy").alias("outcome"))


@query("compliant_names_str16")
def compliant_names(spark, sf_dir):
    """The naming grammar over all titles; the tests hold it to literal rows."""
    return names(spark, sf_dir).select("p_partkey", "title", rs.compliant(F.col("title")).alias("compliant"))


#: Items of orders as text, and the same after changes: other quantities, lines gone, lines twice.
ITEMS = "SELECT CAST(l_orderkey AS VARCHAR) AS k, CAST(l_linenumber AS VARCHAR) AS line, CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) AS quantity, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price, CAST(l_shipdate AS DATE)::VARCHAR AS shipped FROM lineitem"
CHANGED = "SELECT k, line, CASE WHEN l % 997 = 5 THEN '0.00' ELSE quantity END AS quantity, price, shipped FROM (SELECT *, CAST(k AS BIGINT) AS l FROM items) WHERE l % 499 <> 7 UNION ALL SELECT * FROM items WHERE CAST(k AS BIGINT) % 1499 = 11"
MERKLE_DEPTH = 3


def items(spark, sf_dir):
    amount = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("k"), F.col("l_linenumber").cast("string").alias("line"), amount("l_quantity").alias("quantity"), amount("l_extendedprice").alias("price"), F.col("l_shipdate").cast("date").cast("string").alias("shipped")
    )


def changed_items(spark, sf_dir):
    all_, key = items(spark, sf_dir), F.col("k").cast("long")
    kept = all_.filter(key % 499 != 7).withColumn("quantity", F.when(key % 997 == 5, "0.00").otherwise(F.col("quantity")))
    return kept.unionByName(all_.filter(key % 1499 == 11))


_NODES = " UNION ALL ".join(f"SELECT {d}::INT AS depth, prefix, n_rows, digest FROM l{d}" for d in range(MERKLE_DEPTH, -1, -1))


@query(
    "merkle_agg19",
    f"""WITH items AS ({ITEMS}), r AS (SELECT sha256('{{"k":"' || k || '","line":"' || line || '","price":"' || price || '","quantity":"' || quantity || '","shipped":"' || shipped || '"}}') AS row FROM items),
    c AS (SELECT row, count(*) AS n FROM r GROUP BY row), l{MERKLE_DEPTH} AS (SELECT left(row, {MERKLE_DEPTH}) AS prefix, sum(n)::BIGINT AS n_rows, sha256(string_agg(row || ':' || n, chr(10) ORDER BY row)) AS digest FROM c GROUP BY 1), """
    + ", ".join(f"l{d} AS (SELECT left(prefix, {d}) AS prefix, sum(n_rows)::BIGINT AS n_rows, sha256(string_agg(prefix || ':' || digest, chr(10) ORDER BY prefix)) AS digest FROM l{d + 1} GROUP BY 1)" for d in range(MERKLE_DEPTH - 1, -1, -1))
    + " "
    + _NODES,
)
def merkle_tree(spark, sf_dir):
    """The digests of all ranges of ``lineitem`` and of the nodes above them."""
    return mk.tree(mk.leaves(items(spark, sf_dir), MERKLE_DEPTH), MERKLE_DEPTH)


@query(
    "merkle_changes_ops03_ops04_set08",
    f"""WITH items AS ({ITEMS}), changed AS ({CHANGED}),
    g AS (SELECT k, line, quantity, price, shipped, sum(x) AS more FROM (SELECT *, 1 AS x FROM items UNION ALL SELECT *, -1 AS x FROM changed) GROUP BY ALL HAVING sum(x) <> 0)
    SELECT CASE WHEN more > 0 THEN 'before' ELSE 'after' END AS side, abs(more)::BIGINT AS times, k, line, quantity, price, shipped FROM g""",
)
def merkle_changes(spark, sf_dir):
    """The rows by which a changed copy differs, found below the nodes that differ."""
    return mk.changes(items(spark, sf_dir), changed_items(spark, sf_dir), MERKLE_DEPTH).select("side", "times", "k", "line", "quantity", "price", "shipped")


#: Titles after the naming contract, with faults in some: an object, a business type, perhaps a topic, a date, a language, a version.
TITLES = f"""SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'scan 7' ELSE split_part(p_name, ' ', 1) END || '_' || CASE WHEN p_partkey % 7 = 3 THEN 'notes' ELSE {{types}}[1 + p_partkey % {len(contract.BUSINESS_TYPES)}] END
  || CASE p_partkey % 5 WHEN 1 THEN '_' || lower(p_brand) WHEN 2 THEN '_ZH_EN' ELSE '' END || CASE p_partkey % 4 WHEN 1 THEN '_2024' || lpad((1 + p_partkey % 14)::VARCHAR, 2, '0') || '30' WHEN 2 THEN '_20240229' ELSE '' END
  || CASE p_partkey % 3 WHEN 0 THEN '_ZH' WHEN 1 THEN '_RU' ELSE '' END || CASE p_partkey % 6 WHEN 0 THEN '_V2' WHEN 4 THEN '_r12' ELSE '' END || CASE p_partkey % 11 WHEN 0 THEN '.exe' WHEN 1 THEN '' ELSE '.PDF' END AS title FROM part"""


def titles(spark, sf_dir):
    i, when = F.col("p_partkey"), F.when
    types = F.array(*(F.lit(t) for t in contract.BUSINESS_TYPES))
    day = F.concat(F.lit("_2024"), F.lpad((1 + i % 14).cast("string"), 2, "0"), F.lit("30"))
    title = F.concat(
        when(i % 13 == 0, "scan 7").otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit("_"), when(i % 7 == 3, "notes").otherwise(F.get(types, (i % len(contract.BUSINESS_TYPES)).cast("int"))),
        when(i % 5 == 1, F.concat(F.lit("_"), F.lower("p_brand"))).when(i % 5 == 2, "_ZH_EN").otherwise(""), when(i % 4 == 1, day).when(i % 4 == 2, "_20240229").otherwise(""),
        when(i % 3 == 0, "_ZH").when(i % 3 == 1, "_RU").otherwise(""), when(i % 6 == 0, "_V2").when(i % 6 == 4, "_r12").otherwise(""), when(i % 11 == 0, ".exe").when(i % 11 == 1, "").otherwise(".PDF"),
    )
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"))


def _listed(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_SPOKEN = "|".join(contract.LANGUAGES)


@query(
    "contract_names_str16",
    rf"""WITH t AS ({TITLES.replace('{types}', _listed(contract.BUSINESS_TYPES))}), s AS (SELECT *, regexp_replace(title, '([^/])\.[^./]+$', '\1') AS stem FROM t),
    c AS (SELECT *, regexp_extract(stem, '^(.*?)(_(?:19|20)[0-9]{{6}})?(?:_(?:{_SPOKEN}))?(?:_[VRvr][0-9]{{1,3}})?$', 1) AS core, regexp_extract(stem, '^(.*?)(?:_((?:19|20)[0-9]{{6}}))?(?:_(?:{_SPOKEN}))?(?:_[VRvr][0-9]{{1,3}})?$', 2) AS day FROM s)
    SELECT p_partkey, title, length(title) <= {contract.LONGEST} AND trim(title) = title AND NOT regexp_matches(title, '[/\\:<>|?*]') AND list_contains({_listed(contract.EXTENSIONS)}, lower(regexp_extract(title, '\.([^./]+)$', 1)))
      AND (day = '' OR try_strptime(day, '%Y%m%d') IS NOT NULL) AND len(string_split(core, '_')) BETWEEN 2 AND 3 AND NOT regexp_matches('_' || stem || '_', '(?i)_(?:[ .]|{'|'.join(contract.PLACEHOLDERS)})?_')
      AND NOT regexp_matches('_' || core || '_', '_(?:{_SPOKEN}|{'|'.join(contract.OTHER_LANGUAGE_NAMES)}|(?:19|20)[0-9]{{6}}|[VRvr][0-9]{{1,3}})_')
      AND length(string_split(core, '_')[1]) >= 2 AND NOT regexp_matches(string_split(core, '_')[1], '{contract.GENERIC_OBJECT}') AND list_contains(list_transform({_listed(contract.BUSINESS_TYPES)}, lambda x: lower(x)), lower(string_split(core, '_')[2])) AS compliant FROM c""".replace("\\\\", "\\"),
)
def contract_names(spark, sf_dir):
    return titles(spark, sf_dir).select("p_partkey", "title", rs.compliant(F.col("title")).alias("compliant"))


@query("inquiry_names_str17", "SELECT c_custkey, regexp_extract(f, '(?i)^C[0-9]+_([A-Za-z][A-Za-z-]*)_([A-Za-z][A-Za-z0-9-]*)_([A-Za-z][A-Za-z0-9-]*)_销_((?:19|20)[0-9]{6})[0-9]{4}\\.pdf$', 2) AS product, CASE WHEN c_custkey % 2 = 0 THEN regexp_extract(f, '(?i)^C[0-9]+_([A-Za-z][A-Za-z-]*)_([A-Za-z][A-Za-z0-9-]*)_([A-Za-z][A-Za-z0-9-]*)_销_((?:19|20)[0-9]{6})[0-9]{4}\\.pdf$', 4) ELSE '' END AS business_date FROM (SELECT c_custkey, 'C' || c_custkey || '_Peru_' || c_mktsegment || '_Unknown_销_20240' || (1 + c_custkey % 9) || '151200.pdf' AS f FROM customer)")
def inquiry_names(spark, sf_dir):
    """The date counts only where the document repeats it."""
    # Fixed value: the grammar of generated inquiry filenames (STR17).
    pattern = r"(?i)^C[0-9]+_([A-Za-z][A-Za-z-]*)_([A-Za-z][A-Za-z0-9-]*)_([A-Za-z][A-Za-z0-9-]*)_销_((?:19|20)[0-9]{6})[0-9]{4}\.pdf$"
    f = F.concat(F.lit("C"), "c_custkey", F.lit("_Peru_"), "c_mktsegment", F.lit("_Unknown_销_20240"), 1 + F.col("c_custkey") % 9, F.lit("151200.pdf"))
    date = F.regexp_extract(f, pattern, 4)
    text = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Part 1 | report of "), F.left(date, F.lit(4)), F.lit("-"), F.substring(date, 5, 2), F.lit("-"), F.substring(date, 7, 2))).otherwise("no date")
    told = F.contains(text, F.concat_ws("-", F.left(date, F.lit(4)), F.substring(date, 5, 2), F.substring(date, 7, 2)))
    return table(spark, sf_dir, "customer").select("c_custkey", F.regexp_extract(f, pattern, 2).alias("product"), F.when(told, date).otherwise("").alias("business_date"))


PROJECTS = "p AS (SELECT p_partkey AS project_id, 'OPP-2024-' || lpad(p_partkey::VARCHAR, 6, '0') AS code, CASE WHEN p_partkey % 5 = 0 THEN 'W' || p_partkey END AS official, p_name AS name, p_brand || ' ' || p_partkey AS alias FROM part)"


def projects(spark, sf_dir):
    i = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        i.alias("project_id"), F.concat(F.lit("OPP-2024-"), F.lpad(i.cast("string"), 6, "0")).alias("code"), F.when(i % 5 == 0, F.concat(F.lit("W"), i)).alias("official_code"), F.col("p_name").alias("name"), F.array(F.concat_ws(" ", "p_brand", i)).alias("aliases")
    )


@query(
    "resolve_nam03",
    f"""WITH {PROJECTS}, r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'OPP-2024-' || lpad((p_partkey // 2 * 3)::VARCHAR, 6, '0') END AS selected, CASE WHEN p_partkey % 4 = 1 THEN 'W' || (p_partkey - 1) END AS explicit,
      CASE WHEN p_partkey % 4 = 2 THEN upper(p_brand) || '-' || p_partkey ELSE p_name END AS name FROM part),
    k AS (SELECT DISTINCT project_id, {FOLD.format('unnest([name, alias])')} AS key FROM p), n AS (SELECT key, count(DISTINCT project_id) AS n, min(project_id) AS pid FROM k WHERE key <> '' GROUP BY key),
    c AS (SELECT code, CASE WHEN count(*) = 1 THEN min(project_id) END AS pid FROM (SELECT DISTINCT project_id, unnest([code, official]) AS code FROM p) WHERE code IS NOT NULL GROUP BY code)
    SELECT r.id AS request_id, coalesce(CASE WHEN selected IS NOT NULL THEN s.pid ELSE coalesce(e.pid, CASE WHEN n.n = 1 THEN n.pid END) END, -1) AS project_id,
      CASE WHEN selected IS NOT NULL THEN CASE WHEN s.pid IS NULL THEN 'unknown_code' ELSE 'selected' END WHEN e.pid IS NOT NULL THEN 'explicit' WHEN n.n > 1 THEN 'ambiguous' WHEN n.n = 1 THEN 'named' ELSE 'new' END AS reason
    FROM r LEFT JOIN c s ON r.selected = s.code LEFT JOIN c e ON r.explicit = e.code LEFT JOIN n ON {FOLD.format('r.name')} = n.key""",
)
def resolve(spark, sf_dir):
    i = F.col("p_partkey")
    code = F.concat(F.lit("OPP-2024-"), F.lpad((F.floor(i / 2) * 3).cast("string"), 6, "0"))
    requests = table(spark, sf_dir, "part").select(
        i.alias("request_id"), F.when(i % 4 == 0, code).alias("selected"), F.when(i % 4 == 1, F.concat(F.lit("W"), i - 1)).alias("explicit"), F.when(i % 4 == 2, F.concat_ws("-", F.upper("p_brand"), i)).otherwise(F.col("p_name")).alias("name")
    )
    return rs.resolve(requests, projects(spark, sf_dir)).select("request_id", F.coalesce("project_id", F.lit(-1)).alias("project_id"), "reason")


@query("allocate_str13_nam03", f"WITH r AS (SELECT p_partkey, p_name AS name, {FOLD.format('p_name')} AS key FROM part), k AS (SELECT key, row_number() OVER (ORDER BY min(p_partkey), key) + 100 AS n FROM r GROUP BY key) SELECT p_partkey, 'OPP-2025-' || lpad(n::VARCHAR, 6, '0') AS code FROM r JOIN k USING (key)")
def allocate(spark, sf_dir):
    return rs.allocate(table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name")), 2025, 100, ["p_partkey"]).select("p_partkey", "code")


#: The filenames of one request.
REQUESTED = ("Brand#1 17 layout", "OPP-2024-000042 report", "Brand#12 112 steel plan", "unrelated notes", "Brand#3 3")


@query("references_ord09_nam02")
def references(spark, sf_dir):
    """Scored references for five filenames, of all projects: scores are no equality, so every pair is scored."""
    wanted = spark.createDataFrame(list(enumerate(REQUESTED)), "request_id int, source string")
    known = projects(spark, sf_dir).select("project_id", "name", "code", F.get("aliases", F.lit(0)).alias("alias"))
    met = known.join(F.broadcast(wanted))  # five rows
    score = rs.reference_score([F.col("name"), F.col("code"), F.col("alias")], F.col("source"))
    scored = met.select("request_id", "project_id", (F.col("project_id") % 2 == 0).alias("is_project"), score.alias("score"), F.col("project_id").alias("position"))
    return rs.select_references(scored, "request_id").select("request_id", "project_id", "is_project", "score")


SOURCES = """SELECT s_suppkey AS request_id, 'Brand#' || (1 + s_suppkey % 25) || ' ' || s_suppkey * 7 || ' ' || CASE s_suppkey % 4 WHEN 0 THEN 'layout' WHEN 1 THEN 'OPP-2024-' || lpad((s_suppkey * 3)::VARCHAR, 6, '0') || ' report' WHEN 2 THEN 'steel' ELSE s_name END AS source FROM supplier"""


def sources(spark, sf_dir):
    i = F.col("s_suppkey")
    what = F.when(i % 4 == 0, "layout").when(i % 4 == 1, F.concat(F.lit("OPP-2024-"), F.lpad((i * 3).cast("string"), 6, "0"), F.lit(" report"))).when(i % 4 == 2, "steel").otherwise(F.col("s_name"))
    return table(spark, sf_dir, "supplier").select(i.alias("request_id"), F.concat(F.lit("Brand#"), 1 + i % 25, F.lit(" "), i * 7, F.lit(" "), what).alias("source"))


_TOKENS = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9-]{{4,}}'), lambda t: regexp_matches(t, '[0-9]')))"


@query(
    "indexed_references_ord09_nam02",
    f"""WITH {PROJECTS}, r AS MATERIALIZED (SELECT project_id, project_id % 2 = 0 AS is_project, unnest([name, code, alias]) AS v FROM p), q AS ({SOURCES}),
    v AS (SELECT DISTINCT v, {FOLD.format('v')} AS t, {_TOKENS.format('v')} AS k FROM r), f AS (SELECT request_id, {FOLD.format('source')} AS s, {_TOKENS.format('source')} AS k FROM q),
    pair AS (SELECT request_id, v.v, greatest(CASE WHEN length(t) >= 4 AND (contains(s, t) OR (contains(t, s) AND length(s) >= 6)) THEN 100 + least(length(t), 40) ELSE 0 END, 10 * len(list_intersect(v.k, f.k)))::INT AS score FROM f CROSS JOIN v),
    hit AS (SELECT request_id, project_id, is_project, max(score) AS score FROM pair JOIN r USING (v) WHERE score > 0 GROUP BY ALL),
    best AS (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY request_id, is_project ORDER BY score DESC, project_id) <= CASE WHEN is_project THEN 12 ELSE 6 END),
    few AS (SELECT request_id FROM q WHERE (SELECT count(*) FROM best b WHERE b.request_id = q.request_id AND NOT is_project) < 2),
    fill AS (SELECT request_id, project_id, false AS is_project, 0 AS score FROM few CROSS JOIN (SELECT project_id FROM p WHERE project_id % 2 <> 0 ORDER BY project_id LIMIT 2))
    SELECT request_id, project_id, is_project, score FROM best UNION ALL SELECT * FROM fill WHERE (request_id, project_id) NOT IN (SELECT (request_id, project_id) FROM best)""",
)
def indexed_references(spark, sf_dir):
    """References for a filename of each supplier, of all projects, proposed by identifiers and runs of four letters."""
    known = projects(spark, sf_dir).select(
        F.col("project_id").alias("reference_id"), (F.col("project_id") % 2 == 0).alias("is_project"), F.col("project_id").alias("position"), F.array("name", "code", F.get("aliases", F.lit(0))).alias("values")
    )
    return nm.selected(sources(spark, sf_dir), known).withColumnRenamed("reference_id", "project_id")


@query(
    "naming_corpus_nam02",
    f"""WITH {KB} SELECT doc_id, row_number() OVER (ORDER BY business_date DESC NULLS LAST, doc_id) AS position FROM kb WHERE organization_id = 'src1' AND (state = 'published' OR (state = 'draft' AND created_by = 'u7' AND doc_id % 3 <> 0)) AND (visibility = 'department' OR created_by = 'u7')
    ORDER BY business_date DESC NULLS LAST, doc_id LIMIT 500""",
)
def naming_corpus(spark, sf_dir):
    """The documents by which a member's names are judged."""
    docs = documents(spark, sf_dir).withColumn("created_at", F.col("business_date")).withColumn("needs_review", F.col("doc_id") % 3 == 0)
    return nm.corpus(docs, ALICE, "src1").select("doc_id", "position")


@query("grounded_nam01", f"SELECT p_partkey, contains({FOLD.format('t')}, {FOLD.format('p_name')}) AND contains({FOLD.format('t')}, {FOLD.format('b')}) AS grounded FROM (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 = 0 THEN 'zz' ELSE p_brand END AS b, upper(p_name) || ' / ' || p_brand AS t FROM part)")
def grounded(spark, sf_dir):
    brand = F.when(F.col("p_partkey") % 3 == 0, "zz").otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", rs.grounded(F.array(F.col("p_name"), brand), F.concat(F.upper("p_name"), F.lit(" / "), "p_brand")).alias("grounded"))


@query("labels_nam04", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_name || ' plant' ELSE p_name || ' plant, north' END AS label FROM part")
def labels(spark, sf_dir):
    project = F.concat("p_name", F.lit(" plant, north"))
    opening = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.upper("p_name"), F.lit("  PLANT"))).otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", rs.canonical_label(project, opening).alias("label"))


@query("coverage_vis02_vis01", "SELECT conv_id, count(*) FILTER (role = 'user') + count(*) FILTER (role <> 'user' AND turn % 2 = 0) = count(*) AS complete, count(DISTINCT md5(text)) AS distinct_calls FROM conversations GROUP BY conv_id")
def coverage(spark, sf_dir):
    """Analysed and skipped parts add up to all; equal contents are asked for once."""
    done = F.count_if(F.col("role") == "user") + F.count_if((F.col("role") != "user") & (F.col("turn") % 2 == 0))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg((done == F.count(F.lit(1))).alias("complete"), F.countDistinct(F.md5(F.col("text").cast("binary"))).alias("distinct_calls"))


