"""Who may act, and for whom: bound identities, invitations, the tree of accounts (IDN02, IDN05, HIE02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestore.operators.security import ancestors, role_rank


def identity_status(now: Column, company: str, refresh_seconds: int, maintenance: list) -> Column:
    """``maintenance``, ``none``, ``other_company``, ``disabled``, ``stale`` or ``bound``, of accounts joined with their
    identity (``company``, ``enabled``, ``verified_at``: null without one)."""
    kept = (F.col("account_role") == "superadmin") & F.col("principal_id").isin(maintenance)
    fresh = F.col("verified_at") > now - F.make_interval(secs=F.lit(refresh_seconds))
    return (
        F.when(F.col("company").isNull(), F.when(kept, "maintenance").otherwise("none")).when(F.col("company") != company, "other_company")
        .when(~F.coalesce("enabled", F.lit(False)), "disabled").when(~F.coalesce(fresh, F.lit(False)), "stale").otherwise("bound")
    )


def effective_identities(accounts: DataFrame, identities: DataFrame, memberships: DataFrame, extensions: DataFrame, defaults: list[str], now: Column, company: str, refresh_seconds: int, maintenance: list) -> DataFrame:
    """Rows (``principal_id``, ``organization_id``, ``role``, ``bound``) of every account whose identity lets it act (IDN02).

    Without an identity only superadmins named for maintenance act, unbound. An identity that is stale, disabled or of
    another company lets nobody act. A superadmin keeps the memberships; others are members of the synchronized and the
    default organizations, where a manager keeps the role of publisher, and of those they were let into besides.
    """
    known = identities.select("principal_id", "company", "enabled", "verified_at", "organization_ids")
    able = accounts.join(known, "principal_id", "left").withColumn("_status", identity_status(now, company, refresh_seconds, maintenance)).filter(F.col("_status").isin("bound", "maintenance"))
    able = able.select("principal_id", "account_role", "organization_ids", (F.col("_status") == "bound").alias("bound"))
    kept = able.filter("account_role = 'superadmin' OR NOT bound").join(memberships.select("principal_id", "organization_id", "role"), "principal_id").select("principal_id", "organization_id", "role", "bound")
    others = able.filter("account_role <> 'superadmin' AND bound")
    given = F.array_distinct(F.concat(F.coalesce("organization_ids", F.array().cast("array<string>")), F.array(*(F.lit(d) for d in defaults))))
    base = others.select("principal_id", "account_role", F.explode(given).alias("organization_id"))
    publishing = memberships.filter("role = 'publisher'").select("principal_id", "organization_id", F.lit(True).alias("_publishes")).distinct()
    role = F.when((F.col("account_role") == "manager") & F.coalesce("_publishes", F.lit(False)), "publisher").otherwise("member")
    inside = base.join(publishing, ["principal_id", "organization_id"], "left").select("principal_id", "organization_id", role.alias("role"))
    more = extensions.join(others.select("principal_id"), "principal_id", "left_semi").select("principal_id", "organization_id", F.lit("member").alias("role"))
    both = inside.unionByName(more).groupBy("principal_id", "organization_id").agg(F.max_by("role", role_rank(F.col("role"))).alias("role"))
    return both.withColumn("bound", F.lit(True)).unionByName(kept)


def valid_invitations(invitations: DataFrame, accounts: DataFrame, memberships: DataFrame, now: Column) -> DataFrame:
    """``invitation_id``, ``status`` (IDN05): ``used``, ``revoked`` (or followed by another: issuing revokes the earlier
    ones), ``expired``, ``disabled``, ``without_authority``, else ``valid``.

    An issuer has authority while active: a superadmin over all, a manager over users all of whose organizations the
    manager publishes.
    """
    last = F.row_number().over(W.partitionBy("principal_id").orderBy(F.desc("issued_at"), F.desc("invitation_id"))) == 1
    target = accounts.select("principal_id", F.col("status").alias("t_status"), F.col("account_role").alias("t_role"))
    issuer = accounts.select(F.col("principal_id").alias("created_by"), F.col("status").alias("i_status"), F.col("account_role").alias("i_role"))
    met = invitations.withColumn("_last", last).join(target, "principal_id", "left").join(issuer, "created_by", "left")
    of = memberships.select("principal_id", "organization_id").distinct()
    publishes = memberships.filter("role = 'publisher'").select(F.col("principal_id").alias("created_by"), "organization_id").distinct()
    outside = met.select("invitation_id", "principal_id", "created_by").join(of, "principal_id").join(publishes, ["created_by", "organization_id"], "left_anti").select("invitation_id").distinct()
    met = met.join(outside.withColumn("_outside", F.lit(True)), "invitation_id", "left")
    over = (F.col("i_status") == "active") & ((F.col("i_role") == "superadmin") | ((F.col("i_role") == "manager") & (F.col("t_role") == "user") & F.col("_outside").isNull()))
    status = (
        F.when(F.col("used_at").isNotNull(), "used").when(F.col("revoked_at").isNotNull() | ~F.col("_last"), "revoked").when(F.col("expires_at") <= now, "expired")
        .when(F.coalesce("t_status", F.lit("disabled")) == "disabled", "disabled").when(~F.coalesce(over, F.lit(False)), "without_authority").otherwise("valid")
    )
    return met.select("invitation_id", status.alias("status"))


def branches(accounts: DataFrame) -> DataFrame:
    """``principal_id``, ``root``, ``depth`` in the tree of who created whom (HIE02): a superadmin is a root whoever
    created them, and so is an account whose creator is not in the table or is itself. Accounts of a circle without a
    root have none."""
    listed = accounts.select(F.col("principal_id").alias("created_by"), F.lit(True).alias("_known"))
    parent = F.when((F.col("role") != "superadmin") & F.col("_known").isNotNull() & (F.col("created_by") != F.col("principal_id")), F.col("created_by"))
    nodes = accounts.join(listed, "created_by", "left").select(F.col("principal_id").alias("id"), parent.alias("parent"))
    roots = nodes.filter("parent IS NULL").select(F.col("id").alias("ancestor"))
    return ancestors(nodes).join(roots, "ancestor", "left_semi").select(F.col("id").alias("principal_id"), F.col("ancestor").alias("root"), "depth")


def branch_page(tree: DataFrame, offset: int, limit: int) -> DataFrame:
    """The branches of roots ``offset`` to ``offset + limit`` in order of the root, whole (WIN10). The limit comes first,
    so the window sees the roots of the page and those before."""
    first = tree.select("root").distinct().orderBy("root").limit(offset + limit)
    chosen = first.withColumn("branch", F.row_number().over(W.orderBy("root")).cast("long")).filter(F.col("branch") > offset)
    return tree.join(chosen, "root")

