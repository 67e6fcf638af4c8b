"""Row-level security as column predicates, and the hierarchies it draws on."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.sources.commits import CommitLog, written
from lodestore.sources.shared import shared_folder


#: Shares into which organizations are dealt where each meets every superadmin.
SHARES = 16


@dataclass(frozen=True)
class Principal:
    """Who asks. ``memberships``: organization to role, ``member`` or ``publisher``."""

    id: str
    memberships: dict[str, str] = field(default_factory=dict)
    restricted: bool = False

    @property
    def organizations(self) -> list[str]:
        return sorted(self.memberships)

    @property
    def publishes(self) -> list[str]:
        return sorted(o for o, r in self.memberships.items() if r == "publisher")


def readable(principal: Principal, granted: Column) -> Column:
    """Owner, publisher of the organization, member where the document is the department's, or granted; for a
    restricted principal the organization must be among theirs besides (FLT01)."""
    rule = (
        (F.col("created_by") == principal.id)
        | F.col("organization_id").isin(principal.publishes)
        | ((F.col("visibility") == "department") & F.col("organization_id").isin(principal.organizations))
        | granted
    )
    return rule & F.col("organization_id").isin(principal.organizations) if principal.restricted else rule


def with_grant(documents: DataFrame, grants: DataFrame, principal: Principal) -> DataFrame:
    """``granted``: whether the principal holds a grant. The grants of one principal, one row a document, are joined."""
    mine = grants.filter(F.col("principal_id") == principal.id).select("doc_id", F.lit(True).alias("granted")).distinct()
    return documents.join(mine, "doc_id", "left").withColumn("granted", F.coalesce("granted", F.lit(False)))


def visible(documents: DataFrame, grants: DataFrame, principal: Principal) -> DataFrame:
    """Active published documents that the principal may read. Part of every search, below its ranking."""
    found = with_grant(documents, grants, principal).filter((F.col("state") == "published") & readable(principal, F.col("granted")))
    return found.drop("granted")


def may_see_version(principal: Principal, granted: Column, history: bool) -> Column:
    """Drafts: publisher or author; published: as ``readable``; others: publisher, and only when asking for history (FLT11)."""
    publisher = F.col("organization_id").isin(principal.publishes)
    return (
        F.when(F.col("state") == "draft", publisher | (F.col("created_by") == principal.id))
        .when(F.col("state") == "published", readable(principal, granted))
        .otherwise(publisher & F.lit(history))
    )


def matching(documents: DataFrame, organization: str | None = None, category: str | None = None, model: str | None = None, since=None, until=None) -> DataFrame:
    """Optional filters; None does not filter. The model is compared with its data side trimmed and lowered only,
    and rows without a date drop out where a bound is given (FLT02-04)."""
    from lodestore.functions.unicode import normalized

    if organization is not None:
        documents = documents.filter(F.col("organization_id") == organization)
    if category is not None:
        documents = documents.filter(F.col("category_id") == category)
    if model is not None:
        documents = documents.filter(F.lower(F.btrim("model")) == normalized(model))
    if since is not None:
        documents = documents.filter(F.col("business_date") >= F.lit(since))
    if until is not None:
        documents = documents.filter(F.col("business_date") <= F.lit(until))
    return documents


def within(accounts: DataFrame, memberships: DataFrame, mine: list[str]) -> DataFrame:
    """Accounts all of whose organizations are mine, and one at least (FLT13)."""
    inside = memberships.filter(F.col("organization_id").isin(mine)).select("account_id").distinct()
    outside = memberships.filter(~F.col("organization_id").isin(mine)).select("account_id").distinct()
    return accounts.join(inside, "account_id", "left_semi").join(outside, "account_id", "left_anti")


def ancestors(nodes: DataFrame) -> DataFrame:
    """Of rows (id, parent): ``id``, ``ancestor`` (itself included), ``depth``; cycles end where they close (HIE01).

    One join a level, down to the last one; the rows in hand shrink as roots are reached. Each level is written to the
    shared folder, so none is computed twice.
    """
    log = CommitLog(nodes.sparkSession, f"{shared_folder(nodes.sparkSession)}/lodestore-{nodes.sparkSession.sparkContext.applicationId}/ancestors")

    def kept(df: DataFrame) -> DataFrame:
        return nodes.sparkSession.read.schema(df.schema).parquet(log.files.at(written(log, df, "level")))

    edges = nodes.filter(F.col("parent").isNotNull()).select(F.col("id").alias("node"), F.col("parent"))
    front = nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("depth"), F.array("id").alias("path"))
    levels, k = [], 0
    while k < 2 or not front.isEmpty():
        levels.append(front.drop("path"))
        k += 1
        met = front.join(edges, F.col("ancestor") == F.col("node")).filter(~F.array_contains("path", F.col("parent")))
        front = kept(met.select("id", F.col("parent").alias("ancestor"), F.lit(k).alias("depth"), F.concat("path", F.array("parent")).alias("path")))
    return reduce(DataFrame.unionByName, levels)


def role_rank(role: Column) -> Column:
    return F.when(role == "publisher", 2).when(role == "member", 1).otherwise(0)


def effective(memberships: DataFrame, defaults: list[str], principals: DataFrame) -> DataFrame:
    """Own memberships and the default organizations as member, the higher role of each (SET01, IDN01)."""
    given = principals.select("principal_id", F.explode(F.array(*(F.lit(d) for d in defaults))).alias("organization_id")).withColumn("role", F.lit("member"))
    both = memberships.select("principal_id", "organization_id", "role").unionByName(given)
    return both.groupBy("principal_id", "organization_id").agg(F.max_by("role", role_rank(F.col("role"))).alias("role"))


def load_principals(users: DataFrame, principals: DataFrame, memberships: DataFrame, organizations: DataFrame, defaults: list[str]) -> DataFrame:
    """Rows (``principal_id``, ``organization_id``, ``role``) of every account that may act (IDN01).

    Accounts must be active, as users and as principals, and have a password or a bound identity. A superadmin is a
    publisher of all organizations; others have their own memberships, and the default organizations as member at least.
    """
    able = users.join(principals.filter("active").select("principal_id"), "principal_id", "left_semi").filter("status = 'active' AND (has_password OR bound)")
    # superadmins are few; each is dealt to every share of the organizations, however many these are
    shares = F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))
    every = organizations.select("organization_id", F.pmod(F.xxhash64("organization_id"), F.lit(SHARES)).cast("int").alias("_share"))
    over = able.filter("account_role = 'superadmin'").select("principal_id", shares.alias("_share")).join(every, "_share").select("principal_id", "organization_id", F.lit("publisher").alias("role"))
    plain = able.filter("account_role <> 'superadmin'").select("principal_id")
    return over.unionByName(effective(memberships.join(plain, "principal_id", "left_semi"), defaults, plain))
