"""Rules of identities, invitations and trees on rows whose results are plain to see; margins of pages."""

from datetime import datetime as d

from pyspark.sql import functions as F

from lodestore.operators import dataflow as df
from lodestore.operators import identity as ident
from lodestore.operators import security as sec


def rows(frame, *columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


NOW = d(2024, 5, 1)


def test_bound_identities(spark):
    accounts = spark.createDataFrame([(1, "user"), (2, "manager"), (3, "superadmin"), (4, "user"), (5, "user"), (6, "user"), (7, "superadmin"), (8, "superadmin"), (9, "user")], "principal_id long, account_role string")
    fresh, stale = d(2024, 4, 30, 12), d(2024, 4, 1)
    known = [(1, "own", True, fresh, ["a"]), (2, "own", True, fresh, ["a", "b"]), (3, "own", True, fresh, []), (4, "own", True, stale, ["a"]), (5, "own", False, fresh, ["a"]), (6, "other", True, fresh, ["a"]), (9, "own", None, fresh, None)]
    identities = spark.createDataFrame(known, "principal_id long, company string, enabled boolean, verified_at timestamp, organization_ids array<string>")
    members = spark.createDataFrame([(1, "a", "publisher"), (2, "a", "publisher"), (2, "c", "publisher"), (2, "z", "publisher"), (3, "x", "publisher"), (7, "y", "member"), (8, "y", "member")], "principal_id long, organization_id string, role string")
    more = spark.createDataFrame([(1, "e"), (2, "c"), (4, "e"), (2, "a")], "principal_id long, organization_id string")
    got = ident.effective_identities(accounts, identities, members, more, ["z"], F.lit(NOW), "own", 86400, [7])
    assert rows(got, "principal_id", "organization_id", "role", "bound") == [
        (1, "a", "member", True), (1, "e", "member", True), (1, "z", "member", True), (2, "a", "publisher", True), (2, "b", "member", True), (2, "c", "member", True), (2, "z", "publisher", True), (3, "x", "publisher", True), (7, "y", "member", False),
    ]


def test_invitations(spark):
    accounts = spark.createDataFrame([(1, "user", "active"), (2, "user", "disabled"), (3, "manager", "active"), (4, "superadmin", "active"), (5, "manager", "disabled"), (6, "manager", "active")], "principal_id long, account_role string, status string")
    members = spark.createDataFrame([(1, "a", "member"), (1, "b", "member"), (3, "a", "publisher"), (3, "b", "publisher"), (6, "a", "publisher"), (6, "b", "member")], "principal_id long, organization_id string, role string")
    day = lambda n: d(2024, 4, n)
    later = d(2024, 6, 1)
    listed = [
        (10, 1, 3, day(1), None, None, later), (11, 1, 3, day(2), day(3), None, later), (12, 1, 3, day(5), None, None, later), (20, 2, 4, day(1), None, None, later), (30, 3, 4, day(1), None, None, day(2)),
        (40, 6, 3, day(1), None, None, later), (50, 4, 5, day(1), None, None, later), (60, 99, 4, day(1), None, None, later), (70, 5, 4, day(2), None, day(3), later),
    ]
    asked = spark.createDataFrame(listed, "invitation_id long, principal_id long, created_by long, issued_at timestamp, used_at timestamp, revoked_at timestamp, expires_at timestamp")
    got = dict(rows(ident.valid_invitations(asked, accounts, members, F.lit(NOW)), "invitation_id", "status"))
    assert got == {10: "revoked", 11: "used", 12: "valid", 20: "disabled", 30: "expired", 40: "without_authority", 50: "without_authority", 60: "disabled", 70: "revoked"}
    other = spark.createDataFrame([(1, 1, 6, day(1), None, None, later)], asked.schema)
    assert rows(ident.valid_invitations(other, accounts, members, F.lit(NOW)), "status") == [("without_authority",)]


def test_tree(spark):
    accounts = spark.createDataFrame([(1, None, "superadmin"), (2, 1, "superadmin"), (3, 2, "user"), (4, 3, "user"), (5, 99, "user"), (6, 6, "user"), (7, 8, "user"), (8, 7, "user"), (9, 4, "manager")], "principal_id long, created_by long, role string")
    tree = ident.branches(accounts)
    assert rows(tree, "principal_id", "root", "depth") == [(1, 1, 0), (2, 2, 0), (3, 2, 1), (4, 2, 2), (5, 5, 0), (6, 6, 0), (9, 2, 3)]
    assert rows(ident.branch_page(tree, 1, 2), "principal_id", "root", "branch") == [(2, 2, 1 + 1), (3, 2, 2), (4, 2, 2), (5, 5, 3), (9, 2, 2)]


def test_deep_chain(spark):
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(70)], "id long, parent long")
    assert sec.ancestors(chain).count() == 70 * 71 // 2


def test_superadmins_publish_everywhere(spark):
    users = spark.createDataFrame([(1, "superadmin", "active", True, False, True), (2, "user", "active", True, False, True)], "principal_id long, account_role string, status string, has_password boolean, bound boolean, active boolean")
    organizations = spark.createDataFrame([(f"o{i}",) for i in range(40)], "organization_id string")
    got = sec.load_principals(users, users, spark.createDataFrame([(2, "o1", "publisher")], "principal_id long, organization_id string, role string"), organizations, ["o2"])
    assert rows(got, "principal_id", "organization_id", "role") == sorted([(1, f"o{i}", "publisher") for i in range(40)] + [(2, "o1", "publisher"), (2, "o2", "member")], key=str)


def test_margins(spark):
    lines = []
    for page in range(5):
        lines += [("f", page, "Acme Works  Tel 1", 0.05), ("f", page, "Header Row", 0.5), ("f", page, f"- {page + 1} / 5 -", 0.95), ("f", page, f"text {page}", 0.3), ("g", page, "7", 0.95 if page == 0 else 0.5), ("g", page, "x" * 121, 0.01)]
    lines += [("h", 0, "only", 0.01), ("h", 1, "only", 0.01)]
    got = rows(df.page_furniture(spark.createDataFrame(lines, "file string, page int, line string, position double"), "file", "page", "line", "position"), "file", "key", "kind")
    assert got == sorted([("f", "AcmeWorksTel1", "repeated"), *(("f", f"-{i}/5-", "folio") for i in range(1, 6))], key=str)
    values = ["3", "Page 3 of 10", "第 3 页", "— 12 —", "第3页 共 9", "3.", "page", "12345", "3 a"]
    found = spark.createDataFrame(list(enumerate(values)), "i int, v string").orderBy("i").select(F.col("v").rlike(df.FOLIO)).collect()
    assert [r[0] for r in found] == [True, True, True, True, False, False, False, False, False]
