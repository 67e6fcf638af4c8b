"""Proposed references are all that score, and those chosen are those of all pairs."""

import random
import re

from lodestore.operators import naming as nm
from lodestore.operators.security import Principal


def fold(v):
    return re.sub(r"[\W_]+", "", v or "").lower()


def tokens(v):
    return {t for t in re.findall(r"[a-z0-9-]{4,}", (v or "").lower()) if re.search("[0-9]", t)}


def score(value, source):
    term, folded = fold(value), fold(source)
    within = len(term) >= 4 and (term in folded or (folded in term and len(folded) >= 6))
    return max(100 + min(len(term), 40) if within else 0, 10 * len(tokens(value) & tokens(source)))


def plain(requests, references):
    out = []
    for rid, source in requests:
        scored = [(max((score(v, source) for v in values if v), default=0), position, ref, is_project) for ref, is_project, position, values in references]
        hits = lambda kind, n: sorted((s for s in scored if s[3] == kind and s[0]), key=lambda s: (-s[0], s[1], s[2]))[:n]  # noqa: B023, E731
        documents = hits(False, 6)
        if len(documents) < 2:
            documents += [(0, *s[1:]) for s in sorted((s for s in scored if not s[3]), key=lambda s: s[1:3])[:2] if s[2] not in {d[2] for d in documents}]
        out += [(rid, ref, kind, s) for s, _, ref, kind in hits(True, 12) + documents]
    return sorted(out)


def test_against_all_pairs(spark):
    rng = random.Random(4)
    words = ["kiln", "north", "plant", "mill", "OPP-2024-000017", "AX-210", "回转窑总装", "steel works", "ab", "Zementwerk", "line 7"]
    for _ in range(3):
        references = [(i, i % 3 == 0, rng.randint(0, 40), [" ".join(rng.choices(words, k=rng.randint(1, 3))), rng.choice([None, "", "same value of many"]), rng.choice(words)]) for i in range(160)]
        requests = [(i, rng.choice([" ".join(rng.choices(words, k=rng.randint(1, 4))), "unrelated", "", "kiln north", "same value of many things", "回转窑总装图"])) for i in range(25)]
        got = nm.selected(spark.createDataFrame(requests, "request_id long, source string"), spark.createDataFrame(references, "reference_id long, is_project boolean, position long, values array<string>"))
        assert sorted(map(tuple, got.collect())) == plain(requests, references)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner\n" not in plan and "Join Cross" not in plan
    for join in re.findall(r"Join \w+,? ?(.*)", plan):
        assert "=" in join, join


def test_only_what_fits_is_proposed(spark):
    """Sources and values have runs of four letters in common by the dozen; the pairs that fit are few."""
    values = [(i, False, i, [f"Brand#{i % 25} {i * 13 % 9000}", f"OPP-2024-{i:06d}"]) for i in range(600)]
    requests = [(i, f"Brand#{i % 25} {i * 7 % 9000} steel {i:04d}") for i in range(80)]
    references = spark.createDataFrame(values, "reference_id long, is_project boolean, position long, values array<string>")
    asked = spark.createDataFrame(requests, "request_id long, source string")
    proposed = nm.proposed(asked, nm.listed_values(references))
    assert "Broadcast" not in proposed._jdf.queryExecution().sparkPlan().toString()
    got = {tuple(r) for r in proposed.collect()}
    assert got == {(i, v) for i, source in requests for r in values for v in r[3] if score(v, source)}


def test_nothing(spark):
    none = spark.createDataFrame([], "reference_id long, is_project boolean, position long, values array<string>")
    asked = spark.createDataFrame([(1, "kiln"), (2, None)], "request_id long, source string")
    assert nm.selected(asked, none).count() == 0
    one = spark.createDataFrame([(5, False, 1, ["mill"]), (6, False, 2, ["kiln x"])], none.schema)
    assert sorted(map(tuple, nm.selected(asked, one).collect())) == [(1, 5, False, 0), (1, 6, False, 0), (2, 5, False, 0), (2, 6, False, 0)]


def test_corpus(spark):
    rows = [
        (1, "o", "published", "x", "department", 5, None), (2, "o", "published", "x", "private", 9, None), (3, "o", "published", "me", "private", 7, True), (4, "o", "draft", "me", "department", 8, False),
        (5, "o", "draft", "me", "department", 10, True), (6, "o", "draft", "x", "department", 11, None), (7, "p", "published", "x", "department", 12, None), (8, "o", "superseded", "me", "department", 13, None), (9, "o", "published", "x", "department", 5, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, organization_id string, state string, created_by string, visibility string, created_at int, needs_review boolean")
    listed = lambda who, n=500: [r["doc_id"] for r in nm.corpus(docs, who, "o", n).orderBy("position").collect()]
    assert listed(Principal("me", {"o": "member"})) == [4, 3, 1, 9] and listed(Principal("me", {"o": "member"}), 3) == [4, 3, 1]
    assert listed(Principal("me", {"o": "publisher"})) == [6, 2, 4, 3, 1, 9]
