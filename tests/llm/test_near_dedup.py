import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.llm import near_dedup as nd
from tests.llm.conftest import same

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute(texts, width):
    """id to (shingles, component) by all pairs."""
    sets = {i: shingles(t, width) for i, t in texts.items()}
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(frame, texts, width):
    got = nd.near_duplicates(frame, width=width).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(texts, width)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("width", [2, 5])
def test_documents(docs, texts, width):
    check(docs, texts, width)


def near_copies(n, seed=1):
    """Copies of one text with ever more edits, so that chains, links and strays all occur."""
    random.seed(seed)
    base = [f"w{random.randrange(400)}" for _ in range(120)]
    out = {}
    for i in range(n):
        words = list(base)
        for _ in range(random.randrange(18)):
            words[random.randrange(len(words))] = f"e{random.randrange(50)}"
        out[i] = " ".join(words)
    return out


@pytest.mark.parametrize(("few", "block"), [(16, 2048), (2, 5)])
def test_group_of_near_copies(spark, monkeypatch, few, block):
    monkeypatch.setattr(nd, "FEW", few)
    monkeypatch.setattr(nd, "BLOCK", block)
    texts = near_copies(60)
    check(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts, 2)


def test_estimate_and_merge():
    rng = np.random.default_rng(4)
    own = nd.Sketcher(2000)
    for j in (0.2, 0.5, 0.8, 0.95):
        both, only = int(3000 * j), (3000 - int(3000 * j)) // 2
        x = rng.integers(0, 1 << 63, both + 2 * only, dtype=np.uint64)
        a, b = x[: both + only], np.concatenate([x[:both], x[both + only :]])
        ra, rb = own.registers(a), own.registers(b)
        assert abs(nd.estimate(ra[None], rb[None], np.array([len(a)]), np.array([len(b)]))[0] - both / len(x)) < 0.05
        assert (nd.merge(ra, rb) == own.registers(x)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 200), (150, 200)]
    got = {r["id"]: r["component"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(range(31), 0) | {100: 100, 150: 100, 200: 100}


def test_awkward(awkward, clashing, empty):
    rows = nd.near_duplicates(awkward, width=2).collect()
    assert len(rows) == awkward.count()
    by = {r["doc_id"]: r for r in rows}
    assert (by[1]["n_shingles"], by[1]["component_id"], by[2]["component_id"]) == (0, 1, 2)
    assert by[9]["component_id"] == 8 and by[11]["component_id"] == 10 and by[40]["component_id"] == 0
    assert by[None]["kept"] and by[None]["component_id"] is None
    assert same(nd.near_duplicates(awkward, width=2), nd.near_duplicates(clashing, width=2))
    assert nd.near_duplicates(empty).count() == 0


def test_strays_beside_a_large_group_meet_by_rare_shingles(spark, monkeypatch):
    """Texts that share most of a group's shingles, but too few for a link, and a few that do link to one of its members."""
    monkeypatch.setattr(nd, "FEW", 4)
    random.seed(5)
    base = [f"w{i}" for i in range(200)]
    texts = {i: " ".join([*base[: 180 + i % 3], *(f"t{i % 7}_{k}" for k in range(18))]) for i in range(80)}
    for i in range(80, 120):
        cut = random.randrange(130, 170)
        texts[i] = " ".join([*base[:cut], *(f"u{i % 5}_{k}" for k in range(200 - cut))])
    check(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), texts, 2)


def test_rows_are_chosen_before_they_are_moved(spark):
    """All rows of the keys, repeated ones and null parts of keys too, and few others; of more keys than bits all."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 1000 > 0, F.col("id")).alias("a"), (F.col("id") % 7).alias("b")).union(spark.range(5, 6).select("id", F.lit(5)))
    keys = rows.filter("a % 50 = 5 or a is null")
    found = nd._among(rows, keys, "a", "b")
    assert found.columns == ["a", "b"] and keys.exceptAll(found).count() == 0 and found.exceptAll(rows).count() == 0
    assert found.count() < keys.count() + 40_000 // 8
    assert nd._among(rows, keys.limit(0), "a", "b").count() == 0


def test_texts_are_chosen_before_they_are_moved(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i // 3) * 40 + k}" for k in range(40)) + (" x" * (i % 3))) for i in range(60)] + [(100 + i, f"alone{i} in here") for i in range(300)]
    frame, plans, write = spark.createDataFrame(rows, "doc_id long, text string"), [], nd.bucketed
    monkeypatch.setattr(nd, "bucketed", lambda df, *a: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, *a))
    got = sorted(map(tuple, nd.near_duplicates(frame).collect()))
    assert all("getbit" in p for p in plans) and len(plans) == 1
    assert {i: c for i, _, c, _ in got} == {i: 3 * (i // 3) if i < 60 else i for i, _ in rows}
    monkeypatch.setattr(nd, "BITS", 6)
    assert sorted(map(tuple, nd.near_duplicates(frame).collect())) == got


def test_rows_without_a_verdict_are_not_moved(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i // 3) * 40 + k}" for k in range(40)) + (" x" * (i % 3)), i) for i in range(60)] + [(100 + i, f"alone{i} in here", i) for i in range(300)]
    rows += [(100, "alone0 in here", 7), (100, "another text", 8), (None, "no id", 9), (None, "no id", 10), (None, None, 11), (500, None, 12)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _at int")
    expected = sorted(str(r) for r in rows if not (r[0] is not None and r[0] < 60 and r[0] % 3) and r not in [(100, "alone0 in here", 7), (None, "no id", 9)])
    for bits in (nd.BITS, 6):
        monkeypatch.setattr(nd, "BITS", bits)
        found = nd.deduplicated(frame)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        joined = [p for p in plan.split("Join ") if p.startswith(("LeftAnti", "LeftOuter", "Inner")) and "_nd_of_id" in p.split("\n")[0]]
        assert len(joined) == 2 and all("getbit" in p or "_set_bits" in p for p in joined)
        assert sorted(str(tuple(r)) for r in found.collect()) == expected
