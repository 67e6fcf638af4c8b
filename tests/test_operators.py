"""Operators that SQL cannot express, against plain versions; and plans that must have a certain shape."""

import re
import time
from itertools import pairwise

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestore.functions import contract, notices
from lodestore.functions import text as tx
from lodestore.functions.unicode import normalize, normalized
from lodestore.operators import dataflow as df
from lodestore.plans.relations import share_held
from lodestore.operators import lifecycle as lc
from lodestore.operators import resolve as rs
from lodestore.operators import retrieval as rt
from lodestore.operators import security as sec
from lodestore.plans import retrieval as rq


def column(spark, values, expression):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").orderBy("i").select(expression(F.col("v"))).collect()]


def test_normalize(spark):
    values = ["  ＡＸ-210 ", "Straße", None, "ﬁ", "İ"]
    assert column(spark, values, normalize) == [normalized(v) for v in values] == ["ax-210", "strasse", "", "fi", "i̇"]


def cut(line, budget):
    words = re.findall(r"(?a)\s*\S+\s*\Z|\s*\S+", line)
    return ["".join(words[i : i + budget]) for i in range(0, len(words), budget)] or [line]


def pack(lines, budget):
    """Greedy packing in a loop."""
    n = lambda t: len(re.findall(r"(?a)\S+", t))
    head = lines[0] if len(lines) > 1 and lines[0] and n(lines[0]) <= min(32, budget // 3) else None
    out, current = [], ""
    for line in lines:
        candidate = f"{current}\n{line}" if current else line
        if n(candidate) <= budget:
            current = candidate
            continue
        if current:
            out.append(current)
        prefix = head + "\n" if head and out and line != head else ""
        pieces = [line] if n(prefix + line) <= budget else cut(line, max(1, budget - n(prefix)))
        out += [prefix + p for p in pieces[:-1]]
        current = prefix + pieces[-1]
    return [*out, current] if current else out


def test_packed_equals_loop(spark):
    texts = ["a b c\n" + "\n".join(f"row {i} x y" for i in range(9)), "one two three four five six seven eight nine ten eleven twelve", "h\n" + "w " * 30 + "\nend", "\n\na\n"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(df.packed(F.split("t", "\n"), 10)).collect()]
    assert got == [pack(t.split("\n"), 10) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\x0b\u2028", max_size=40), min_size=1, max_size=20), st.integers(1, 12))
def test_packing_equals_loop(lines, budget):
    assert df.pack_lines(lines, budget) == pack(lines, budget)


def test_packing_is_linear():
    def seconds(n):
        lines = ["head line"] + [f"row {i} of the table" for i in range(n)]
        began = time.perf_counter()
        pieces = df.pack_lines(lines, 200)
        return time.perf_counter() - began, pieces

    few, _ = seconds(100_000)
    many, pieces = seconds(1_000_000)
    assert many < 25 * few + 1 and sum(p.count("row ") for p in pieces) == 1_000_000 and all(p.startswith("head line\n") for p in pieces)


def test_drawing_prose_counts_ascii_words(spark):
    """An accented letter parts words, a vertical tab or a line separator ends no sentence: as in the SQL."""
    accented, marked = " ".join(["éabc"] * 40) + " a. b. c.", " ".join(["abc"] * 40) + ".\x0b.\x0b.\u2028"
    assert column(spark, [accented, marked, " ".join(["abc"] * 40) + ". . ."], df.drawing_prose) == [True, False, True]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\n", max_size=40), min_size=1, max_size=20))
def test_hard_split_keeps_all(spark, texts):
    pieces = column(spark, texts, lambda c: df.hard_split(c, 3))
    assert ["".join(p) for p in pieces] == texts


def test_hard_split_finds_pieces_once(spark):
    words = spark.createDataFrame([("a b\t c\x0bd  e \n",), ("  ",), (None,)], "t string").select(df.hard_split(F.col("t"), 2).alias("p"))
    assert [r["p"] for r in words.collect()] == [["a b", "\t c\x0bd  e \n"], ["  "], None]
    assert words._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1


def test_split_chunks_has_lean_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 28)
    df.split_chunks(spark.createDataFrame([(1, "a b c")], "chunk_id long, text string"), 2)
    assert [int(spark.conf.get(f"spark.sql.execution.arrow.{x}").rstrip("b")) for x in ("maxRecordsPerBatch", "maxBytesPerBatch")] == [1000, 1 << 20]


def test_passages_are_looked_for_once(spark):
    """Documents are taken apart once: the keys that they share with passages are kept."""
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "xone two threey"), (3, "a b"), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ne two three fou"), (2, "one two four"), (3, "a b"), (4, "e two t"), (5, "")], "item_id long, passage string")
    got = share_held(items, docs)
    assert tuple(got.first()) == (5, 4, 0.8)
    assert "split(text" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_batches(spark):
    values = [[f"v{i}" * (i % 5 + 1) for i in range(40)], [], ["x" * 2000, "y"]]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v array<string>").orderBy("i").select(df.batches(F.col("v"), 12, 60)).collect()]
    for batch, given_ in zip(got, values, strict=True):
        assert [x for b in batch for x in b] == given_
        assert all(len(b) <= 12 and (len(b) == 1 or sum(map(len, b)) <= 60) for b in batch)
        assert all(len(a) == 12 or sum(map(len, a)) + len(b[0]) > 60 for a, b in pairwise(batch))


def test_merge_touching_and_order(spark):
    boxes = spark.createDataFrame([(1, 0.0, 0.0, 2.0, 2.0), (1, 1.0, 1.0, 3.0, 3.0), (1, 9.0, 9.0, 10.0, 10.0), (2, 0.0, 0.0, 1.0, 1.0)], "page int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(map(tuple, df.merge_touching(boxes, ["page"]).collect())) == [(1, 0.0, 0.0, 3.0, 3.0), (1, 9.0, 9.0, 10.0, 10.0), (2, 0.0, 0.0, 1.0, 1.0)]
    two = spark.createDataFrame([(1, 1, 0.0, 0.0, 40.0, 9.0), (1, 2, 100.0, 0.0, 140.0, 9.0), (1, 3, 0.0, 40.0, 40.0, 49.0), (1, 4, 100.0, 40.0, 140.0, 49.0)], "page int, id long, x0 double, y0 double, x1 double, y1 double")
    assert [r["id"] for r in df.reading_order(two, ["page"], 200.0, 100.0).orderBy("place").collect()] == [1, 3, 2, 4]


def test_version_fold_equals_replay(spark):
    import random

    random.seed(3)
    events = [(d, n, random.randrange(3), random.choice(["publish", "withdraw", "restore", "reject"]), random.choice([None, random.randrange(4)])) for d in range(20) for n in range(15)]
    frame = spark.createDataFrame(events, "doc int, at int, version long, action string, expected int")
    got = {r["doc"]: (r["revision"], r["active"], r["refused"], dict(r["states"])) for r in lc.versions(frame, "doc", ["at"]).collect()}
    for doc in range(20):
        revision, active, refused, states = 0, None, 0, {}
        for _, _, version, action, expected in [e for e in events if e[0] == doc]:
            state = states.setdefault(version, "draft")
            fits = {"publish": ("draft",), "withdraw": ("published",), "restore": ("withdrawn", "superseded"), "reject": ("draft",)}[action]
            if state not in fits or expected not in (None, revision):
                refused += 1
                continue
            if action in ("publish", "restore"):
                states = {k: "superseded" if v == "published" else v for k, v in states.items()}
                states[version], active = "published", version
            else:
                states[version] = {"withdraw": "withdrawn", "reject": "rejected"}[action]
                active = None if action == "withdraw" and active == version else active
            revision += action != "reject"
        assert got[doc] == (revision, active, refused, states)


@pytest.mark.parametrize(
    ("name", "good"),
    [
        ("Plant_检验报告.pdf", True), ("Plant_检验报告_北线.pdf", True), ("Plant_检验报告_20240229_ZH_V2.pdf", True), ("Plant_检验报告_20230229.pdf", False), ("Plant_AX-1_总装图.pdf", True), ("Plant_AX 1_总装图.pdf", False),
        ("Plant.pdf", False), ("P_检验报告.pdf", False), ("drawing 1_检验报告.pdf", False), ("Plant_检验报告.exe", False), ("Plant_未知.pdf", False), (" Plant_检验报告.pdf", False), ("Plant_检验报告_ZH_北线.pdf", False), ("Pl:ant_检验报告.pdf", False),
    ],
)
def test_compliant_names(spark, name, good):
    assert column(spark, [name], rs.compliant) == [good]


def test_a_contract_is_data(spark):
    assert len(contract.BUSINESS_TYPES) == 75 and len(contract.EXTENSIONS) == 33 and len(contract.LANGUAGES) == 11
    names = [f"回转窑_{t}.pdf" for t in contract.BUSINESS_TYPES] + [f"回转窑_图纸_{x}.dwg" for x in contract.LANGUAGES] + [f"回转窑_图纸.{e}" for e in contract.EXTENSIONS]
    assert column(spark, names, rs.compliant) == [True] * len(names)
    assert column(spark, ["x" * 233 + "_图纸.pdf", "x" * 234 + "_图纸.pdf"], rs.compliant) == [True, False]


def test_ancestors_of_a_deep_chain_and_a_cycle(spark):
    rows = [(i, i - 1 if i else None) for i in range(70)] + [(100, 101), (101, 102), (102, 100)]
    got = {(r["id"], r["ancestor"]): r["depth"] for r in sec.ancestors(spark.createDataFrame(rows, "id long, parent long")).collect()}
    assert got[(69, 0)] == 69 and len(got) == 70 * 71 // 2 + 9


def test_principals(spark):
    users = spark.createDataFrame([("a", "user", "active", True, False), ("s", "superadmin", "active", True, False), ("n", "user", "active", False, False), ("b", "user", "active", False, True), ("d", "user", "disabled", True, False), ("g", "user", "active", True, False)], "principal_id string, account_role string, status string, has_password boolean, bound boolean")
    principals = spark.createDataFrame([(p, p != "g") for p in "asnbdg"], "principal_id string, active boolean")
    members = spark.createDataFrame([("a", "x", "publisher"), ("b", "y", "member"), ("s", "x", "member"), ("d", "x", "publisher")], "principal_id string, organization_id string, role string")
    orgs = spark.createDataFrame([("x",), ("y",), ("z",)], "organization_id string")
    got = {tuple(r) for r in sec.load_principals(users, principals, members, orgs, ["x", "z"]).select("principal_id", "organization_id", "role").collect()}
    assert got == {("a", "x", "publisher"), ("a", "z", "member"), ("b", "x", "member"), ("b", "y", "member"), ("b", "z", "member"), ("s", "x", "publisher"), ("s", "y", "publisher"), ("s", "z", "publisher")}


def test_explicit_labels(spark):
    rows = [("Karabakh Cement Plant", "x Karabakh cement-plant y", "Karabakh Cement Plant\nEPC contract", True), ("Karabakh Cement Plant", "x Karabakh cement plant y", "Karabakh Cement Plant\nnothing", False), ("Lime Project", "the lime project", "", True), ("", "x", "x", False), ("Other", "x", "x", False)]
    got = spark.createDataFrame(rows, "p string, s string, o string, w boolean").select(rs.explicit_label(F.col("p"), F.col("s"), F.col("o")).alias("g"), "w").collect()
    assert all(r["g"] == r["w"] for r in got)


def test_notices_and_numbers(spark):
    frame = spark.createDataFrame([(["a", "PDF 3 页扫描正文采用 OCR 提取；未调用视觉 API。", "a", "b"],), (None,)], "w array<string>")
    assert [r[0] for r in frame.select(notices.public(F.col("w"))).collect()] == [["a", "b"], []]
    pairs = spark.createDataFrame([("φ20.00 and ±0.5 x 1,5", "Ø20 ± 0.50 1,5"), ("R 7 and 45°", "r7 45"), ("AX210 is 3.10", "3.1")], "e string, s string")
    assert [r[0] for r in pairs.select(tx.numeric_gaps(F.col("e"), F.col("s"))).collect()] == [[], ["45°"], []]


def test_page_is_a_top_k_and_filters_reach_the_scan(spark, sf):
    plan = rq.hybrid_search(spark, sf)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
    scan = rq.filtered(spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [" in scan and "EqualTo(lang,en)" in scan


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "chunk_id long, rank int")
    b = spark.createDataFrame([(2, 1), (3, 2)], "chunk_id long, rank int")
    assert sorted(map(tuple, rt.fused(a, b).collect())) == sorted(map(tuple, rt.fused(b, a).collect()))
    assert rt.fused(a, b).orderBy(F.desc("score")).first()["chunk_id"] == 2


def test_references_fill_up(spark):
    scored = spark.createDataFrame([(1, i, i < 3, 0 if i != 1 else 50, i) for i in range(8)], "request_id int, project_id int, is_project boolean, score int, position int")
    assert sorted(r["project_id"] for r in rs.select_references(scored, "request_id").collect()) == [1, 3, 4]


def test_passages_are_held_with_long_or_few_words(spark, tmp_path):
    from lodestore import registry

    held = ["Erhand erndlyes.\nTheawhble erbleorsh oned two three four five", "short one", "a b c d e f"]
    texts = [f"x{held[0]} y", "a very short ones", f"q {held[2]} r", "one two three four five six seven eight nine"]
    missing = ["one two three four five six seven eight nine ten", "not there"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(held + missing)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = lambda name: registry.queries()[name](spark, str(tmp_path)).first()["found"]
    assert found("hits_agg17") == 4  # the first 40 characters of the fourth are held
    assert found("whole_hits_agg17") == 3


def test_nuls_are_replaced_in_whole_texts(spark, sf):
    import hashlib

    from lodestore import registry

    texts = {r["doc_id"]: r["text"].replace("e", " ") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n"], r["clean_sha256"]) for r in registry.queries()["nul_whole_str10"](spark, sf).collect()}
    assert max(map(len, texts.values())) > 200 and got == {i: (len(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in texts.items()}
