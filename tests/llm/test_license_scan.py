import re
import time

from pyspark.sql import functions as F

from lodestore.llm import license_scan as ls
from lodestore.llm.common import LOWER, UPPER
from tests.conftest import rows
from tests.llm.conftest import same


def brute(text):
    low = (text or "").translate(str.maketrans(UPPER, LOWER))
    words, found = re.findall(ls.WORD, low), []
    for phrase, label in ls.PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    labels, score = {x for _, x in found}, 1.0 if found else 0.0
    for label, template in ls.TEMPLATES:
        want, n = set(template.split()), ls.block_length(len(template.split()))
        for i in range(len(words)):
            share = len(want & set(words[i : i + n])) / len(want)
            if share >= ls.THRESHOLD - 1e-9:
                labels.add(label)
                score = max(score, share)
    starts = [i for i, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found})), ",".join(sorted(labels)), score


def check(frame, texts):
    for r in ls.scan(frame).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == brute(texts[r["doc_id"]])


def test_against_brute_force(docs, texts, spark):
    check(docs, texts)
    more = {
        1: "Under the MIT license under THE mit License", 2: "licensed under the Apache License", 3: "apache license, version 2.0; cc-by-nc", 4: "under the kmit license", 5: "All rights\nreserved.", 6: "under the mıt license",
        7: "This work is licensed under the GNU General Public License, version", 8: "x under the mit", 9: None, 10: "underéthe mit license cc by nc",
    }
    check(spark.createDataFrame(list(more.items()), "doc_id long, text string"), more)


def test_awkward(awkward, clashing, empty):
    assert ls.scan(awkward).count() == awkward.count()
    assert same(ls.scan(awkward), ls.scan(clashing))
    assert ls.scan(empty).count() == 0


def test_wrapped_and_commented_templates(spark):
    """Hard-wrapped, behind comment marks, re-wrapped at another width, with words changed, and spread too far."""
    import textwrap

    grant, bsd = ls.TEMPLATES[1][1], ls.TEMPLATES[5][1]
    wrapped = {1: textwrap.fill(grant, 40), 2: textwrap.indent(textwrap.fill(bsd, 30), "# "), 3: textwrap.indent(textwrap.fill(grant.upper(), 55), " * "), 4: textwrap.indent(textwrap.fill(bsd, 25), "// ")}
    words = grant.split()
    changed = {10: " ".join(w if k % 8 else "changed" for k, w in enumerate(words)), 11: " ".join(w if k % 3 else "changed" for k, w in enumerate(words)), 12: " filler ".join(words), 13: "All rights\nreserved", 14: "license " * 5000, 15: "the mit license under the mit license"}
    texts = {i: f"some words before\n{t}\nand words after" for i, t in (wrapped | changed).items()}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check(frame, texts)
    got = {r["doc_id"]: r for r in ls.scan(frame).collect()}
    assert [got[i]["labels"] for i in range(1, 5)] == ["mit", "bsd", "mit", "bsd"] and all(got[i]["score"] == 1.0 for i in range(1, 5))
    assert got[10]["labels"] == "mit" and got[11]["labels"] == "" and got[12]["labels"] == ""
    for r in got.values():
        for b in r["blocks"]:
            template = set(ls.TEMPLATES[b["template"]][1].split())
            block = re.findall(ls.WORD, texts[r["doc_id"]].lower())[b["first"] : b["first"] + ls.block_length(len(ls.TEMPLATES[b["template"]][1].split()))]
            assert len(template & set(block)) / len(template) == b["containment"] >= ls.THRESHOLD


def test_same_as_sql(docs, duck):
    mine = ls.scan(docs).drop("blocks")
    other = duck.execute(ls.oracle())
    assert rows(mine.columns, map(tuple, mine.collect())) == rows([d[0] for d in other.description], other.fetchall())


def test_no_python_on_the_main_path(spark, docs):
    from lodestore.llm.common import text_or_empty

    texts = docs.select("doc_id", text_or_empty(docs["text"]).alias("_text"))
    patterns = ls._patterns(spark, ls.TEMPLATES, ls.PHRASES)
    assert "Python" not in ls._index(patterns.hint("broadcast"), texts, 0.8)._jdf.queryExecution().executedPlan().toString()


def test_words_are_those_of_the_ranges_at_less_cost(spark):
    """Every character below U+0800 and some above, between letters; and a long text, against the patterns of ranges."""
    ranges = {ls.LOW_WORD: ls.WORD, ls.ANY_WORD: r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}
    texts = [f"a{chr(c)}b {chr(c)}{chr(c)}" for c in (*range(0x800), 0x2028, 0x212A, 0xFEFF, 0xFFFD, 0x1F600, 0x10FFFF)]
    some = spark.createDataFrame([(t,) for t in texts], "text string")
    long = spark.range(8).select(F.repeat(F.lit("Lorem ipsum, dolor 42 sit-amet\n"), 30_000).alias("text"), "id").localCheckpoint()
    for mine, theirs in ranges.items():
        assert [re.findall(mine, t) for t in texts] == [re.findall(theirs, t) for t in texts]
        assert some.filter(F.regexp_extract_all("text", F.lit(mine), F.lit(0)) != F.regexp_extract_all("text", F.lit(theirs), F.lit(0))).count() == 0
        took = {mine: [], theirs: []}
        for pattern in [mine, theirs] * 3:
            begun = time.perf_counter()
            assert long.agg(F.sum(F.regexp_count("text", F.lit(pattern)))).first()[0] == 8 * 30_000 * 6
            took[pattern].append(time.perf_counter() - begun)
        assert min(took[mine]) < 0.6 * min(took[theirs])
