import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestore.llm import substring_dedup as sd
from tests.llm.conftest import same


def brute(texts, length):
    """(n_words, n_removed, kept_sha256) of each row of (id, text), in the order given."""
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    first = {}
    for i, w in words:
        for k in range(len(w) - length + 1):
            if i is not None:
                at = tuple(w[k : k + length])
                first[at] = min(first.get(at, i), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if i is not None and first[tuple(w[k : k + length])] < i:
                gone[k : k + length] = [True] * length
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((i, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def check(frame, length=50, gram=12):
    got = sorted(map(str, ((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in sd.repeats(frame, length, gram).collect())))
    assert got == sorted(map(str, brute([(r["doc_id"], r["text"]) for r in frame.select("doc_id", "text").collect()], length)))


def test_documents(docs):
    check(docs)


@pytest.mark.parametrize(("length", "gram"), [(5, 2), (8, 8), (3, 1)])
def test_dense_repeats(spark, docs, length, gram):
    """Texts of few different words, with windows that repeat everywhere."""
    import random

    random.seed(length)
    rows = [(random.randrange(60), " ".join(random.choice("ab") for _ in range(random.randrange(30)))) for _ in range(80)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), length, gram)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.lists(st.sampled_from("abc"), max_size=25).map(" ".join)), min_size=1, max_size=12))
def test_any(spark, rows):
    check(spark.createDataFrame(rows, "doc_id long, text string"), 4, 2)


def test_awkward(awkward, clashing, empty):
    check(awkward)
    assert same(sd.repeats(awkward), sd.repeats(clashing))
    assert sd.repeats(empty).count() == 0


def test_spans_are_maximal(spark):
    same_ = " ".join(f"s{i}" for i in range(60))
    rows = spark.createDataFrame([(1, f"a b {same_} c"), (2, f"x {same_} y z")], "doc_id long, text string")
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in sd.repeats(rows).collect()}
    assert spans == {1: [], 2: [(1, 61, 1, 2)]}


def test_equal_hashes_of_other_words_remove_nothing(spark):
    """With word hashes that collide throughout, hashes propose everything; the words themselves decide."""
    import numpy as np

    def one(data, starts, ends, lower):
        return np.full(len(starts), 7, np.uint64)

    rows = [(1, " ".join(f"a{i}" for i in range(40))), (2, " ".join(f"b{i}" for i in range(40)))]
    got = sd.repeats(spark.createDataFrame(rows, "doc_id long, text string"), 10, 3, hashed=one).collect()
    assert [r["n_removed"] for r in got] == [0, 0] and all(r["spans"] == [] for r in got)
