import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from lodestore.llm import registry, runs
from tests.conftest import rows
from tests.llm.conftest import same


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e, q) for (s, e), q in found.items())


def plain(doc_id, text, edited=True):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    n = len(words)
    if edited and doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    listed = "".join(f"{s},{e - s},{q}\n" for s, e, q in found)
    dropped = {i for s, e, q in found for i in range(s + q, e)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    s, e, q = min(found, key=lambda r: (r[0] - r[1], r[0], r[2]), default=(None, None, None))
    best = (None,) * 4 if s is None else (s, e - s, q, 1000 * (e - s) // q)
    return (doc_id, n, len(found), *best, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def drawn(rng, vocabulary, n):
    words = [rng.randrange(vocabulary) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n > 8 else 0):
        at, p = rng.randrange(n), rng.randint(1, 9)
        for i in range(at + p, min(n, at + rng.randint(1, 70))):
            words[i] = words[i - p]
    return words


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_random_texts(seed):
    rng = random.Random(seed)
    for _ in range(40):
        texts = [drawn(rng, rng.choice([1, 2, 3, 6, 40]), rng.choice([0, 1, 5, 6, 7, 24, 90, 200])) for _ in range(rng.randint(1, 6))]
        texts += texts[: rng.randint(0, 2)]
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        got = list(zip(*(x.tolist() for x in runs.find_runs(np.array([w for t in texts for w in t], np.int64), first)), strict=True))
        assert got == [(s + at, e + at, q) for t, at in zip(texts, first.tolist(), strict=False) for s, e, q in sorted(plain_runs(t), key=lambda r: (r[0], r[2]))]


def test_every_grammar_derives_its_texts():
    rng = random.Random(9)
    words = np.array(drawn(rng, 4, 900), np.int64)
    g = runs.Grammar(words, np.array([0, 300, 300, 900]))

    def expand(symbol):
        return [symbol] if symbol < g.terminals else expand(g.left[symbol - g.terminals]) + expand(g.right[symbol - g.terminals])

    assert [w for s in g.symbols.tolist() for w in expand(s)] == words.tolist() and len(g.symbols) < 700
    for r in range(g.made):
        assert expand(r + g.terminals) == words[g.start[r] : g.end[r]].tolist() and len(expand(g.left[r])) == g.mid[r] - g.start[r]
    apart = [pair for i, pair in enumerate(zip(g.symbols[:-1].tolist(), g.symbols[1:].tolist(), strict=True)) if g.joined[i] and pair[0] != pair[1]]
    assert g.made > 20 and len(apart) == len(set(apart))


def test_wrong_hashes_are_noticed(monkeypatch):
    tried = []

    class Wrong(runs.Equal):
        def __init__(self, words, seed):
            super().__init__(words, seed)
            tried.append(seed)

        def same(self, a, b, length):
            return super().same(a, b, length) | (tried[-1] < 2)

    monkeypatch.setattr(runs, "Equal", Wrong)
    words = [1, 2, 3] * 5 + [4, 3, 3, 3, 3, 3, 3, 1, 3]
    got = list(zip(*(x.tolist() for x in runs.find_runs(np.array(words), np.array([0, len(words)]))), strict=True))
    assert got == plain_runs(words) and tried[-1] == 2


def test_hard_words():
    thue = [bin(i).count("1") % 2 for i in range(2048)]
    for words in (thue, [0] * 3000, [0, 1] * 1500, ([0] * 7 + [1]) * 300):
        got = list(zip(*(x.tolist() for x in runs.find_runs(np.array(words), np.array([0, len(words)]))), strict=True))
        assert got == (plain_runs(words) if len(set(words)) > 1 and words is not thue else [] if words is thue else [(0, 3000, 1)])


def test_a_long_text_takes_little_more_than_its_share():
    rng = np.random.default_rng(4)
    words = rng.integers(0, 5000, 1_000_000)
    words[500_000:900_000] = np.resize(words[500_000:550_000], 400_000)
    began = time.perf_counter()
    start, end, period = runs.find_runs(words, np.array([0, len(words)]))
    assert (500_000, 50_000) in set(zip(start.tolist(), period.tolist(), strict=True)) and int((end - start).max()) >= 400_000
    assert time.perf_counter() - began < 60


def test_rows(spark, awkward, clashing, empty):
    mine = runs.periodic_runs(awkward, edited=True, texts=False)
    got = sorted((tuple(r) for r in mine.collect()), key=str)
    table = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect() if len(r["text"] or "") < 100_000]
    expected = sorted((plain(i, t) for i, t in table), key=str)
    assert [r for r in got if r[1] < 20_000] == expected and len(got) == awkward.count()
    assert same(mine, runs.periodic_runs(clashing, edited=True, texts=False)) and runs.periodic_runs(empty).collect() == []


def test_words_end_at_the_named_bytes_only(spark):
    text = "a\x1ca \x0ba\x0ca\ra\na\ta a   a a a a a a a"
    docs = spark.createDataFrame([(None, text), (3, " a  a\ta a a a ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in runs.periodic_runs(docs).collect()}
    assert tuple(got[None])[:7] == plain(None, text)[:7] and (got[3]["collapsed"], got[3]["n_runs"], got[3]["length"]) == ("a", 1, 6)


def test_query_against_brute_force(spark, sf, texts):
    got = sorted((tuple(r) for r in registry.op12_periodic_runs(spark, sf).collect() if r["n_words"] <= 1500), key=str)
    assert len(got) > 150 and got == sorted((plain(r[0], texts[r[0]]) for r in got), key=str)


def test_query_against_sql(spark, duck, sf):
    mine = registry.op12_periodic_runs(spark, sf)
    other = duck.execute(registry.oracle_sql()["op12_periodic_runs"])
    assert rows(mine.columns, [tuple(r) for r in mine.collect()]) == rows([d[0] for d in other.description], other.fetchall())
