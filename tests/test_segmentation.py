"""Learned words and best paths, against plain versions."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lodestore.operators.postings import Postings
from lodestore.operators.segmentation import BEGIN, END, Segmenter, Vocabulary, learn
from lodestore.plans.text import segmented_documents, unspaced, vocabulary_of

SENTENCES = ("最高工作温度为八十摄氏度", "工作温度不得超过八十摄氏度", "摄氏度是温度的单位", "设备的工作温度", "最高温度与最低温度", "回转窑的工作方式", "窑内温度很高", "工作人员记录摄氏度", "高温回转窑设备", "最高的设备")


def plain_vocabulary(runs, longest=4, least=5, cohesion=3.0, variety=0.6):
    counts = Counter(m[i : i + k] for r in runs for m in [BEGIN + r + END] for i in range(len(m)) for k in range(1, longest + 2) if i + k <= len(m))
    own = {g: n for g, n in counts.items() if BEGIN not in g and END not in g and len(g) <= longest}
    total = sum(n for g, n in own.items() if len(g) == 1)
    after, before = defaultdict(list), defaultdict(list)
    for g, n in counts.items():
        if len(g) > 1:
            after[g[:-1]].append(n) if g[0] != BEGIN else None
            before[g[1:]].append(n) if g[-1] != END else None
    entropy = lambda ns: math.log(sum(ns)) - sum(n * math.log(n) for n in ns) / sum(ns)
    out = {g: n for g, n in own.items() if len(g) == 1}
    for g, n in own.items():
        if len(g) > 1 and n >= least and min(math.log(n * total / (own[g[:k]] * own[g[k:]])) for k in range(1, len(g))) >= cohesion - 1e-9 and min(entropy(after[g]), entropy(before[g])) >= variety - 1e-9:
            out[g] = n
    return out


def plain_cut(words, unknown, run, longest=8):
    """Log probability of the best path, forward, by all words that end at each place."""
    best = [0.0]
    for j in range(1, len(run) + 1):
        options = [best[i] + p for i in range(max(0, j - longest), j) if (p := words.get(run[i:j], unknown if j - i == 1 else None)) is not None]
        best.append(max(options))
    return best[-1]


def test_learned_words(spark):
    rng = random.Random(1)
    runs = [rng.choice(SENTENCES) + rng.choice(SENTENCES) for _ in range(120)]
    texts = spark.createDataFrame([(f"A1 {r}, und {r[:5]}",) for r in runs] + [(None,), ("",), ("keine Zeichen",)], "text string")
    got = {r["word"]: r["n"] for r in learn(texts).collect()}
    assert got == plain_vocabulary([x for r in runs for x in (r, r[:5])])
    loose = {r["word"] for r in learn(texts, cohesion=1.0).collect()}
    assert {"温度", "摄氏度", "设备", "工作"} <= loose and not {"作温", "氏度", "度为", "的设"} & loose
    assert [r["word"] for r in learn(texts, most=3).collect()] == [w for w, _ in sorted(got.items(), key=lambda t: (-t[1], t[0]))[:3]]
    assert learn(texts.limit(0)).count() == 0


def test_best_path_and_search_mode():
    v = Vocabulary.of({"回转": 5, "回转窑": 9, "转窑": 1, "摄氏": 2, "摄氏度": 20, "度": 30, "工作温度": 9, "工作": 10, "温度": 10, "作温度": 1, "温": 1})
    assert v.cut("回转窑工作温度摄氏度") == ["回转窑", "工作温度", "摄氏度"] and v.cut("") == []
    assert v.search("回转窑工作温度x度") == ["回转", "转窑", "回转窑", "工作", "温度", "作温度", "工作温度", "x", "度"]
    rng = random.Random(2)
    for _ in range(200):
        counts = {"".join(rng.choices("abcd", k=rng.randint(1, 4))): rng.randint(1, 50) for _ in range(rng.randint(0, 25))}
        v, run = Vocabulary.of(counts), "".join(rng.choices("abcde", k=rng.randint(0, 25)))
        cut = v.cut(run)
        assert "".join(cut) == run
        assert math.isclose(sum(v.words.get(w, v.unknown) for w in cut), plain_cut(v.words, v.unknown, run), abs_tol=1e-9)


def test_tokens_and_search(spark, tmp_path):
    vocabulary = spark.createDataFrame([("摄氏度", 20), ("摄氏", 2), ("温度", 10), ("工作", 9), ("最高", 5), ("为", 1)], "word string, n long")
    segmenter = Segmenter(vocabulary)
    rows = spark.createDataFrame([(0, "AX-210 最高工作温度为 80 摄氏度"), (1, None), (2, "温工作"), (3, "plain WORDS")], "i int, text string")
    got = {r["i"]: r["t"] for r in rows.select("i", segmenter.tokens(F.col("text")).alias("t")).collect()}
    assert got == {0: ["最高", "工作", "温度", "为", "摄氏", "摄氏度", "ax", "210", "80", "ax-210"], 1: [], 2: ["温", "工作"], 3: ["plain", "words"]}
    index = Postings(spark, str(tmp_path / "i"), buckets=4, tokens=segmenter.tokens)
    index.build(rows.select(F.col("i").cast("long").alias("doc_id"), F.lit(0).alias("ordinal"), "text"))
    assert [r["doc_id"] for r in index.holding(["摄氏"]).collect()] == [0] and sorted(r["doc_id"] for r in index.holding(["工作", "plain"]).collect()) == [0, 2, 3]


@pytest.mark.parametrize("search", [False, True])
def test_documents_against_a_plain_program(spark, sf, search):
    """The texts have blanks, which are taken out first."""
    learned = vocabulary_of(spark, sf)
    segmenter = Segmenter(learned, r"\p{L}+")
    texts = unspaced(spark, sf).filter("length(text) < 4000")
    got = texts.select("text", segmenter.words(F.split("text", " "), search).alias("w")).collect()
    v = segmenter.vocabulary
    longer = 0
    for r in got[:60]:
        for run in [r["text"]] if r["text"] else []:
            cut = v.cut(run)
            assert math.isclose(sum(v.words.get(w, v.unknown) for w in cut), plain_cut(v.words, v.unknown, run), rel_tol=1e-9)
            inner = [x for w in cut for x in [*(w[i : i + k] for k in range(2, len(w)) for i in range(len(w) - k + 1) if w[i : i + k] in v.words), w]]
            assert r["w"] == (inner if search else cut)
            longer += len(inner) > len(cut)
    assert longer > 10


def test_texts_are_cut_in_lean_batches(spark, sf):
    """Once, beside their words and not in a join, by batches that bound what a worker holds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    plan = segmented_documents(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("ArrowEvalPython") <= 1 and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1000"
    v = Vocabulary.of({"ab": 3, "abc": 9, "bc": 2})
    assert v.with_inner(v.cut("abcab")) == v.search("abcab") == ["ab", "bc", "abc", "ab"]
