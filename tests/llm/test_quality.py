import zlib

import numpy as np

from lodestore.llm import quality
from tests.llm.conftest import same


def test_held_out_accuracy(spark):
    import os

    sf = "/root/testdata/sf0.01" if os.path.isdir("/root/testdata/sf0.01") else "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = {r["doc_id"]: r for r in quality.score(docs, quality.fit(docs, labels)).collect()}
    known = [(scored[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in scored]
    tested = [(s, y) for s, y in known if s["held_out"]]
    assert all(s["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, s in scored.items())
    assert np.mean([s["predicted"] == y for s, y in tested]) >= 0.95


def test_batches_do_not_matter(texts):
    model = quality.train(list(texts.values())[:40], [i % 2 for i in range(40)], bits=12, epochs=1)
    together = quality.Scorer(model).score(list(texts.values()))
    assert np.allclose(together, [quality.Scorer(model).score([t])[0] for t in texts.values()])


def test_awkward(spark, awkward, clashing, empty):
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(20)] + [(None, 1, 1), (3, None, 1), (4, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(awkward, labels, epochs=1)
    rows = quality.score(awkward, model).collect()
    assert len(rows) == awkward.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    blank = {r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}
    assert len(blank) == 1
    assert same(quality.score(awkward, model), quality.score(clashing, model))
    assert quality.score(empty, model).count() == 0 and quality.keep_good(empty, model).columns == empty.columns
    assert quality.keep_good(awkward, model).count() == sum(r["predicted"] for r in rows)


def test_one_class_or_none_is_constant(spark, awkward, empty):
    none = quality.fit(awkward, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.Scorer(none).score(["a", ""]).tolist() == [0.5, 0.5]
    assert quality.Scorer(quality.train(["a"], [1])).score(["b"])[0] > 0.99


def plain_features(text, mask):
    """Buckets of a text, one by one: words, n-grams, pairs of neighbours."""
    words, out = text.split(), []
    for w in words:
        raw = w.encode()
        marked = b"<" + raw + b">"
        out.append(zlib.crc32(raw) & mask)
        out += [zlib.crc32(marked[i : i + n]) & mask for n in quality.NGRAMS for i in range(len(marked) - n + 1)]
    for a, b in zip(words, words[1:]):
        mixed = (zlib.crc32(a.encode()) * 0x9E3779B97F4A7C15 + zlib.crc32(b.encode()) * 0xC2B2AE3D27D4EB4F) % (1 << 64)
        out.append(0 if zlib.crc32(a.encode()) == zlib.crc32(b.encode()) else mixed >> 29 & mask)
    return out


def test_scores_are_those_of_a_plain_mean():
    rng = np.random.default_rng(3)
    model = quality.Model(rng.standard_normal(1 << 10).astype(np.float32), 0.25)
    texts = ["", "one", "one one two", "Für élan é", "a b c " * 40, "word " * 300]
    for text, got in zip(texts, quality.Scorer(model).score(texts), strict=True):
        found = plain_features(text, model.mask)
        mean = sum(float(model.table[b]) for b in found) / max(1, len(found))
        assert abs(got - 1 / (1 + np.exp(-(mean + 0.25)))) < 1e-9


def test_training_is_plain_gradient_descent(monkeypatch):
    """Two epochs of single documents, feature by feature, in double precision."""
    monkeypatch.setattr(quality, "LEAST_STEPS", 1)
    texts, labels, bits, dim, rate, epochs = ["good words here", "bad bad bad", "good text", "bad $$ text"], [1, 0, 1, 0], 8, 3, 0.4, 2
    got = quality.train(texts, labels, bits=bits, dim=dim, epochs=epochs, rate=rate, batch=1)
    rng = np.random.default_rng(7)
    vectors = ((rng.random((1 << bits, dim)) - 0.5) / dim).astype(np.float32).astype(float)
    out, bias, step = np.zeros((2, dim)), np.zeros(2), 0
    rows = [i for c in (0, 1) for i, y in enumerate(labels) if y == c]
    for _ in range(epochs):
        for d in rng.permutation(rows):
            found = plain_features(texts[d], (1 << bits) - 1)
            hidden = sum(vectors[b] for b in found) / len(found)
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max()) / np.exp(logits - logits.max()).sum()
            p[labels[d]] -= 1
            now, back = rate * (1 - step / (epochs * len(rows))), p @ out
            out, bias, step = out - now * np.outer(p, hidden), bias - now * p, step + 1
            for b in found:
                vectors[b] = vectors[b] - now * back / len(found)
    assert np.allclose(got.table, vectors @ (out[1] - out[0]), atol=1e-5) and abs(got.bias - (bias[1] - bias[0])) < 1e-5


def test_contradictions_repeats_and_bounds(spark):
    docs = spark.createDataFrame([(i, ("good text " if i % 2 else "bad $$$ ") * 20) for i in range(60)] + [(1, "another text of this id")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(2, 1), (4, 1), (6, 7)], "doc_id long, quality int")
    one, two = quality.fit(docs, labels, epochs=1), quality.fit(docs.repartition(7), labels, epochs=1)
    assert (one.table == two.table).all() and one.bias == two.bias
    small = quality.fit(docs, labels, chars=900, epochs=1)
    assert small.table.any()
