import hashlib
from itertools import groupby

import numpy as np

from lodestore.llm import fingerprints as fp
from tests.llm.conftest import same


def test_against_brute_force(docs, texts):
    rows = {r["doc_id"]: r for r in fp.edited_likeness(docs).collect()}
    ids, own = sorted(texts), fp.Parser()
    assert sorted(rows) == ids
    for k, i in enumerate(ids):
        text, following = texts[i], texts[ids[(k + 1) % len(ids)]]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + following[:quarter]
        s = own.sketches([text, edited, following])
        assert rows[i]["n_chars"] == len(text) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert [rows[i]["fingerprint"], rows[i]["edited_fingerprint"]] == [x.astype(">u2").tobytes().hex() for x in s[:2]]
        assert rows[i]["near_edited"] == fp.likeness(s[:1], s[1:2])[0] and rows[i]["near_next"] == fp.likeness(s[:1], s[2:])[0]
    long = [r for r in rows.values() if r["n_chars"] > 400]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.98 and np.median([r["near_edited"] for r in long]) > 0.5


def test_interior_is_parsed_alike_at_any_offset():
    own = fp.Parser()
    rng = np.random.default_rng(1)
    core = rng.integers(0, 50, 5000).astype(np.uint64)
    names = []
    for lead in (0, 1, 7, 100):
        x = np.concatenate([rng.integers(0, 50, lead).astype(np.uint64), core])
        for _ in range(2):
            x, _ = own.level(x, np.array([0, len(x)]))
        names.append(set(x.tolist()))
    assert min(len(names[0] & n) / len(names[0]) for n in names) > 0.98


def test_runs_and_awkward(awkward, clashing, empty):
    own = fp.Parser()
    assert own.sketches(["a" * 10_000, "", "ab" * 5000]).shape == (3, fp.BINS + fp.LOW_BINS)
    rows = fp.edited_likeness(awkward).collect()
    assert len(rows) == awkward.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    prints = {}
    for r in fp.fingerprint(awkward).join(awkward.select("doc_id", "text").distinct(), "doc_id").collect():
        assert prints.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]
    assert same(fp.edited_likeness(awkward), fp.edited_likeness(clashing))
    assert fp.edited_likeness(empty).count() == 0


def test_one_document_is_its_own_successor(spark):
    (row,) = fp.edited_likeness(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert row["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and row["near_next"] == 1


BITS = (1 << 64) - 1


def mixed(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = ((x ^ (x >> 33)) * factor) & BITS
    return x ^ (x >> 33)


def plain_level(x):
    """One level of the parse, symbol by symbol."""
    runs = [(k, len(list(g))) for k, g in groupby(x)]
    x = [k if n == 1 else mixed((k + n * 0x9E3779B97F4A7C15) & BITS) for k, n in runs]
    lowest = lambda v: (v & -v).bit_length() - 1 if v else 0
    tossed = lambda a, b: 2 * lowest(a ^ b) + (b >> lowest(a ^ b) & 1)
    label = [128 + (x[0] & 1), *(tossed(a, b) for a, b in zip(x, x[1:]))]
    for _ in range(2):
        label = [16 + (label[0] & 1), *(tossed(a, b) for a, b in zip(label, label[1:]))]
    begins = [0, *(i for i in range(2, len(x) - 1) if label[i - 1] < label[i] > label[i + 1]), len(x)]
    phrases = [x[a:b] for a, b in zip(begins, begins[1:])]
    return [mixed((sum(v * pow(0xA0761D6478BD642F, j, 1 << 64) for j, v in enumerate(p)) + len(p)) & BITS) for p in phrases]


def plain_sketch(text):
    out = [fp.EMPTY] * (fp.BINS + fp.LOW_BINS)
    least, x = {}, [ord(c) for c in text]
    for k in range(1, max(fp.LEVELS) + 1):
        x = plain_level(x) if x else []
        for name in x:
            if k == 1 or k in fp.LEVELS:
                b = (name >> 48) % fp.BINS if k in fp.LEVELS else fp.BINS + (name >> 48) % fp.LOW_BINS
                least[b] = min(least.get(b, BITS), name >> 12 & 0xFFFFFFFF)
    for b, v in least.items():
        out[b] = mixed(v) % fp.EMPTY
    return out


def plain_likeness(a, b):
    few = max(sum(v != fp.EMPTY for v in s[: fp.BINS]) for s in (a, b)) < fp.FEW
    pairs = [(p, q) for k, (p, q) in enumerate(zip(a, b)) if (k < fp.BINS or few) and (p, q) != (fp.EMPTY, fp.EMPTY)]
    return sum(p == q for p, q in pairs) / len(pairs) if pairs else 1.0


def test_same_as_a_plain_parse(docs):
    """Symbol by symbol; texts at the edge of ``FEW`` filled bins among them, and a very long one in pieces' terms."""
    found = [r["text"] for r in docs.filter("length(text) < 1500").orderBy("doc_id").limit(12).collect()]
    found += ["", "a", "ab", "a" * 500, "abab" * 50, *(found[0][: 40 * k] for k in range(1, 9))]
    sketches = fp.Parser().sketches(found)
    plain = [plain_sketch(t) for t in found]
    assert sketches.tolist() == plain
    for i in range(len(found)):
        j = (i + 1) % len(found)
        assert fp.likeness(sketches[i : i + 1], sketches[j : j + 1])[0] == plain_likeness(plain[i], plain[j]) == fp.likeness(sketches[j : j + 1], sketches[i : i + 1])[0]


def test_repeated_ids_and_nulls_are_dealt_by_text(spark):
    """An id of most rows, and null ids, stand in several parts; every row still meets its successor."""
    rows = [(None, f"nobody {i}") for i in range(300)] + [(7, f"same id {i} and some text") for i in range(400)] + [(i, f"text {i}") for i in range(5, 60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    parts = fp.with_next(frame).collect()
    assert len({r["part"] for r in parts if r["id"] == 7}) > 1 and len({r["part"] for r in parts if r["id"] is None}) > 1
    hashed = {r["text"]: r["h"] for r in frame.selectExpr("text", "xxhash64(text) h").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1]]))
    wanted = sorted(hashlib.sha256((t[: len(t) - len(t) // 4] + order[(k + 1) % len(order)][1][: len(t) // 4]).encode()).hexdigest() for k, (_, t) in enumerate(order))
    assert sorted(r["edited_sha256"] for r in fp.edited_likeness(frame).collect()) == wanted
