"""The pipeline's stages against what they should do to rows that are known."""

import corpus_pipeline as cp
from pyspark.sql import functions as F

from lodestore.llm import bpe, near_dedup, quality, secrets
from lodestore.llm.common import table
from tests.llm.conftest import same
from tests.llm.test_near_dedup import shingles


def test_names_and_order():
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "MinHash near-dedup", "secret scans", "mixing sources to target weights", "byte-level BPE encoding and decoding"]


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    good = cp.quality_stage(spark, docs, sf)
    model = quality.fit(docs, table(spark, sf, "labels"))
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.select("doc_id").collect()} == {r["doc_id"] for r in quality.score(docs, model).filter("predicted = 1").collect()}
    single = cp.near_dedup_stage(spark, good, sf)
    assert single.columns == docs.columns
    assert {r["doc_id"] for r in single.select("doc_id").collect()} == {r["doc_id"] for r in near_dedup.near_duplicates(good).filter("kept").collect()}
    clean = cp.secret_stage(spark, single, sf)
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert all(r["n_chars"] == len(r["text"]) and secrets.MASK in r["text"] for r in clean.join(single.select("doc_id", single["text"].alias("old")), "doc_id").filter("text <> old").collect())
    mixed = cp.mixing_stage(spark, clean, sf)
    assert mixed.columns == docs.columns and set(mixed.collect()) <= set(clean.collect())
    assert sorted(map(tuple, cp.bpe_stage(spark, mixed, sf).collect())) == sorted(map(tuple, bpe.round_trip(mixed).collect()))


def test_stages_on_awkward_rows(spark, sf, awkward, empty):
    for docs in (awkward, empty):
        for _, stage in cp.STAGES[:-1]:
            docs = stage(spark, docs, sf)
            assert docs.columns == awkward.columns
        assert cp.STAGES[-1][1](spark, docs, sf).count() == docs.count()


#: Names that stages give to outputs or use inside.
INNER = (
    "score", "redacted", "findings", "rest", "last", "whole", "cut_bin", "_source", "_key", "_size", "_bin", "_time", "_cut", "_nd_id", "_nd_t", "_nd_verdict", "_text", "_found", "_gaps", "_scores", "_features", "_redacted", "kept",
    "component_id", "n_shingles", "id", "t", "token_ids", "n_tokens", "_score", "predicted", "held_out", "epochs", "taken",
)


def plain_dedup(rows):
    """(id, text) of the rows that stay, by all pairs of texts with an id."""
    texts = sorted({(i, t or "") for i, t in rows if i is not None and shingles(t, 5)})
    sets, up = [shingles(t, 5) for _, t in texts], list(range(len(texts)))

    def find(i):
        return i if up[i] == i else find(up[i])

    for k in range(len(texts)):
        for j in range(k):
            if 100 * len(sets[k] & sets[j]) >= 80 * len(sets[k] | sets[j]):
                a, b = find(k), find(j)
                up[max(a, b)] = min(a, b)
    heads = {}
    for k, row in enumerate(texts):
        heads.setdefault(find(k), []).append(row)
    free = {(i, t) for i, t in rows if i is None or not shingles(t, 5)}
    return free, list(heads.values())


def test_dedup_of_repeated_ids_and_rows(spark, sf):
    words = lambda seed, n=30: " ".join(f"{seed}{i}" for i in range(n))
    rows = [(1, words("a")), (2, words("a")), (2, words("b")), (2, words("b")), (3, words("c")), (3, words("d")), (4, words("c") + " more"), (None, words("a")), (None, words("e")), (None, words("e")), (5, None), (5, ""), (5, ""), (6, "  "), (7, words("d", 29))]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in cp.near_dedup_stage(spark, docs, sf).collect()]
    free, groups = plain_dedup(rows)
    assert len(got) == len(set(got)) == len(free) + len(groups)
    assert free <= set(got)
    for group in groups:
        kept = [row for row in got if row in group]
        assert len(kept) == 1 and kept[0][0] == group[0][0]


def test_clashing_columns_pass_every_stage(spark, sf, awkward):
    more = awkward.select("*", *(F.lit(k).alias(c) for k, c in enumerate(INNER)))
    plain, wide = awkward, more
    for _, stage in cp.STAGES[:-1]:
        plain, wide = stage(spark, plain, sf), stage(spark, wide, sf)
        assert wide.columns == more.columns
        assert same(plain, wide.select(awkward.columns))
        assert wide.select(*INNER).distinct().count() <= 1
    assert same(cp.STAGES[-1][1](spark, plain, sf), cp.STAGES[-1][1](spark, wide, sf))


def test_nothing_stays_but_results(spark, sf, awkward):
    """Intermediate tables are deleted: what is left in the shared folder is the result alone, and it can be dropped."""
    import os

    from lodestore.llm import mixing, registry, sharding, substring_dedup
    from lodestore.llm.common import drop_materialized

    shared = f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/lodestore-{spark.sparkContext.applicationId}"
    left = lambda: set(os.listdir(shared)) if os.path.isdir(shared) else set()
    before = left()
    for make in (lambda: sharding.shard(awkward), lambda: registry.op5_chroma(spark, sf), lambda: mixing.mix(awkward), lambda: substring_dedup.repeats(awkward), lambda: near_dedup.near_duplicates(awkward)):
        found = make()
        assert found.count() and len(left() - before) == 1
        drop_materialized(found)
        assert left() == before
    assert all(r["n_tokens"] > 0 for r in cp.run(spark, sf).collect())
    assert len(left() - before) == 1  # the last stage reads what the one before wrote
