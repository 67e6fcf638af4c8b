import hashlib

import pytest

from lodestore.operators import embedding as em
from lodestore.sources import uploads


def test_embed_degrades_by_batch(spark):
    class Failing(em.HashedModel):
        def __call__(self, texts):
            if "bad" in texts:
                raise RuntimeError
            return super().__call__(texts)

    rows = spark.createDataFrame([(1, "a b"), (2, "bad"), (3, None)], "chunk_id long, text string").coalesce(1)
    got = {r["chunk_id"]: r["embedding"] for r in em.embed(rows, Failing(8), "m", batch=1).collect()}
    assert len(got[1]) == 8 and got[2] is None and got[3] is None


def test_query_cache():
    now, calls = [0.0], []
    cache = em.QueryCache(lambda q: calls.append(q[0]) or [[1.0]], most=2, ttl=10, longest=5, clock=lambda: now[0])
    for q in ("a", "a", "b", "a", "c", "b", "toolong", "toolong"):
        cache(q)
    assert calls == ["a", "b", "c", "b", "toolong", "toolong"]
    now[0] = 11
    cache("b")
    assert calls[-1] == "b"


def test_uploads(tmp_path):
    assert uploads.store(str(tmp_path), "k", [b"ab", b"c"]) == (3, hashlib.sha256(b"abc").hexdigest())
    with pytest.raises(uploads.TooLarge):
        uploads.store(str(tmp_path), "big", [b"x" * 10], most=5)
    assert [p.name for p in tmp_path.iterdir()] == ["k"]
