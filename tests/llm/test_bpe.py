import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestore.llm import bpe
from tests.llm.conftest import same

public = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def reference():
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(**bpe.public_codec())


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text_as_tiktoken_and_back(reference, codec, text):
    (ids,) = codec.encode([text])
    assert ids.tolist() == reference.encode_ordinary(text)
    assert codec.decode_bytes(ids) == text.encode()
    starts, ends = codec.offsets(text, ids)
    assert all(codec.decode_bytes(ids[k : k + 1]) in text[s:e].encode() for k, (s, e) in enumerate(zip(starts, ends, strict=True)))


def test_special_strings_are_text(reference, codec):
    text = "a<|endoftext|>b 's don't\u0085  x"
    assert next(codec.encode([text])).tolist() == reference.encode_ordinary(text)


def test_long_matches_are_not_kept_without_bound(reference, codec):
    """Each text is one match of 60,000 letters: few matches, many characters."""
    codec._forget()
    letters = "".join(chr(97 + k * k % 26) for k in range(60_000))
    texts = [letters[k:] + letters[:k] for k in range(1, 201)]
    most = 0
    for text in texts:
        (ids,) = codec.encode([text])
        most = max(most, sum(map(len, codec.slot_of)))
    assert most <= 5_000_000 and codec.decode(ids) == texts[-1] and ids.tolist() == reference.encode_ordinary(texts[-1])


def test_split_characters(codec):
    (ids,) = codec.encode(["漢😀"])
    assert len(ids) > 2 and codec.decode(ids[:1]) == "�" or codec.decode(ids) == "漢😀"


def test_documents(docs, texts, reference):
    for r in bpe.round_trip(docs).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_awkward(awkward, clashing, empty):
    back = bpe.decode(bpe.encode(awkward))
    assert sorted(str(r["text"]) for r in back.collect()) == sorted(str(r["text"] or "") for r in awkward.select("text").collect())
    assert same(bpe.round_trip(awkward), bpe.round_trip(clashing))
    assert bpe.round_trip(empty).count() == 0 and bpe.encode(empty).count() == 0
