"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

``Codec`` wraps a vocabulary. A token is a run of UTF-8 bytes, so one character may be split over several
tokens: offsets are therefore computed on bytes and then mapped to characters (a token that begins or ends
inside a character covers the whole of it), and decoding concatenates bytes before reading them as UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import lean_batches, text_or_empty, worker_state

#: Characters that are encoded together; bounds the memory of the library's encodings.
CHUNK_CHARS = 100_000
#: Matches of the pattern, and their characters, whose ids a worker keeps before it starts anew; they bound its memory.
KEPT, KEPT_CHARS = 200_000, 4_000_000


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), then those of the next."""
    upto = np.cumsum(counts)
    return np.repeat(starts - (upto - counts), counts) + np.arange(upto[-1] if len(upto) else 0)


class Codec:
    """Ids by the ranks in ``ranks_path``; ``model_path`` holds the same vocabulary with its merges.

    Strings of special tokens are ordinary text. The text is split by ``pattern``; each match is encoded
    separately, and each distinct match of a chunk once: natural text repeats its words.
    """

    def __init__(self, model_path: str, ranks_path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.decimal = [str(i) for i in range(len(table))]
        self.lengths = np.array([len(b) for b in table], dtype=np.int64)
        self.offset_of = np.cumsum(self.lengths) - self.lengths
        self.flat_bytes = np.frombuffer(b"".join(table), dtype=np.uint8)
        self.tokenizer = Tokenizer.from_file(model_path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.matches = regex.compile(pattern).findall
        self._forget()

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= CHUNK_CHARS):
                chars += len(texts[end])
                end += 1
            split = [self.matches(t) for t in texts[at:end]]
            slots = self._slots(list(chain.from_iterable(split)))
            n = self.counts[slots]
            ids = self.flat[_ranges(self.starts[slots], n)]
            upto = np.concatenate([[0], np.cumsum(n)])[np.cumsum([0, *map(len, split)])]
            yield from (ids[i:j] for i, j in zip(upto[:-1], upto[1:], strict=True))
            at = end

    def joined(self, ids: np.ndarray) -> str:
        """Decimal ids joined by one space."""
        return " ".join(map(self.decimal.__getitem__, ids.tolist()))

    def _forget(self) -> None:
        self.slot_of: dict[str, int] = {}
        self.kept_chars = 0
        self.starts, self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def _slots(self, matches: list[str]) -> np.ndarray:
        """Where the ids of each match are kept; new matches are encoded first, each once."""
        if len(self.slot_of) > KEPT or self.kept_chars > KEPT_CHARS:
            self._forget()
        new = list(set(matches).difference(self.slot_of))
        if new:
            got = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
            n = np.bincount(np.array(got.word_ids, dtype=np.int64), minlength=len(new))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(n) - n])
            self.counts = np.concatenate([self.counts, n])
            self.flat = np.concatenate([self.flat, np.array(got.ids, dtype=np.int32)])
            self.kept_chars += sum(map(len, new))
            self.slot_of.update(zip(new, range(len(self.slot_of), len(self.slot_of) + len(new)), strict=True))
        return np.fromiter(map(self.slot_of.__getitem__, matches), np.int64, len(matches))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        return self.flat_bytes[_ranges(self.offset_of[ids], n)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of whole sequences; of a slice that cuts characters, with U+FFFD for the incomplete ones."""
        return self.decode_bytes(ids).decode("utf-8", "replace")

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and past-the-last character of each token."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        char_of = np.cumsum((raw & 0xC0) != 0x80) - 1
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        return char_of[starts].astype(np.int32), (char_of[ends - 1] + 1).astype(np.int32)


def public_codec() -> dict[str, str]:
    """Arguments of ``Codec`` for the 50k byte-level vocabulary of the installed tokenizer files."""
    import public_tokenizers as P

    return {"model_path": P.path("byte_bpe_50k.json"), "ranks_path": P.path("byte_bpe_50k.tiktoken"), "pattern": P.PATTERN}


def encode(docs: DataFrame, codec: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``token_ids``, ``char_starts``, ``char_ends`` (arrays of int). Null texts are empty: empty arrays."""
    made = codec or public_codec()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state("bpe", lambda: Codec(**made), *sorted(made.items()))
        ints = pa.list_(pa.int32())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = list(own.encode(texts))
            spans = [own.offsets(t, i) for t, i in zip(texts, ids, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, ints), pa.array([s for s, _ in spans], ints), pa.array([e for _, e in spans], ints)],
                names=["_id", "token_ids", "char_starts", "char_ends"],
            )

    cols = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(F.col(text_col)).alias("_text"))
    return lean_batches(cols).mapInArrow(run, "_id long, token_ids array<int>, char_starts array<int>, char_ends array<int>").withColumnRenamed("_id", id_col)


def decode(encoded: DataFrame, codec: dict[str, str] | None = None, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """Per row: id and ``text``. A null array decodes to null, an empty one to the empty text."""
    made = codec or public_codec()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state("bpe", lambda: Codec(**made), *sorted(made.items()))
        for batch in batches:
            texts = [None if i is None else own.decode(np.array(i, dtype=np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["_id", "text"])

    return lean_batches(encoded).select(F.col(id_col).cast("long").alias("_id"), F.col(ids_col)).mapInArrow(run, "_id long, text string").withColumnRenamed("_id", id_col)


def round_trip(docs: DataFrame, codec: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space) and
    ``decoded_sha256`` (of the bytes that the ids decode to), both lower-case hex."""
    made = codec or public_codec()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state("bpe", lambda: Codec(**made), *sorted(made.items()))
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for ids in own.encode(batch.column(1).to_pylist()):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(own.joined(ids).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(own.decode_bytes(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    cols = docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(F.col(text_col)).alias("_text"))
    return lean_batches(cols).mapInArrow(run, "_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)
