"""Vectors for chunks by an injected model, and the cache of query vectors."""

from __future__ import annotations

import hashlib
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class HashedModel:
    """A deterministic stand-in for a model: signed sums of hashed words, of length 1. Empty texts have no vector."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension
        self.identity = f"hashed-words:{dimension}:1"

    def __call__(self, texts: list[str]) -> list[list[float] | None]:
        out = []
        for text in texts:
            v = np.zeros(self.dimension)
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1 if h >> 63 else -1
            n = np.sqrt((v**2).sum())
            out.append((v / n).tolist() if n else None)
        return out


def embed(chunks: DataFrame, model: Callable[[list[str]], list], identity: str, batch: int = 16, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """``chunk_id``, ``embedding``, ``model_identity`` in batches of ``batch`` texts (EMB01).

    A batch that the model fails on gets null vectors, so the rest goes on (EMB02); ``error`` says why, so that failures
    can be counted and told from texts without a vector.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors, errors = [], []
            texts = frame["text"].fillna("").tolist()
            for at in range(0, len(texts), batch):
                part = texts[at : at + batch]
                try:
                    vectors += model(part)
                    errors += [None] * len(part)
                except Exception as e:  # noqa: BLE001 - whatever the model raises
                    vectors += [None] * len(part)
                    errors += [f"{type(e).__name__}: {e}"] * len(part)
            yield pd.DataFrame({"chunk_id": frame["chunk_id"], "embedding": vectors, "model_identity": identity, "error": errors})

    return chunks.select(F.col(id_col).alias("chunk_id"), F.col(text_col).alias("text")).mapInPandas(run, "chunk_id long, embedding array<float>, model_identity string, error string")


def status_with_vectors(status: Column, missing: Column) -> Column:
    """A ready document with chunks that lack vectors is partial: it is found by its words alone (EMB02)."""
    return F.when((status == "ready") & (missing > 0), "partial").otherwise(status)


class QueryCache:
    """Vectors of recent queries, kept by the driver: least recently used goes first, none outlives ``ttl`` seconds, and
    queries of more than ``longest`` characters are not kept (STM08)."""

    def __init__(self, model: Callable[[list[str]], list], most: int = 256, ttl: float = 300, longest: int = 500, clock: Callable[[], float] = time.monotonic):
        self.model, self.most, self.ttl, self.longest, self.clock = model, most, ttl, longest, clock
        self.kept: OrderedDict[str, tuple[float, list[float]]] = OrderedDict()

    def __call__(self, query: str) -> list[float]:
        found = self.kept.get(query)
        if found and self.clock() - found[0] < self.ttl:
            self.kept.move_to_end(query)
            return found[1]
        vector = self.model([query])[0]
        if len(query) <= self.longest:
            self.kept[query] = (self.clock(), vector)
            self.kept.move_to_end(query)
            if len(self.kept) > self.most:
                self.kept.popitem(last=False)
        return vector
