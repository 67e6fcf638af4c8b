"""Quality classifier: supervised subword embeddings, averaged per document, with a softmax output.

Every whitespace-separated word contributes the vectors of its hash and of its hashed byte n-grams, and every two
neighbours that of their hashed pair. A document is the mean of these vectors; a linear layer and a softmax give the
class. Training is stochastic gradient descent in numpy on the driver, over a bounded sample of labelled rows. Since
output and mean are linear, scoring needs one number a hash bucket: that table (``2 ** bits`` floats) is what travels
to the executors.

Rows: null and empty texts have no features and get the bias alone; repeated rows get equal scores; an empty table
gives an empty one, and without labelled rows the score is 0.5.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import lean_batches, text_or_empty, worker_state

#: Words whose numbers a worker keeps before it starts anew, and characters that are scored together.
KEPT, CHUNK_CHARS = 300_000, 1_000_000
NGRAMS = (3, 4)
LEAST_STEPS = 1500


def features(word: str, mask: int) -> list[int]:
    """Buckets of a word: of itself, then of its byte n-grams between the marks of its ends."""
    raw = word.encode("utf-8", "surrogatepass")
    marked = b"<" + raw + b">"
    return [zlib.crc32(raw) & mask, *(zlib.crc32(marked[i : i + n]) & mask for n in NGRAMS for i in range(len(marked) - n + 1))]


def pairs(first: np.ndarray, second: np.ndarray, mask: int) -> np.ndarray:
    """Buckets of pairs of neighbours, from the hashes of the words; a word beside itself is one pair, whichever word it is."""
    mixed = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.where(first == second, 0, (mixed >> np.uint64(29)) & np.uint64(mask)).astype(np.int64)


@dataclass
class Model:
    """``table``: what each bucket adds to the difference of the two classes' logits; ``bias``: of this difference."""

    table: np.ndarray
    bias: float

    @property
    def mask(self) -> int:
        return len(self.table) - 1


def train(
    texts: list[str], labels: list[int], bits: int = 17, dim: int = 8, epochs: int = 8, rate: float = 0.5, batch: int = 16, prior: float | None = None, seed: int = 7
) -> Model:
    """Fit on texts with labels 0 or 1. ``prior``: share of label 1 outside the sample, for which the bias is corrected.

    Classes are balanced by repeating rows of the smaller one; small samples get more epochs, ``LEAST_STEPS`` in all.

    Without both classes the model is constant: the share of label 1 (0.5 without any row).
    """
    y = np.array(labels, dtype=np.int64)
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        p = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(1 << bits, np.float32), float(np.log(p / (1 - p))))
    mask, rng = (1 << bits) - 1, np.random.default_rng(seed)
    known: dict[str, int] = {}
    flat, ends, hashes = array("i"), array("q"), array("L")
    docs: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    for text in texts:
        words = text.split()
        for w in words:
            if w not in known:
                known[w] = len(ends)
                flat.extend(features(w, mask))
                ends.append(len(flat))
                hashes.append(zlib.crc32(w.encode("utf-8", "surrogatepass")))
        of = np.fromiter((known[w] for w in words), np.int64, len(words))
        crc = np.frombuffer(hashes, dtype=np.uint64)[of] if len(of) else np.zeros(0, np.uint64)
        unique, counts = np.unique(of, return_counts=True)
        pair, pair_counts = np.unique(pairs(crc[:-1], crc[1:], mask), return_counts=True)
        docs.append((unique.astype(np.int32), counts.astype(np.float32), pair.astype(np.int32), pair_counts.astype(np.float32)))
    known.clear()
    sizes = np.diff(np.frombuffer(ends, dtype=np.int64), prepend=0)
    starts, buckets = np.frombuffer(ends, dtype=np.int64) - sizes, np.frombuffer(flat, dtype=np.int32)

    embedding = ((rng.random((mask + 1, dim)) - 0.5) / dim).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    each = [np.flatnonzero(y == c) for c in (0, 1)]
    rows, share = np.concatenate([np.resize(e, max(map(len, each))) for e in each]), 0.5
    epochs = max(epochs, -(-LEAST_STEPS * batch // len(rows))) if epochs > 1 else epochs
    steps, step = epochs * -(-len(rows) // batch), 0
    for _ in range(epochs):
        order = rng.permutation(rows)
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            words = np.concatenate([docs[d][0] for d in chosen])
            counts = np.concatenate([docs[d][1] for d in chosen])
            of_doc = np.repeat(np.arange(len(chosen)), [len(docs[d][0]) for d in chosen])
            n = sizes[words]
            upto = np.cumsum(n)
            picked = buckets[np.repeat(starts[words] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)]
            couples = [len(docs[d][2]) for d in chosen]
            picked = np.concatenate([picked, *(docs[d][2] for d in chosen)])
            doc = np.concatenate([np.repeat(of_doc, n), np.repeat(np.arange(len(chosen)), couples)])
            weight = np.concatenate([np.repeat(counts, n), *(docs[d][3] for d in chosen)])
            total = np.maximum(np.bincount(doc, weight, len(chosen)), 1).astype(np.float32)
            weight = weight / total[doc]
            hidden = np.stack([np.bincount(doc, weight * embedding[picked, k], len(chosen)) for k in range(dim)], 1).astype(np.float32)
            logits = hidden @ out.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(chosen)), y[chosen]] -= 1
            now = rate * (1 - step / steps)
            back = p @ out
            out -= now * (p.T @ hidden)
            bias -= now * p.sum(0)
            unique, where = np.unique(picked, return_inverse=True)
            for k in range(dim):
                embedding[unique, k] -= now * np.bincount(where, weight * back[doc, k], len(unique)).astype(np.float32)
            step += 1
    shift = 0.0
    if prior is not None and 0 < prior < 1:
        shift = float(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return Model((embedding @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]) + shift)


class Scorer:
    """Scores texts by a model; keeps the numbers of words that it has met."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.slot_of: dict[str, int] = {}
        self.sums, self.counts, self.hashes = np.zeros(0), np.zeros(0), np.zeros(0, np.uint64)

    def score(self, texts: list[str]) -> np.ndarray:
        out, at = [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= CHUNK_CHARS):
                chars += len(texts[end])
                end += 1
            out.append(self._chunk([t.split() for t in texts[at:end]]))
            at = end
        return np.concatenate(out) if out else np.zeros(0)

    def _chunk(self, docs: list[list[str]]) -> np.ndarray:
        if len(self.slot_of) > KEPT:
            self._forget()
        words = list(chain.from_iterable(docs))
        new = list(set(words).difference(self.slot_of))
        if new:
            mask = self.model.mask
            found = [features(w, mask) for w in new]
            n = np.fromiter(map(len, found), np.int64, len(found))
            values = self.model.table[np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))]
            self.sums = np.concatenate([self.sums, np.add.reduceat(values.astype(np.float64), np.cumsum(n) - n)])
            self.counts = np.concatenate([self.counts, n])
            self.hashes = np.concatenate([self.hashes, np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in new), np.uint64, len(new))])
            self.slot_of.update(zip(new, range(len(self.slot_of), len(self.slot_of) + len(new)), strict=True))
        slots = np.fromiter(map(self.slot_of.__getitem__, words), np.int64, len(words))
        of_doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        crc, beside = self.hashes[slots], of_doc[1:] == of_doc[:-1]
        couples = of_doc[1:][beside]
        both = self.model.table[pairs(crc[:-1][beside], crc[1:][beside], self.model.mask)]
        total = np.bincount(of_doc, self.sums[slots], len(docs)) + np.bincount(couples, both, len(docs))
        mean = total / np.maximum(np.bincount(of_doc, self.counts[slots], len(docs)) + np.bincount(couples, minlength=len(docs)), 1)
        return 1 / (1 + np.exp(-(mean + self.model.bias)))


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text, modulo 5, is 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample: int = 4000, chars: int = 40_000_000, id_col: str = "doc_id", text_col: str = "text", **how
) -> Model:
    """Train on at most ``sample`` labelled rows (half of each class, those of least id hash) that are not held out, and
    of these on the first ones whose texts have ``chars`` characters together: what the driver holds is bounded.

    Rows with other labels than 0 and 1 are left out, and ids that have both. Of an id with several texts the least one
    is taken.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_y")).filter("_id is not null and _y in (0, 1)").filter(~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_also")).filter("_y = _also").drop("_also")
    n = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    halves = [known.filter(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(sample // 2).collect() for y in (0, 1)]
    spark, texts = docs.sparkSession, docs.select(F.col(id_col).cast("long").alias("_id"), text_or_empty(F.col(text_col)).alias("_text"))
    wanted = lambda rows: texts.join(F.broadcast(spark.createDataFrame(rows, "_id long, _y int")), "_id").groupBy("_id", "_y")
    chosen = [(r["_id"], r["_y"]) for half in halves for r in half]
    place, size = {i: k for half in halves for k, (i, _) in enumerate(half)}, {r["_id"]: r["n"] for r in wanted(chosen).agg(F.length(F.min("_text")).alias("n")).collect()}
    fitting, room = [], chars
    for row in sorted((r for r in chosen if r[0] in size), key=lambda r: (place[r[0]], r[1])):
        room -= size[row[0]]
        if room < 0 and len({y for _, y in fitting}) == 2:
            break
        fitting.append(row)
    rows = sorted(wanted(fitting).agg(F.min("_text").alias("_text")).collect(), key=lambda r: r["_id"])
    prior = n.get(1, 0) / max(1, sum(n.values()))
    return train([r["_text"] for r in rows], [r["_y"] for r in rows], prior=prior, **how)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, ``held_out``, ``score`` (probability of label 1; an empty text gets the bias alone), ``predicted``
    and the columns ``keep`` of the input."""
    token = int(zlib.crc32(model.table.tobytes() + repr(model.bias).encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state("quality", lambda: Scorer(model), token)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own.score(batch.column(batch.num_columns - 1).to_pylist()), pa.float64())], names=[*batch.schema.names[:-1], "_score"])

    kept = [F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)]
    cols = docs.select(F.col(id_col).cast("long").alias("_id"), *kept, text_or_empty(F.col(text_col)).alias("_text"))
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1])
    scored = lean_batches(cols).mapInArrow(run, f"{out}, _score double")
    return scored.select(
        F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"),
        *(F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep)),
    )


def keep_good(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is at least ``threshold``, unchanged. Null texts score as empty ones."""
    place = docs.columns.index(text_col)
    token = int(zlib.crc32(model.table.tobytes() + repr(model.bias).encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state("quality", lambda: Scorer(model), token)
        for batch in batches:
            yield batch.filter(pa.array(own.score([t or "" for t in batch.column(place).to_pylist()]) >= threshold))

    return lean_batches(docs).mapInArrow(run, docs.schema)
