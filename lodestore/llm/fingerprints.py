"""Document fingerprints by locally consistent parsing.

A text is parsed into phrases, phrases into longer phrases, and so on. Where a phrase ends is decided by
deterministic coin tossing: each symbol is compared with its predecessor (the lowest bit in which they differ,
and its value), three times over, until symbols are small numbers of which neighbours differ; phrases begin at
the local maxima. This looks at a few neighbours only, so equal substrings are parsed alike but for their ends,
wherever they stand. Runs of one symbol are one symbol of its own. A phrase's name is a hash of its contents.

The fingerprint is a one-permutation sketch of the names of ``LEVELS``: of each bin the least name. Likeness is
the share of equal bins among those filled in either sketch, an estimate of the Jaccard similarity of the names.
A few further bins hold names of the lowest level; they count where neither text fills ``FEW`` of the others. Without
them the likeness of two short texts would rest on a handful of bins; with them everywhere, texts of one language would
be alike by their common syllables. A pair is judged by the same bins whichever of the two comes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import lean_batches, text_or_empty, worker_state
from lodestore.llm.words import Powers, mix

BINS, LOW_BINS = 64, 16
FEW = 16
EMPTY = 0xFFFF
#: Phrases of these levels make the fingerprint: about a dozen and three dozen characters long.
LEVELS = (2, 3)
CHUNK_CHARS = 1 << 18


class Parser:
    def __init__(self):
        self.powers = Powers(0xA0761D6478BD642F)
        self.magic, self.order = np.uint64(0x03F79D71B4CB0A89), np.zeros(64, np.uint8)
        for k in range(64):
            self.order[((1 << k) * int(self.magic) & (1 << 64) - 1) >> 58] = k
        values = np.arange(256, dtype=np.int64)
        self.low = np.array([(int(v) & -int(v)).bit_length() - 1 if v else 0 for v in values], dtype=np.uint8)

    def lowest(self, x: np.ndarray) -> np.ndarray:
        """Place of the lowest bit of 64-bit words other than 0."""
        return self.order[((x & (~x + np.uint64(1))) * self.magic) >> np.uint64(58)]

    def level(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the phrases of sequences. ``first``: where each sequence begins, and the end. No sequence is empty."""
        begins = np.ones(len(x), dtype=bool)
        np.not_equal(x[1:], x[:-1], out=begins[1:])
        begins[first[:-1]] = True
        at = np.flatnonzero(begins)
        if len(at) < len(x):
            run = np.diff(np.append(at, len(x))).astype(np.uint64)
            x = x[at]
            long = run > 1
            x[long] = mix(x[long] + run[long] * np.uint64(0x9E3779B97F4A7C15))
            first = np.searchsorted(at, first)
        start = first[:-1]
        label = np.empty(len(x), np.uint8)
        differ = x[1:] ^ x[:-1]
        place = self.lowest(differ)
        label[1:] = 2 * place + ((x[1:] >> place) & np.uint64(1)).astype(np.uint8)
        label[start] = 128 + (x[start] & np.uint64(1)).astype(np.uint8)  # no other label is so large
        for _ in range(2):
            place = self.low[label[1:] ^ label[:-1]]
            new = np.empty_like(label)
            new[1:] = 2 * place + ((label[1:] >> place) & 1)
            new[start] = 16 + (label[start] & 1)
            label = new
        peak = np.zeros(len(x), dtype=bool)
        peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
        last = first[1:] - 1
        peak[last] = False
        second = start[start < last] + 1
        peak[second] = False
        peak[start] = True
        at = np.flatnonzero(peak)
        # Labels of neighbours differ and are small, so a phrase is short and few powers are needed, however long the text.
        n = np.diff(np.append(at, len(x)))
        up, _ = self.powers.upto(int(n.max()) + 1)
        names = mix(np.add.reduceat(x * up[np.arange(len(x)) - np.repeat(at, n)], at) + n.astype(np.uint64))
        return names, np.searchsorted(at, first)

    def sketches(self, texts: list[str]) -> np.ndarray:
        """A row of 16-bit numbers a text: ``BINS``, then ``LOW_BINS``."""
        out = np.full((len(texts), BINS + LOW_BINS), EMPTY, np.uint16)
        at = 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end]) <= CHUNK_CHARS):
                chars += len(texts[end])
                end += 1
            some = [i for i in range(at, end) if texts[i]]
            if some:
                self._chunk([texts[i] for i in some], np.array(some), out)
            at = end
        return out

    def _chunk(self, texts: list[str], rows: np.ndarray, out: np.ndarray) -> None:
        x = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        keys, values = [], []
        for k in range(1, max(LEVELS) + 1):
            x, first = self.level(x, first)
            if k == 1 or k in LEVELS:
                of = np.repeat(np.arange(len(rows)), np.diff(first))
                bins = (x >> np.uint64(48)).astype(np.int64)
                keys.append(of * (BINS + LOW_BINS) + (bins % BINS if k in LEVELS else BINS + bins % LOW_BINS))
                values.append(((x >> np.uint64(12)) & np.uint64(0xFFFFFFFF)).astype(np.uint64))
        key = np.concatenate(keys)
        packed = np.sort((key.astype(np.uint64) << np.uint64(32)) | np.concatenate(values))
        key = (packed >> np.uint64(32)).astype(np.int64)
        lead = np.ones(len(key), dtype=bool)
        np.not_equal(key[1:], key[:-1], out=lead[1:])
        key = key[lead]
        least = mix(packed[lead] & np.uint64(0xFFFFFFFF)) % np.uint64(EMPTY)
        out[rows[key // (BINS + LOW_BINS)], key % (BINS + LOW_BINS)] = least.astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of sketches, 0 to 1; two sketches without any bin (of empty texts) are alike."""
    counts = np.ones(a.shape, dtype=bool)
    counts[:, BINS:] = (np.maximum((a[:, :BINS] != EMPTY).sum(1), (b[:, :BINS] != EMPTY).sum(1)) < FEW)[:, None]
    filled = (((a != EMPTY) | (b != EMPTY)) & counts).sum(1)
    same = ((a == b) & (a != EMPTY) & counts).sum(1)
    return np.where(filled == 0, 1.0, same / np.maximum(filled, 1))


def _hex(sketch: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in sketch.astype(">u2")]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``fingerprint`` (hex; 4 digits a bin, ffff: empty). Null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state("parser", Parser)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_hex(own.sketches(batch.column(1).to_pylist())), pa.string())], names=["id", "fingerprint"])

    cols = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    return lean_batches(cols).mapInArrow(run, "id long, fingerprint string").withColumnRenamed("id", id_col)


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (``part``, ``copy``, ``id``, ``text``), dealt and sorted so that in each part every row's successor in the
    order of ids follows it; a last row with ``copy`` = 1 is the first row of the next part (after the last: of the first).

    Parts are ranges of ids with boundaries from quantiles; the rows of an id that is more than a part's share (null
    ids, or one that repeats) are dealt by ranges of their texts' hash. Only boundaries and such ids reach the driver.
    Rows equal in id and text stay in one part.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = base.select("id")
    wanted = [k / (4 * tasks) for k in range(1, 4 * tasks)]
    bounds = {int(b) for b in (ids.filter("id is not null").approxQuantile("id", wanted, 1 / (16 * tasks)) or [])}
    share = max(1.0, ids.count() / (4 * tasks))
    heavy = [(r["id"], int(r["count"] // share) + 1) for r in ids.groupBy("id").count().filter(F.col("count") > 2 * share).collect()]
    bounds |= {b for i, _ in heavy if i is not None for b in (i, min(i + 1, (1 << 63) - 1))}  # such an id is a range of its own
    heavy_df = F.broadcast(spark.createDataFrame(heavy, "heavy_id long, ways int"))
    placed = _with_part(base, sorted(bounds)).withColumn("h", F.xxhash64("text")).join(heavy_df, F.col("id").eqNullSafe(F.col("heavy_id")), "left")
    piece = F.floor((F.col("h") / float(1 << 63) + 1) / 2 * F.col("ways")).cast("int")
    placed = placed.select("id", "text", "h", "part", F.coalesce(F.least(piece, F.col("ways") - 1), F.lit(0)).alias("piece"))

    least = placed.groupBy("part", "piece").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "h")).alias("x")).select("part", "piece", "x.id", "x.h")
    units = sorted(least.collect(), key=lambda r: (r["part"], r["piece"]))
    unit_df = F.broadcast(spark.createDataFrame([(r["part"], r["piece"], k) for k, r in enumerate(units)], "part int, piece int, unit int"))
    first_df = F.broadcast(spark.createDataFrame([(r["id"], r["h"], (k - 1) % len(units)) for k, r in enumerate(units)], "first_id long, first_h long, previous int"))
    placed = placed.join(unit_df, ["part", "piece"]).join(first_df, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("h") == F.col("first_h")), "left")
    own, copied = F.struct(F.col("unit").alias("part"), F.lit(0).alias("copy")), F.struct(F.col("previous").alias("part"), F.lit(1).alias("copy"))
    dealt = placed.select("id", "text", "h", F.explode(F.when(F.col("previous").isNull(), F.array(own)).otherwise(F.array(own, copied))).alias("to"))
    return dealt.select(F.col("to.part").alias("part"), F.col("to.copy").alias("copy"), "id", "text", "h").repartition(tasks, "part").sortWithinPartitions("part", "copy", "id", "h").drop("h")


def _with_part(base: DataFrame, bounds: list[int]) -> DataFrame:
    """``part``: how many of the boundaries are at most the id (null ids: -1). Looked up by cells of equal width over their
    range, each with the few boundaries inside it; so a row costs no step for each of all boundaries."""
    if not bounds:
        return base.withColumn("part", F.when(F.col("id").isNull(), -1).otherwise(0))
    low, n = bounds[0], 4 * len(bounds)
    width = max(1, -(-(bounds[-1] + 1 - low) // n))
    cells: dict[int, list[int]] = {}
    for b in bounds:
        cells.setdefault((b - low) // width, []).append(b)
    table, below = [], 0
    for k in range(n + 1):
        table.append((k, below, cells.get(k, [])))
        below += len(cells.get(k, []))
    found = F.broadcast(base.sparkSession.createDataFrame(table, "cell long, below int, inside array<long>"))
    far = F.col("id").cast("decimal(20,0)") - F.lit(low)
    cell = F.when(F.col("id") < low, F.lit(-1)).otherwise(F.least(F.lit(n), F.floor(far / width))).cast("long")
    part = F.when(F.col("id").isNull(), -1).otherwise(F.coalesce(F.col("below") + F.size(F.filter("inside", lambda b: b <= F.col("id"))), F.lit(0)))
    return base.withColumn("cell", cell).join(found, "cell", "left").select(*base.columns, part.alias("part"))


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``, ``near_next``.

    The edited text is the text with its last floor(n_chars / 4) characters replaced by as many first ones of the
    next row's text (or all of it); rows are in the order of ids, null first, rows of one id by a hash of their text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = worker_state("parser", Parser)
        held: list[tuple] = []
        for batch in batches:
            rows = held + list(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True))
            at = 0
            while at < len(rows) - 1:
                end, chars = at + 1, len(rows[at][3])
                while end < len(rows) - 1 and chars + len(rows[end][3]) <= CHUNK_CHARS:
                    chars += len(rows[end][3])
                    end += 1
                yield _compare(own, rows[at : end + 1])
                at = end
            held = rows[-1:]

    def _compare(own: Parser, rows: list[tuple]) -> pa.RecordBatch:
        pairs = [k for k in range(len(rows) - 1) if rows[k][1] == 0 and rows[k + 1][0] == rows[k][0]]
        texts = [r[3] for r in rows]
        sketch = own.sketches(texts)
        edited = []
        for k in pairs:
            quarter = len(texts[k]) // 4
            edited.append(texts[k][: len(texts[k]) - quarter] + texts[k + 1][:quarter])
        new = own.sketches(edited)
        here = np.array(pairs, dtype=np.int64)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[k][2] for k in pairs], pa.int64()), pa.array([len(texts[k]) for k in pairs], pa.int64()),
                pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()), pa.array(_hex(sketch[here]), pa.string()), pa.array(_hex(new), pa.string()),
                pa.array(likeness(sketch[here], new), pa.float64()), pa.array(likeness(sketch[here], sketch[here + 1]), pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return lean_batches(with_next(docs, id_col, text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)
