"""Chroma fingerprints of audio in media columns.

A recording (PCM WAV bytes) becomes frames of twelve pitch classes; on their integral image sixteen filters compare
neighbouring areas, each gives two bits, and the 32 bits of a frame are one packed integer. Two recordings are
aligned by the histogram of offsets between equal integers and judged by their bit errors at the best offsets.

A search takes every row whose id is divisible by 100 against all rows: integers are joined, votes counted by pair and
offset, and pairs with enough votes are judged by bit errors at the offsets that an alignment tries. Equal fingerprints
are one class from the start, so copies multiply neither votes nor pairs; successive equal integers (silence, held
notes) are one run, whose votes are counted by offset without pairing its places.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import lean_batches, materialize, settled

RATE, FRAME, HOP = 4000, 512, 128
LOWEST, HIGHEST = 120.0, 1900.0
#: (kind, first pitch class, pitch classes, frames), by rule.
FILTERS = tuple((k % 5, (5 * k) % (12 - (4 + 2 * (k % 3)) + 1), 4 + 2 * (k % 3), (4, 8, 12, 16)[k % 4]) for k in range(16))
WIDEST = 16
LEVEL = 0.25
GRAY = np.array([0, 1, 3, 2], dtype=np.uint32)
#: Votes for an offset that make two recordings candidates, and bit errors (share) up to which they match.
VOTES, ERRORS = 3, 0.25
#: Offsets at which a pair is judged.
TRIED = 5


def write_wav(samples: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit mono WAV of samples from -1 to 1."""
    data = (np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def read_wav(raw: bytes | None) -> np.ndarray | None:
    """Samples at ``RATE``, channels averaged; None for what is not 16-bit PCM WAV."""
    if not raw or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return None
    at, form, data = 12, None, None
    while at + 8 <= len(raw):
        kind, size = raw[at : at + 4], struct.unpack("<I", raw[at + 4 : at + 8])[0]
        if kind == b"fmt " and size >= 16:
            form = struct.unpack("<HHIIHH", raw[at + 8 : at + 24])
        elif kind == b"data":
            data = raw[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if form is None or data is None or form[0] != 1 or form[5] != 16 or not form[1] or not form[2]:
        return None
    x = np.frombuffer(data[: len(data) // (2 * form[1]) * 2 * form[1]], dtype="<i2").reshape(-1, form[1]).mean(1) / 32768
    if form[2] != RATE and len(x):
        x = np.interp(np.arange(0, len(x), form[2] / RATE), np.arange(len(x)), x)
    return x


def _pitch_map() -> np.ndarray:
    hertz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hertz), 12))
    for k, f in enumerate(hertz):
        if LOWEST <= f <= HIGHEST:
            note = 12 * np.log2(f / 440.0)
            low = int(np.floor(note))
            out[k, low % 12] += 1 - (note - low)
            out[k, (low + 1) % 12] += note - low
    return out


PITCHES, WINDOW = _pitch_map(), np.hanning(FRAME)


def frames(samples: np.ndarray) -> np.ndarray:
    """Pitch classes by frame, smoothed over five frames, each of length 1 (silence: 0)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    cut = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    power = np.abs(np.fft.rfft(cut * WINDOW, axis=1)) ** 2
    chroma = power @ PITCHES
    taps = np.array([0.25, 0.75, 1.0, 0.75, 0.25])
    if len(chroma) < len(taps):
        return np.zeros((0, 12))
    smooth = sum(w * chroma[k : len(chroma) - len(taps) + 1 + k] for k, w in enumerate(taps))
    norm = np.sqrt((smooth**2).sum(1, keepdims=True))
    return np.where(norm > 1e-6, smooth / np.maximum(norm, 1e-12), 0.0)


def pack(image: np.ndarray) -> np.ndarray:
    """Packed integers of pitch-class frames: one for each frame at which the widest filter fits."""
    n = len(image) - WIDEST + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    whole = np.zeros((len(image) + 1, 13))
    whole[1:, 1:] = image.cumsum(0).cumsum(1)
    t = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return whole[t + t1, y1] - whole[t + t0, y1] - whole[t + t1, y0] + whole[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        all_ = area(0, w, y, y + h)
        if kind == 0:
            part = area(0, w, y, y + h // 2)
        elif kind == 1:
            part = area(0, w // 2, y, y + h)
        elif kind == 2:
            part = area(0, w // 2, y, y + h // 2) + area(w // 2, w, y + h // 2, y + h)
        elif kind == 3:
            part = area(0, w, y + h // 4, y + h // 4 + h // 2)
        else:
            part = area(w // 4, w // 4 + w // 2, y, y + h)
        balance = np.log((1 + part) / (1 + all_ - part))
        out = (out << np.uint32(2)) | GRAY[(balance > -LEVEL).astype(int) + (balance > 0) + (balance > LEVEL)]
    return out


def bit_errors(a: np.ndarray, b: np.ndarray, offset: int) -> tuple[float, int]:
    """Share of differing bits where a[i + offset] meets b[i], and how many integers meet."""
    low, high = max(0, -offset), min(len(b), len(a) - offset)
    if high <= low:
        return 1.0, 0
    return float(np.bitwise_count(a[low + offset : high + offset] ^ b[low:high]).sum()) / (32 * (high - low)), high - low


def align(a: np.ndarray, b: np.ndarray, tried: int = TRIED) -> tuple[int | None, float]:
    """(offset, bit errors) such that a[i + offset] fits b[i]; (None, 1.0) without equal integers.

    Of the ``tried`` offsets with most votes the one with least bit errors, then with most votes, then the least.
    """
    order = np.argsort(a, kind="stable")
    left, right = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    n = right - left
    if not n.sum():
        return None, 1.0
    upto = np.cumsum(n)
    hits = order[np.repeat(left - (upto - n), n) + np.arange(upto[-1])] - np.repeat(np.arange(len(b)), n)
    offsets, votes = np.unique(hits, return_counts=True)
    best = sorted(zip(-votes, offsets, strict=True))[:tried]
    error, _, offset = min((bit_errors(a, b, int(o))[0], v, int(o)) for v, o in best)
    return offset, error


def fingerprint(media: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Per row: id and ``items`` (array of long, 0 to 2**32 - 1); null where the media are null or not 16-bit PCM WAV,
    empty where they are too short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [None if (x := read_wav(raw)) is None else pack(frames(x)).astype(np.int64) for raw in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(items, pa.list_(pa.int64()))], names=["id", "items"])

    return lean_batches(media).select(F.col(id_col).cast("long").alias("id"), F.col(media_col)).mapInArrow(run, "id long, items array<long>").withColumnRenamed("id", id_col)


def sonify(vector: list[float] | None) -> bytes | None:
    """A recording of a vector: each number a note of two octaves, 96 ms long, with its first overtone."""
    if not vector:
        return None
    x = np.nan_to_num(np.array([0.0 if v is None else v for v in vector], dtype=np.float64))
    note = np.clip(np.round(12 + x * 60), 0, 23)
    hertz = 261.626 * 2 ** (note / 12)
    turns = 2 * np.pi * np.cumsum(np.repeat(hertz / RATE, 3 * HOP))
    return write_wav(0.5 * np.sin(turns) + 0.2 * np.sin(2 * turns))


def edited(samples: np.ndarray, seed: int) -> np.ndarray:
    """The recording without its first quarter (whole hops), with noise."""
    cut = samples[len(samples) // 4 // HOP * HOP :]
    return cut + 0.02 * np.random.default_rng(seed & 0x7FFFFFFF).standard_normal(len(cut))


def of_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: ``id``, ``items`` of its sonified vector, and ``edit_offset``, ``edit_errors``: how the edited recording
    aligns with it. Null and empty vectors have null items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, offsets, errors = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                samples = read_wav(sonify(v))
                if samples is None:
                    items.append(None), offsets.append(None), errors.append(None)
                    continue
                own = pack(frames(samples))
                offset, error = align(own, pack(frames(read_wav(write_wav(edited(samples, i or 0))))))
                items.append(own.astype(np.int64)), offsets.append(offset), errors.append(error)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(items, pa.list_(pa.int64())), pa.array(offsets, pa.int64()), pa.array(errors, pa.float64())], names=["id", "items", "edit_offset", "edit_errors"]
            )

    return lean_batches(vectors).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col)).mapInArrow(run, "id long, items array<long>, edit_offset long, edit_errors double")


@settled
def search(found: DataFrame, every: int = 100, votes: int = VOTES, errors: float = ERRORS, tried: int = TRIED) -> DataFrame:
    """Match recordings (``id``, ``items``) with those whose id is divisible by ``every``.

    Per row with items: ``id``, ``class_id`` (least id of those with equal items), ``n_matches`` (other classes of query
    recordings that match), and of the best one (least bit errors, then least id) ``match_class``, ``match_offset``,
    ``match_errors``. A pair with ``votes`` at some offset is judged as ``align`` does, at the ``tried`` offsets of most votes.
    """
    found = materialize(found.filter("items is not null and id is not null").select("id", "items", F.sha2(F.to_json("items"), 256).alias("same")), "recordings")
    asks = F.max((F.pmod("id", F.lit(every)) == 0).cast("int"))
    classes = materialize(found.groupBy("same").agg(F.min("id").alias("class_id"), asks.alias("asks"), F.first("items").alias("items")), "classes")
    starts = F.filter(F.sequence(F.lit(0), F.size("items") - 1), lambda k: (k == 0) | (F.get("items", k) != F.get("items", k - 1)))
    begun = classes.filter(F.size("items") > 0).select("class_id", "asks", "items", starts.alias("starts"))  # a column, or each step of the lambda would filter again
    runs = F.transform("starts", lambda k, i: F.struct(F.get("items", k).alias("item"), k.alias("place"), (F.coalesce(F.get("starts", i + 1), F.size("items")) - k).alias("n")))
    keys = begun.select("class_id", "asks", F.inline(runs))
    queries = keys.filter("asks = 1").select(F.col("class_id").alias("q"), F.col("place").alias("q_place"), F.col("n").alias("q_n"), "item")
    hits = keys.select("class_id", "place", "n", "item").join(queries, "item").filter("class_id <> q")
    shift = (F.col("place") - F.col("q_place")).cast("long")
    apart = F.sequence(shift - F.col("q_n") + 1, shift + F.col("n") - 1)
    met = hits.select("class_id", "q", F.col("place").alias("p"), F.col("n").alias("n"), "q_place", "q_n", F.explode(apart).alias("offset"))
    both = F.least(F.col("p") + F.col("n"), F.col("q_place") + F.col("q_n") + F.col("offset")) - F.greatest(F.col("p"), F.col("q_place") + F.col("offset"))
    offsets = met.groupBy("class_id", "q", "offset").agg(F.sum(both).alias("votes"))
    order = F.struct((-F.col("votes")).alias("less"), "offset")
    best = offsets.groupBy("class_id", "q").agg(F.slice(F.array_sort(F.collect_list(order)), 1, tried).alias("best")).filter(F.get("best", F.lit(0))["less"] <= -votes)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for a, b, best in zip(*(batch.column(k).to_pylist() for k in (3, 4, 2)), strict=True):
                a, b = np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32)
                got.append(min((bit_errors(a, b, x["offset"])[0], x["less"], x["offset"]) for x in best))
            keep = pa.array([e <= errors for e, _, _ in got], pa.bool_())
            at, share = pa.array([o for _, _, o in got], pa.int64()), pa.array([e for e, _, _ in got], pa.float64())
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (batch.column(0), batch.column(1), at, share)], names=["class_id", "q", "offset", "errors"])

    pairs = best.join(classes.select("class_id", F.col("items").alias("a")), "class_id").join(classes.select(F.col("class_id").alias("q"), F.col("items").alias("b")), "q")
    judged = lean_batches(pairs).select("class_id", "q", "best", "a", "b").mapInArrow(judge, "class_id long, q long, offset long, errors double")
    per_class = judged.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_matches"), F.min(F.struct("errors", "q", "offset")).alias("best"))
    out = classes.select("same", "class_id").join(per_class, "class_id", "left")
    return found.select("id", "same").join(out, "same").select(
        "id", "class_id", F.coalesce("n_matches", F.lit(0)).cast("long").alias("n_matches"), F.col("best.q").alias("match_class"), F.col("best.offset").alias("match_offset"), F.col("best.errors").alias("match_errors")
    )
