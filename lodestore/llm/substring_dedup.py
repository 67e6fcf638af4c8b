"""Substring deduplication by seed and extend, on whole words.

A window is ``length`` consecutive words. A window's seed is its anchor: the first least of the hashes of its
``gram``-word grams (winnowing), so equal windows have equal anchors at equal places. A document gives few
anchors, and only anchors that several documents share go on.

An anchor's surroundings are all words of the windows that may have it as their seed. Where two documents agree on the
whole surroundings, all windows of that anchor are candidates, and one hash tells; only of anchors with differing
surroundings (at the ends of a repeat) are the windows looked up one by one. Either way the least document of each
group, and its place in it, comes from an aggregate, so copies are never paired. Then matches are extended both ways:
adjoining windows that lie at one distance from the same document are one run, up to the first word on either side
that differs. Hashes only propose: the words of every run are compared, by their SHA-256, with those of the document
that has them first, and only runs of equal words lose them. They are the maximal repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import lean_batches, materialize, settled, text_or_empty, worker_state
from lodestore.llm.words import Powers, find_words, mix, text_chunks, word_hashes


@dataclass
class Windows:
    """Of one text: the hash of each window, of its anchor the gram's and the surroundings' hash, and the word at which
    the surroundings begin."""

    window: np.ndarray
    gram: np.ndarray
    around: np.ndarray
    begin: np.ndarray


def _windows(column: pa.Array, length: int, gram: int, hashed: Callable) -> Iterator[tuple[bytes, int, Windows]]:
    """(bytes, number of words, windows) of each text."""
    span = length - gram + 1  # grams to a window
    powers = worker_state("word-powers", lambda: Powers(0xD1342543DE82EF95))
    for _, data, offsets in text_chunks(column):
        starts, ends, first = find_words(data, offsets)
        hashes = hashed(data, starts, ends, False)
        up, down = powers.upto(len(hashes) + 1)
        summed = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=summed[1:])
        many = max(0, len(hashes) - gram + 1)
        value = mix((summed[gram:] - summed[:many]) * down[:many]) if many else np.zeros(0, np.uint64)
        least, place, width = value, np.arange(many), 1
        while width < span and len(least):
            step = min(width, span - width)
            if len(least) <= step:
                least, place = least[:0], place[:0]
                break
            left = least[:-step] <= least[step:]
            least, place = np.where(left, least[:-step], least[step:]), np.where(left, place[:-step], place[step:])
            width += step
        raw = data.tobytes()
        for d in range(len(first) - 1):
            begin, end = int(first[d]), int(first[d + 1])
            n = max(0, end - begin - length + 1)
            at = np.arange(begin, begin + n)
            seeds = place[begin : begin + n]
            low, high = np.maximum(seeds - (length - gram), begin), np.minimum(seeds + length, end)
            around = mix((summed[high] - summed[low]) * down[low] + mix(((seeds - low) * length * 2 + (high - seeds)).astype(np.uint64)))
            window = mix((summed[at + length] - summed[at]) * down[at] + np.uint64(1)) if n else np.zeros(0, np.uint64)
            yield raw[offsets[d] : offsets[d + 1]], end - begin, Windows(window, value[seeds] if n else window, around if n else window, low - begin if n else window)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _flat(parts: list[np.ndarray], kind: pa.DataType = pa.int64()) -> pa.Array:
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64), kind)


def _runs(hit: np.ndarray, of: np.ndarray, of_t: np.ndarray, shift: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first word, words, document's id and text hash, its first word) of adjoining windows at one distance from the same document."""
    at = np.flatnonzero(hit)
    if len(at):
        breaks = np.flatnonzero((np.diff(at) > 1) | (np.diff(of[at]) != 0) | (of_t[at][1:] != of_t[at][:-1]) | (np.diff(shift[at]) != 0)) + 1
        for part in np.split(at, breaks):
            yield int(part[0]), int(part[-1] - part[0]) + length, int(of[part[0]]), int(of_t[part[0]]), int(part[0] + shift[part[0]])


def _looked_up(keys: np.ndarray, table: list[dict] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which of the keys are in the table (``key``, ``first``, ``first_t``, ``place``), and where they stand first."""
    if not table:
        none = np.zeros(len(keys), np.int64)
        return none.astype(bool), none, none, none
    known, firsts, hashes, places = (np.array([x[c] for x in table], dtype=np.int64) for c in ("key", "first", "first_t", "place"))
    order = np.argsort(known)
    at = order[np.minimum(np.searchsorted(known, keys, sorter=order), len(known) - 1)]
    return known[at] == keys, firsts[at], hashes[at], places[at]


@settled
def repeats(docs: DataFrame, length: int = 50, gram: int = 12, id_col: str = "doc_id", text_col: str = "text", hashed: Callable = word_hashes) -> DataFrame:
    """Per row: id, ``n_words``, ``n_removed``, ``kept_sha256`` (of the kept words, joined by one space) and ``spans``:
    the maximal repeats as (first word, word past the last, id of the document that has them first, their first word in it).

    A word is removed if a window over it also starts in a document of smaller id. Rows that repeat an id do not
    count as smaller; rows with a null id neither lose words nor make others lose any. Null and empty texts have no
    words. Repeated rows have equal results, an empty table gives an empty one. ``hashed`` gives the hashes of words.
    """
    base = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(F.col(text_col)).alias("text"), F.xxhash64(text_col).alias("t"))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        for batch in batches:
            n, sha, grams, arounds, places = [], [], [], [], []
            for raw, words, w in _windows(batch.column(1), length, gram, hashed):
                n.append(words)
                sha.append(hashlib.sha256(b" ".join(raw.split())).hexdigest())
                around, at = np.unique(w.around, return_index=True)
                grams.append(_signed(w.gram[at]))
                arounds.append(_signed(around))
                places.append(w.begin[at].astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(grams, longs), pa.array(arounds, longs), pa.array(places, ints)],
                names=["id", "t", "n_words", "sha", "grams", "arounds", "places"],
            )

    seeded = materialize(lean_batches(base).mapInArrow(seed, "id long, t long, n_words long, sha string, grams array<long>, arounds array<long>, places array<int>"), "seeds")
    anchors = seeded.filter("id is not null").select("id", "t", F.inline(F.arrays_zip("grams", "arounds", "places"))).toDF("id", "t", "gram", "around", "place")
    several = anchors.groupBy("gram").agg(F.min("id").alias("first"), F.max("id").alias("last"), F.min("around").alias("a"), F.max("around").alias("z"))
    # Written first: then the join deals both sides anew, and a gram of very many documents can be split.
    several = materialize(several.filter("first < last").select("gram", (F.col("a") != F.col("z")).alias("differ")), "several")
    shared = materialize(anchors.join(several, "gram"), "shared-anchors")

    # Level 1: the same surroundings. Level 2: the least document of each surroundings, where they differ.
    # A document is named by its id and the hash of its text: an id may repeat.
    earliest = [F.min(F.struct("id", "t", "place")).alias("x"), F.max("id").alias("last")]
    named = [F.col("x.id").alias("first"), F.col("x.t").alias("first_t"), F.col("x.place").alias("at"), F.col("last")]
    where = lambda key: F.struct(F.col(key).alias("key"), F.col("first").alias("first"), F.col("first_t").alias("first_t"), F.col("at").alias("place"))
    least = materialize(shared.groupBy("gram", "around", "differ").agg(*earliest).select("gram", "around", "differ", *named), "surroundings")
    whole = shared.select("id", "gram", "around").join(least.filter("first < last").drop("differ", "last"), ["gram", "around"]).filter("id > first")
    whole = whole.groupBy("id").agg(F.collect_set(where("around")).alias("whole"))
    asked = least.filter("differ").groupBy(F.col("first").alias("id")).agg(F.collect_set("around").alias("asked"))
    flags = materialize(whole.join(asked, "id", "full"), "flags")
    texts = materialize(base.join(flags, "id"), "texts")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, hashes, grams, windows, places = [], [], [], [], []
            for i, t, asked_for, (_, _, w) in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2), _windows(batch.column(1), length, gram, hashed), strict=True):
                at = np.flatnonzero(np.isin(_signed(w.around), np.array(asked_for.as_py() or [], dtype=np.int64)))
                found, place = np.unique(w.window[at], return_index=True)
                ids.append(np.full(len(found), i, np.int64))
                hashes.append(np.full(len(found), t, np.int64))
                windows.append(_signed(found))
                grams.append(_signed(w.gram[at[place]]))
                places.append(at[place])
            yield pa.RecordBatch.from_arrays([_flat(ids), _flat(hashes), _flat(grams), _flat(windows), _flat(places, pa.int32())], names=["id", "t", "gram", "window", "place"])

    extended = materialize(texts.filter("asked is not null").select("id", "text", "asked", "t").mapInArrow(extend, "id long, t long, gram long, window long, place int"), "windows")
    same = extended.groupBy("gram", "window").agg(*earliest).select("gram", "window", *named).filter("first < last")
    later = extended.select("id", "gram", "window").join(same.drop("last"), ["gram", "window"]).filter("id > first").groupBy("id").agg(F.collect_set(where("window")).alias("single"))

    def propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ("first", "n", "of", "of_t", "of_first")
        run = pa.list_(pa.struct([(c, pa.int64() if c in ("of", "of_t") else pa.int32()) for c in fields]))
        for batch in batches:
            out = []
            for whole, single, (_, _, w) in zip(batch.column(2), batch.column(3), _windows(batch.column(1), length, gram, hashed), strict=True):
                at = np.arange(len(w.window))
                hit, of, of_t, place = _looked_up(_signed(w.around), whole.as_py())
                alone, alone_of, alone_t, alone_place = _looked_up(_signed(w.window), single.as_py())
                shift = np.where(hit, place - w.begin.astype(np.int64), alone_place - at)
                out.append([dict(zip(fields, x, strict=True)) for x in _runs(hit | alone, np.where(hit, of, alone_of), np.where(hit, of_t, alone_t), shift, length)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(out, run)], names=["id", "text", "t", "runs"])

    touched = texts.join(later, "id", "left").filter("whole is not null or single is not null").select("id", "text", "whole", "single", "t")
    proposed = materialize(touched.mapInArrow(propose, "id long, text string, t long, runs array<struct<first:int,n:int,of:bigint,of_t:bigint,of_first:int>>"), "proposed")

    # The words themselves: each distinct run of a document that has it first, as a digest.
    runs = proposed.select("id", "t", F.inline("runs"))
    wanted = runs.groupBy("of", "of_t", "of_first", "n").count().groupBy(F.col("of").alias("id"), F.col("of_t").alias("t")).agg(F.collect_list(F.struct("of_first", "n")).alias("wanted"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, of_t, first, n, sha = [], [], [], [], []
            for i, text, t, asked_for in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                words = text.encode().split()
                for x in asked_for:
                    of.append(i), of_t.append(t), first.append(x["of_first"]), n.append(x["n"])
                    sha.append(hashlib.sha256(b" ".join(words[x["of_first"] : x["of_first"] + x["n"]])).digest())
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(of_t, pa.int64()), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(sha, pa.binary())], names=["of", "of_t", "of_first", "n", "sha"])

    proofs = materialize(base.join(wanted, ["id", "t"]).select("id", "text", "t", "wanted").mapInArrow(digest, "of long, of_t long, of_first int, n int, sha binary").distinct(), "proofs")
    proven = runs.join(proofs, ["of", "of_t", "of_first", "n"]).groupBy("id", "t").agg(F.collect_set(F.struct("first", "n", "of", "of_first", "sha")).alias("proofs"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("of", pa.int64()), ("of_first", pa.int32())]))
        for batch in batches:
            n, removed, sha, spans = [], [], [], []
            for text, runs, proofs in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                words = text.encode().split()
                known = {(x["first"], x["n"], x["of"], x["of_first"], x["sha"]) for x in proofs or []}
                equal = [r for r in runs if (r["first"], r["n"], r["of"], r["of_first"], hashlib.sha256(b" ".join(words[r["first"] : r["first"] + r["n"]])).digest()) in known]
                cover = np.zeros(len(words) + 1, np.int64)
                for r in equal:
                    cover[r["first"]] += 1
                    cover[r["first"] + r["n"]] -= 1
                gone = np.cumsum(cover[:-1]) > 0
                n.append(len(words))
                removed.append(int(gone.sum()))
                sha.append(hashlib.sha256(b" ".join(x for x, g in zip(words, gone, strict=True) if not g)).hexdigest())
                spans.append([{"first": r["first"], "last": r["first"] + r["n"], "of": r["of"], "of_first": r["of_first"]} for r in equal])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, kind)], names=["id", "n_words", "n_removed", "kept_sha256", "spans"])

    spans = "array<struct<first:int,last:int,of:bigint,of_first:int>>"
    some = proposed.filter(F.size("runs") > 0)
    changed = some.join(proven, ["id", "t"], "left").select("id", "text", "runs", "proofs").mapInArrow(remove, f"id long, n_words long, n_removed long, kept_sha256 string, spans {spans}")
    plain = seeded.join(some.select("id", "t").distinct(), ["id", "t"], "left_anti").select("id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.array().cast(spans).alias("spans"))
    return plain.unionByName(changed).withColumnRenamed("id", id_col)


#: The same, without spans, for DuckDB: every window spelled out.
SQL = r"""
WITH worded AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM {docs}),
windows AS (SELECT doc_id, pos, array_to_string(words[pos:pos + 49], ' ') AS content FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS pos FROM worded)),
repeated AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY content) AS first FROM windows) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 50)) AS pos FROM repeated),
listed AS (SELECT doc_id, list(pos) AS gone, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' ')) AS kept_sha256
FROM worded w LEFT JOIN listed g ON w.doc_id = g.doc_id
"""
