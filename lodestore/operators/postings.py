"""An inverted index of chunks, kept beside them: which words stand in which chunk, how often.

Postings are tables partitioned by a bucket of the word, so a search reads the buckets of its words and no text. The
index is a list of segments, never changed once written: an update tokenizes only the chunks that differ from those
indexed, and writes one segment with their postings and one list of the chunks whose older postings no longer count.
The list of segments is switched by compare-and-set, so readers see one state and two writers cannot both win.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.functions.text import segmented
from lodestore.sources.commits import CommitLog, written

KEY = ("doc_id", "ordinal")
BUCKETS = 64
#: Files into which the postings of a bucket are dealt, so a word of every chunk is not one task's.
SPREAD = 4


def bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets


def _bucket(word: Column, buckets: int) -> Column:
    return F.crc32(F.encode(word, "UTF-8")) % buckets


class Postings:
    """The index in ``folder``. ``tokens``: from a text column to an array of its words, in the order they stand."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, spread: int = SPREAD, tokens: Callable[[Column], Column] = segmented):
        self.spark, self.log, self.spread, self.tokens = spark, CommitLog(spark, folder), spread, tokens
        entry = self.log.entry()
        self.buckets = entry["buckets"] if entry else buckets

    def _segments(self) -> list[dict]:
        entry = self.log.entry()
        return entry["segments"] if entry else []

    def _table(self, name: str, kind: str) -> DataFrame:
        schema = {"postings": "word string, doc_id long, ordinal int, n int, bucket long", "chunks": "doc_id long, ordinal int, digest string, n int", "dead": "doc_id long, ordinal int"}
        return self.spark.read.schema(schema[kind]).parquet(self.log.files.at(name))

    def _segment(self, chunks: DataFrame) -> dict:
        """Write the segment of chunks (``doc_id``, ``ordinal``, ``text``). The words are written first, so texts are cut
        once; postings are counted where they will lie, since equal words of a chunk go to one task in any case."""
        cut = chunks.select(F.col("doc_id").cast("long"), F.col("ordinal").cast("int"), F.sha2(F.col("text"), 256).alias("digest"), self.tokens(F.coalesce("text", F.lit(""))).alias("words"))
        words = written(self.log, cut, "words")
        found = self.spark.read.schema(cut.schema).parquet(self.log.files.at(words))
        share = F.pmod(F.xxhash64("doc_id"), F.lit(self.spread))
        each = found.select(*KEY, F.explode("words").alias("word")).withColumns({"bucket": _bucket(F.col("word"), self.buckets), "share": share})
        # a file for each bucket and share of the documents, sorted by word: row groups of other words are skipped
        dealt = each.repartition(self.buckets * self.spread, "bucket", "share")
        counted = dealt.groupBy("bucket", "share", "word", *KEY).agg(F.count("*").cast("int").alias("n")).drop("share")
        segment = {
            "postings": written(self.log, counted.sortWithinPartitions("bucket", "word", *KEY), "postings", "bucket"),
            "chunks": written(self.log, found.select(*KEY, "digest", F.size("words").alias("n")), "chunks"),
        }
        self.log.files.delete(words)
        return segment

    def build(self, chunks: DataFrame) -> None:
        """The index of all chunks (``doc_id``, ``ordinal``, ``text``), in place of what it was."""
        seen = self.log.last()
        self.log.append({"buckets": self.buckets, "segments": [self._segment(chunks)]}, seen)

    def indexed(self) -> DataFrame:
        """The chunks that count: ``doc_id``, ``ordinal``, ``digest``, ``n`` (words)."""
        return self._live("chunks", [self._table(s["chunks"], "chunks") for s in self._segments()])

    def _live(self, kind: str, tables: list[DataFrame]) -> DataFrame:
        """The rows of all segments that no later segment declares dead."""
        segments = self._segments()
        empty = {"postings": "word string, doc_id long, ordinal int, n int, bucket long", "chunks": "doc_id long, ordinal int, digest string, n int"}[kind]
        if not segments:
            return self.spark.createDataFrame([], empty)
        rows = reduce(DataFrame.unionByName, (t.withColumn("_segment", F.lit(k)) for k, t in enumerate(tables)))
        dead = [self._table(s["dead"], "dead").withColumn("_until", F.lit(k)) for k, s in enumerate(segments) if "dead" in s]
        if not dead:
            return rows.drop("_segment")
        until = reduce(DataFrame.unionByName, dead).groupBy(*KEY).agg(F.max("_until").alias("_until"))
        return rows.join(until, list(KEY), "left").filter(F.col("_until").isNull() | (F.col("_segment") >= F.col("_until"))).drop("_segment", "_until")

    def update(self, chunks: DataFrame) -> dict[str, int]:
        """Make the index that of ``chunks``, all chunks there are now: only those that are new or differ are tokenized.

        Raises ``Conflict`` if another update came first. Returns how many chunks were ``written`` and ``dropped``.
        """
        seen = self.log.last()
        if not seen:
            self.build(chunks)
            return {"written": self.indexed().count(), "dropped": 0}
        now = chunks.select(F.col("doc_id").cast("long"), F.col("ordinal").cast("int"), "text", F.sha2(F.col("text"), 256).alias("_digest"))
        met = now.select(*KEY, "_digest", F.lit(True).alias("_now")).join(self.indexed().select(*KEY, "digest", F.lit(True).alias("_was")), list(KEY), "full")
        differs = met.filter(F.col("_now").isNull() | F.col("_was").isNull() | ~F.col("_digest").eqNullSafe(F.col("digest")))
        status = written(self.log, differs.select(*KEY, F.coalesce("_now", F.lit(False)).alias("now"), F.coalesce("_was", F.lit(False)).alias("was")), "differing")
        changed = self.spark.read.parquet(self.log.files.at(status))
        n_written, n_dropped = (int(x or 0) for x in changed.agg(F.sum(F.col("now").cast("int")), F.sum((F.col("was") & ~F.col("now")).cast("int"))).first())
        if n_written or n_dropped:
            segment = self._segment(now.join(changed.filter("now").select(*KEY), list(KEY), "left_semi"))
            segment["dead"] = written(self.log, changed.filter("was").select(*KEY), "dead")
            self.log.append({"buckets": self.buckets, "segments": [*self.log.entry(seen)["segments"], segment]}, seen)
        self.log.files.delete(status)
        return {"written": n_written, "dropped": n_dropped}

    def compact(self) -> None:
        """All segments as one; postings are read, texts are not."""
        seen = self.log.last()
        rows = self._live("postings", [self._table(s["postings"], "postings") for s in self._segments()])
        sorted_ = rows.repartition(self.buckets * self.spread, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.spread))).sortWithinPartitions("bucket", "word", *KEY)
        segment = {"postings": written(self.log, sorted_.select("word", *KEY, "n", "bucket"), "postings", "bucket"), "chunks": written(self.log, self.indexed(), "chunks")}
        self.log.append({"buckets": self.buckets, "segments": [segment]}, seen)

    def postings(self, words: list[str]) -> DataFrame:
        """``word``, ``doc_id``, ``ordinal``, ``n`` of these words: only their buckets are read."""
        buckets = sorted({bucket(w, self.buckets) for w in words})
        wanted = F.col("bucket").isin(buckets) & F.col("word").isin(sorted(set(words))) if words else F.lit(False)
        return self._live("postings", [self._table(s["postings"], "postings").filter(wanted) for s in self._segments()]).select("word", *KEY, "n")

    def ranked(self, words: list[str]) -> DataFrame:
        """``doc_id``, ``ordinal``, ``value``: a tenth of the number of places where one of the words stands (VEC03)."""
        return self.postings(words).groupBy(*KEY).agg((F.sum("n") * F.lit(0.1)).alias("value"))

    def holding(self, words: list[str]) -> DataFrame:
        """``doc_id`` of the documents that hold one of the words in some chunk (JOI04)."""
        return self.postings(words).select("doc_id").distinct()
