"""Results of expensive work, kept by content and version of the worker (SRC20, VIS01).

Equal contents are worked on once, and not at all if a result of the same version is kept. A piece that fails is tried
once more and then is a failure of its own: what the other pieces gave stays. A daily budget bounds how many pieces
may be begun; the rest wait for another day. Results are written before the entry that makes them known, so a run that
is lost costs only its own work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.sources.commits import CommitLog, written

KEPT = "content string, version string, result string, error string, attempts int, day string"


class Memo:
    """The results in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.log = spark, CommitLog(spark, folder)

    def kept(self) -> DataFrame:
        """All results: ``content`` (SHA-256), ``version``, ``result`` or ``error``, ``attempts``, ``day``."""
        parts = (self.log.entry() or {"parts": []})["parts"]
        read = [self.spark.read.schema(KEPT).parquet(self.log.files.at(p)) for p in parts]
        return reduce(DataFrame.unionByName, read) if read else self.spark.createDataFrame([], KEPT)

    def spent(self, day: str) -> int:
        """Pieces begun on a day, of whatever version."""
        return self.kept().filter(F.col("day") == day).count()

    def run(self, items: DataFrame, work: Callable[[str], str], version: str, day: str, order: list[str], budget: int = 0, again: bool = False) -> DataFrame:
        """``items`` with ``status`` (``done``, ``failed``, ``deferred``), ``result`` and ``error``.

        ``items`` have a string column ``content`` (null: the empty text). ``work`` raises what it fails with. Of what is
        new the first by ``order`` are begun while the ``budget`` of the day lasts (0: no bound). Failures are kept like
        results; ``again`` tries them anew. Raises ``Conflict`` if another run committed meanwhile: its work is kept, run
        again and only the rest is done.
        """
        seen = self.log.last()
        named = items.withColumn("_content", F.sha2(F.coalesce("content", F.lit("")), 256))
        have = self.kept().filter(F.col("version") == version)
        if again:
            have = have.filter(F.col("error").isNull())
        wanted = named.groupBy("_content").agg(F.min(F.struct(*order)).alias("_first"), F.first(F.coalesce("content", F.lit(""))).alias("_text"))
        todo = wanted.join(have.select(F.col("content").alias("_content")), "_content", "left_anti")
        if budget:
            left = max(0, budget - self.spent(day))
            todo = todo.orderBy("_first", "_content").limit(left)

        def tried(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for content, text in zip(frame["_content"], frame["_text"], strict=True):
                    for attempt in (1, 2):
                        try:
                            row = (content, version, work(text), None, attempt, day)
                            break
                        except Exception as e:  # noqa: BLE001 - whatever it is, it is this piece's failure
                            row = (content, version, None, f"{type(e).__name__}: {e}", attempt, day)
                    rows.append(row)
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in KEPT.split(", ")])

        if not todo.isEmpty():
            part = written(self.log, todo.select("_content", "_text").mapInPandas(tried, KEPT), "results")
            self.log.append({"parts": [*(self.log.entry(seen) or {"parts": []})["parts"], part]}, seen)
        # of several results of a content and version, one from a later try of a failure among them, a good one counts
        found = self.kept().filter(F.col("version") == version).groupBy(F.col("content").alias("_content")).agg(F.max(F.struct("result", "error")).alias("_kept"))
        status = F.when(F.col("_kept").isNull(), "deferred").when(F.col("_kept.error").isNull(), "done").otherwise("failed")
        return named.join(found, "_content", "left").select(*items.columns, status.alias("status"), F.col("_kept.result").alias("result"), F.col("_kept.error").alias("error"))


def page_ranges(pages: Column) -> Column:
    """(``first``, ``last``) of the ranges in which a file of so many pages is worked on: an eighth of them each."""
    size = F.greatest(F.lit(1), F.floor(pages / 8).cast("int"))
    starts = F.when(pages > 0, F.sequence(F.lit(1), F.greatest(pages, F.lit(1)), size)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + size - 1, pages).alias("last")))


def range_notice(first: Column, last: Column) -> Column:
    """Fixed value: what a reader is told of a range that failed."""
    return F.format_string("第 %d-%d 页解析未完成，该范围请核对原文件。", first, last)


def merged(ranges: DataFrame, key: str) -> DataFrame:
    """Of ranges (key, ``first``, ``last``, ``status``, ``result``): per key ``state`` (``ready``; ``partial`` if some
    failed or wait; ``failed`` if none was done), ``text`` of those done in order, and ``warnings`` in order."""
    done, failed = F.col("status") == "done", F.col("status") == "failed"
    listed = lambda when, value: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("first", value.alias("v"))))), lambda x: x["v"])
    n, n_done = F.count("*"), F.count_if(done)
    state = F.when(n_done == 0, "failed").when(n_done < n, "partial").otherwise("ready")
    return ranges.groupBy(key).agg(state.alias("state"), F.array_join(listed(done, F.col("result")), "\n").alias("text"), listed(failed, range_notice(F.col("first"), F.col("last"))).alias("warnings"))
