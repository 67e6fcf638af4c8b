"""Session settings the engine assumes: UTC, adaptive execution, Arrow."""

import re

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.config(map=SETTINGS | {k.replace("_", "."): v for k, v in more.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def lean_batches(spark: SparkSession, rows: int = 1000, size: int = 1 << 20) -> None:
    """Arrow batches of the session have from now on at most ``rows`` rows and about ``size`` bytes. Words of a text as
    Python strings take some fifty times its bytes, so a worker's memory is bounded by its batches and its longest text."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(name))
        if now is None or not 0 < int(now[1]) <= most:
            spark.conf.set(name, str(most))
