"""The folder that driver and executors share, and tables derived from inputs that are kept there."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session of one machine may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}").rstrip("/")


def files_digest(df: DataFrame) -> str:
    """One digest of the names, sizes and times of the files that ``df`` reads; no data is read."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    one = F.concat_ws("|", *files.columns)
    summed = files.select(F.conv(F.substring(F.sha2(one, 256), 1, 15), 16, 10).cast("decimal(38,0)").alias("d")).agg(F.count("*"), F.sum("d")).first()
    return hashlib.sha256(str(tuple(summed)).encode()).hexdigest()[:24]


_made: dict[tuple[str, str], str] = {}


def derived(source: DataFrame, name: str, make: Callable[[str], None]) -> str:
    """The folder of what ``make(folder)`` derives from the files of ``source``, made once a session and state of them."""
    spark = source.sparkSession
    key = (spark.sparkContext.applicationId, f"{name}-{files_digest(source)}")
    if key not in _made:
        folder = f"{shared_folder(spark)}/lodestore-{key[0]}/{key[1]}"
        make(folder)
        _made[key] = folder
    return _made[key]
