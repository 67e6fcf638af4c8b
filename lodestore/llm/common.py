"""What the operators of this subpackage share: reading, shared storage, word patterns."""

from __future__ import annotations

import os
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper and lower case; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only a session of one machine may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}").rstrip("/")


#: Paths of the tables written inside the innermost ``settled`` or ``scratch`` block.
_written: ContextVar[list[tuple[SparkSession, str]] | None] = ContextVar("written", default=None)
#: Tables of the catalog among them, by path.
_named: dict[str, str] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestore-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    written = _written.get()
    if written is not None:
        written.append((spark, path))
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._lodestore_path = path
    return found


def bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``materialize``, in as many buckets of ``key`` as shuffles have partitions: joins on ``key`` leave its rows where they are."""
    spark = df.sparkSession
    own = f"lodestore_{name}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/lodestore-{spark.sparkContext.applicationId}/{own}"
    written = _written.get()
    if written is not None:
        written.append((spark, path))
        _named[path] = own
    df.write.format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).saveAsTable(own)
    return spark.table(own)


def _delete(spark: SparkSession, path: str) -> None:
    if path in _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop(path)}")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files of a DataFrame that ``materialize`` or a ``settled`` operator returned, once nothing reads it."""
    _delete(df.sparkSession, df._lodestore_path)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end of the block."""
    written: list[tuple[SparkSession, str]] = []
    token = _written.set(written)
    try:
        yield
    finally:
        _written.reset(token)
        for spark, path in written:
            _delete(spark, path)


def settled(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """An operator whose result is written to the shared folder, and whose intermediate tables are then deleted."""

    @wraps(operator)
    def run(*args: Any, **kwargs: Any) -> DataFrame:
        outer = _written.get()
        with scratch():
            result = operator(*args, **kwargs)
            token = _written.set(outer)
            try:
                return materialize(result, operator.__name__.replace("_", "-"))
            finally:
                _written.reset(token)

    return run


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that columns of ``df`` have."""
    used = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in used:
            name = f"_{name}"
        used.add(name.lower())
        out.append(name)
    return out


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


#: States that a task needs whatever operator it belongs to; they are small.
LASTING = ("powers", "word-powers", "byte-values")


def worker_state(name: str, make: Callable[[], Any], *key: Any) -> Any:
    """What ``make`` returns, kept for later tasks of the same Python worker under ``name`` and ``key``.

    One operator's state is kept at a time: that of another ``name`` is dropped when this one is made.
    """
    kept = sys.modules.setdefault("_lodestore_worker_state", types.ModuleType("_lodestore_worker_state")).__dict__
    if (name, key) not in kept:
        if name not in LASTING:
            for other in [k for k in kept if isinstance(k, tuple) and k[0] not in LASTING]:
                del kept[other]
        kept[(name, key)] = make()
    return kept[(name, key)]


def lean_batches(df: DataFrame, rows: int = 1000, size: int = 8 << 20) -> DataFrame:
    """``df``, with Arrow batches in this session of at most ``rows`` rows and about ``size`` bytes: texts may be long,
    and memory is bounded by batches."""
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = re.fullmatch(r"(\d+)b?", conf.get(name))
        if now is None or not 0 < int(now[1]) <= most:
            conf.set(name, str(most))
    return df
