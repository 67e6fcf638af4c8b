"""A log of numbered commits, each made by compare-and-set, and tables that are switched by it.

Entry n is a file that is written whole under another name and then published under its number, if no one has: by a
hard link on a local file system, elsewhere by a rename that refuses to overwrite. So of two writers that saw the
same state one wins, and a reader sees an entry whole or not at all. Data is written before its entry, to a folder
that no other attempt uses, and is never overwritten.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from lodestore.sources.shared import shared_folder


class Conflict(RuntimeError):
    """Another writer committed first."""


class Files:
    """A folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = self.path(folder.rstrip("/"))
        self.fs = at.getFileSystem(self.conf)
        self.folder = self.fs.makeQualified(at).toString()

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def at(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def names(self, below: str) -> list[str]:
        where = self.path(self.at(below))
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(self.at(name)))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(self.at(name)))

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(self.at(name)), True)

    def publish(self, name: str, text: str) -> bool:
        """Create ``name`` with ``text`` if it does not exist; whole, or not at all."""
        folder, _, last = name.rpartition("/")
        draft = f"{folder}/.{last}-{uuid.uuid4().hex}"
        stream = self.fs.create(self.path(self.at(draft)), False)
        stream.write(text.encode())
        stream.close()
        try:
            parsed = urlparse(self.folder)
            if parsed.scheme == "file":
                local = unquote(parsed.path)
                os.link(f"{local}/{draft}", f"{local}/{name}")
                return True
            context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path(self.folder).toUri(), self.conf)
            none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
            context.rename(self.path(self.at(draft)), self.path(self.at(name)), none)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.delete(draft)


class CommitLog:
    """Entries 1, 2, ... of a folder; the last one is the state."""

    FOLDER = "_commits"

    def __init__(self, spark: SparkSession, folder: str):
        self.files = Files(spark, folder)

    def last(self) -> int:
        """The number of the last entry, 0 if there is none."""
        return max((int(n) for n in self.files.names(self.FOLDER) if n.isdigit()), default=0)

    def entry(self, n: int | None = None) -> dict | None:
        n = self.last() if n is None else n
        return json.loads(self.files.read(f"{self.FOLDER}/{n:020d}")) if n else None

    def append(self, entry: dict, seen: int) -> int:
        """Make ``entry`` the one after ``seen``, or raise ``Conflict`` if another is."""
        if not self.files.publish(f"{self.FOLDER}/{seen + 1:020d}", json.dumps(entry, sort_keys=True, ensure_ascii=False)):
            raise Conflict(f"entry {seen + 1} of {self.files.folder} exists")
        return seen + 1

    def update(self, change: Callable[[dict | None], dict], tries: int = 10) -> int:
        """Append ``change(state)``; where another writer was first, its state is read and the change made again."""
        for k in range(tries):
            seen = self.last()
            try:
                return self.append(change(self.entry(seen)), seen)
            except Conflict:
                if k + 1 == tries:
                    raise
        raise AssertionError


def written(log: CommitLog, df: DataFrame, name: str, *partitions: str) -> str:
    """Write ``df`` to a folder of its own below the log's, and return its name."""
    found = f"{name}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partitions) if partitions else df.write
    writer.parquet(log.files.at(found))
    return found


def write_generation(chunks: DataFrame, folder: str, generation: int, expected: int | None = None) -> int:
    """All chunks of a generation, then the entry that switches to it (SNK01); returns the entry's number.

    With ``expected``, the number of the entry that the writer's work began from, a writer that another overtook fails
    with ``Conflict`` and its chunks stay unread; without, the last writer stands. Readers see the old generation or the
    new one, whole, and one being read is not touched.
    """
    log = CommitLog(chunks.sparkSession, folder)
    path = written(log, chunks, f"generation-{generation}")
    entry = {"generation": generation, "path": path, "schema": chunks.schema.json()}
    if expected is None:
        return log.update(lambda _: entry)
    try:
        return log.append(entry, expected)
    except Conflict:
        log.files.delete(path)
        raise


def read_active(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of the generation that the last entry names."""
    log = CommitLog(spark, folder)
    entry = log.entry()
    if entry is None:
        raise FileNotFoundError(f"no generation is active in {folder}")
    return spark.read.parquet(log.files.at(entry["path"]))


def drop_unnamed(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Delete the data folders that none of the last ``keep`` entries names; only while no writer is at work."""
    log = CommitLog(spark, folder)
    n = log.last()
    named = json.dumps([log.entry(k) for k in range(max(1, n - keep + 1), n + 1)])
    gone = [f for f in log.files.names("") if f != log.FOLDER and f not in named]
    for f in gone:
        log.files.delete(f)
    return gone


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder of its session and read again, for what several steps read."""
    spark = df.sparkSession
    log = CommitLog(spark, f"{shared_folder(spark)}/lodestore-{spark.sparkContext.applicationId}/{name}")
    return spark.read.schema(df.schema).parquet(log.files.at(written(log, df, name)))
