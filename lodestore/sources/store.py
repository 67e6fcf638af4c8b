"""A store of tables, its backup and restore, and the purge of its content (SNK03, OPS04, MUT12).

A table is a folder of generations (``sources.commits``). A backup holds the tables, the digest of each of its files, and
a manifest that is published last; a marker says that it is not done yet. What is restored has been held against the
manifest, file by file, and is held against the fingerprints again afterwards. A purge keeps a journal of its phases,
each of which can be repeated, so one that was stopped anywhere is taken up where it stood.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestore.operators import merkle
from lodestore.sources.commits import CommitLog, Files, read_active, write_generation

FORMAT = 1
INCOMPLETE, MANIFEST = "INCOMPLETE", "manifest.json"


class Refused(ValueError):
    """The backup, its target or the store is not in the state that the work needs."""


def fingerprint(df: DataFrame) -> dict:
    """Rows and root digest, which no order of the rows changes, and the depth of its tree."""
    n = df.count()
    depth = merkle.depth_for(n)
    rows, digest = merkle.root(merkle.tree(merkle.leaves(df, depth), depth))
    return {"rows": rows, "digest": digest, "depth": depth}


class Store:
    """Tables by name below ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, Files(spark, folder)

    def at(self, name: str) -> str:
        return self.files.at(name)

    def names(self) -> list[str]:
        return sorted(n for n in self.files.names("") if CommitLog(self.spark, self.at(n)).last())

    def read(self, name: str) -> DataFrame:
        return read_active(self.spark, self.at(name))

    def number(self, name: str) -> int:
        """The number of the table's last switch."""
        return CommitLog(self.spark, self.at(name)).last()

    def write(self, name: str, df: DataFrame, expected: int | None = None) -> int:
        return write_generation(df, self.at(name), self.number(name) + 1, expected)

    def snapshot(self) -> dict[str, dict]:
        return {n: fingerprint(self.read(n)) for n in self.names()}


def _listed(spark: SparkSession, folder: str) -> DataFrame:
    """``path`` (below the folder), ``length``, ``sha256`` of the data files there."""
    whole = Files(spark, folder).folder
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(whole)
    return found.select(F.substring_index("path", f"{whole.split('://')[-1].removeprefix('file:')}/", -1).alias("path"), "length", F.sha2("content", 256).alias("sha256"))


def backup(store: Store, target: str, names: list[str] | None = None) -> dict:
    """Write the tables to a new folder, in two phases: data and file digests, then the manifest; returns it."""
    spark, files = store.spark, Files(store.spark, target)
    if files.names(""):
        raise Refused("a backup needs a new folder")
    files.publish(f"./{INCOMPLETE}", "not to be restored\n")
    tables = {}
    for name in names or store.names():
        seen, df = store.number(name), store.read(name)
        df.write.parquet(files.at(f"tables/{name}"))
        tables[name] = fingerprint(spark.read.parquet(files.at(f"tables/{name}"))) | {"schema": json.loads(df.schema.json()), "number": seen}
    _listed(spark, files.at("tables")).write.parquet(files.at("digests"))
    manifest = {"format": FORMAT, "tables": tables, "digests": fingerprint(spark.read.parquet(files.at("digests")))}
    files.publish(f"./{MANIFEST}", json.dumps(manifest, sort_keys=True, ensure_ascii=False))
    files.delete(INCOMPLETE)
    return manifest


def damaged(spark: SparkSession, target: str) -> DataFrame:
    """``path`` and ``status`` of files that are ``missing``, ``unexpected`` or ``changed`` against the digests."""
    files = Files(spark, target)
    kept = spark.read.parquet(files.at("digests")).select("path", F.col("length").alias("k_length"), F.col("sha256").alias("k_sha"))
    met = kept.join(_listed(spark, files.at("tables")), "path", "full")
    status = F.when(F.col("sha256").isNull(), "missing").when(F.col("k_sha").isNull(), "unexpected").when((F.col("k_sha") != F.col("sha256")) | (F.col("k_length") != F.col("length")), "changed")
    return met.select("path", status.alias("status")).filter("status IS NOT NULL")


def validated(spark: SparkSession, target: str) -> dict:
    """The manifest of a backup that is complete and unchanged; else ``Refused``."""
    files = Files(spark, target)
    if files.exists(INCOMPLETE) or not files.exists(MANIFEST):
        raise Refused("the backup is not complete")
    manifest = json.loads(files.read(MANIFEST))
    if manifest.get("format") != FORMAT:
        raise Refused("unknown format of a backup")
    if sorted(files.names("tables")) != sorted(manifest["tables"]):
        raise Refused("the tables are not those of the manifest")
    if fingerprint(spark.read.parquet(files.at("digests"))) != manifest["digests"]:
        raise Refused("the digests of the files have changed")
    bad = damaged(spark, target).limit(5).collect()
    if bad:
        raise Refused(f"files of the backup differ: {[(r['path'], r['status']) for r in bad]}")
    return manifest


def requeued(jobs: DataFrame) -> DataFrame:
    """Jobs as they are after a restore: what was running is queued again under a new fence, without its lease."""
    running = F.col("state") == "running"
    return jobs.withColumns({"generation": F.when(running, F.col("generation") + 1).otherwise(F.col("generation")), "lease_until": F.when(~running, F.col("lease_until")), "state": F.when(running, "queued").otherwise(F.col("state"))})


def restore(spark: SparkSession, target: str, store: Store, exactly: list[str] | None = None, after: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> dict:
    """Fill an empty store from a backup, and return the manifest. ``exactly``: the tables that the backup must hold.
    ``after``: what becomes of a table, once it has been verified; ``jobs`` are queued again."""
    if store.files.names(""):
        raise Refused("a restore needs an empty store")
    manifest = validated(spark, target)
    if exactly is not None and sorted(exactly) != sorted(manifest["tables"]):
        raise Refused("the backup holds other tables than asked for")
    changes = {"jobs": requeued} | (after or {})
    for name, kept in manifest["tables"].items():
        df = spark.read.schema(T.StructType.fromJson(kept["schema"])).parquet(Files(spark, target).at(f"tables/{name}"))
        if fingerprint(df) != {k: kept[k] for k in ("rows", "digest", "depth")}:
            raise Refused(f"{name} differs from its fingerprint")
        store.write(name, changes[name](df) if name in changes else df, expected=0)
    return manifest


#: Phases of a purge, in order.
PHASES = ("begun", "backed_up", "clearing", "cleared", "complete")


class Purge:
    """The removal of all rows of the ``content`` tables of a store, after a backup into ``archive``."""

    def __init__(self, store: Store, archive: str, content: list[str]):
        self.store, self.archive, self.content = store, archive, sorted(content)
        self.journal = CommitLog(store.spark, f"{archive}/journal")

    def phase(self) -> str | None:
        entry = self.journal.entry()
        return entry["phase"] if entry else None

    def _note(self, phase: str, **more: object) -> None:
        seen = self.journal.last()
        self.journal.append((self.journal.entry(seen) or {}) | more | {"phase": phase}, seen)

    def run(self, stop_after: str | None = None) -> dict:
        """Begin, or go on from the last phase that the journal has; returns its last entry.

        The store must not change between backup and clearing, else it is refused and nothing is removed. Each table is
        cleared by a switch from the generation that was backed up, so a write in between is never lost. Tables that are
        not content must have the same fingerprints at the end.
        """
        steps = {None: self._begin, "begun": self._back_up, "backed_up": self._check, "clearing": self._clear, "cleared": self._verify}
        while (phase := self.phase()) != "complete":
            steps[phase]()
            if self.phase() == stop_after:
                break
        return self.journal.entry()

    def _begin(self) -> None:
        missing = set(self.content) - set(self.store.names())
        if missing:
            raise Refused(f"no such tables: {sorted(missing)}")
        self._note("begun", content=self.content)

    def _back_up(self) -> None:
        files = Files(self.store.spark, self.archive)
        if not files.exists(f"backup/{MANIFEST}") or files.exists(f"backup/{INCOMPLETE}"):
            files.delete("backup")  # what an earlier try left half done
            backup(self.store, files.at("backup"))
        manifest = validated(self.store.spark, files.at("backup"))
        self._note("backed_up", before={n: {k: t[k] for k in ("rows", "digest", "depth")} for n, t in manifest["tables"].items()}, numbers={n: t["number"] for n, t in manifest["tables"].items()})

    def _check(self) -> None:
        entry = self.journal.entry()
        if {n: self.store.number(n) for n in self.store.names()} != entry["numbers"] or self.store.snapshot() != entry["before"]:
            raise Refused("the store changed after its backup; nothing was removed")
        self._note("clearing")

    def _clear(self) -> None:
        numbers = self.journal.entry()["numbers"]
        for name in self.content:
            if self.store.number(name) == numbers[name]:
                self.store.write(name, self.store.read(name).limit(0), expected=numbers[name])
            elif self.store.number(name) != numbers[name] + 1 or not self.store.read(name).isEmpty():
                raise Refused(f"{name} was written during the purge")
        self._note("cleared")

    def _verify(self) -> None:
        after, before = self.store.snapshot(), self.journal.entry()["before"]
        if any(after[n]["rows"] for n in self.content) or any(after[n] != before[n] for n in before if n not in self.content):
            raise Refused("content is left, or protected tables have changed")
        self._note("complete", after=after)
