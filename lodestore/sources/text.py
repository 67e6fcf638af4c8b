"""Text files: decoding, blocks, sections, tables of comma-separated values; and folders of files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.functions.text import without_nul
from lodestore.operators.dataflow import sections
from lodestore.sources.commits import read_active, write_generation  # noqa: F401

TEXT = ("txt", "md", "markdown", "csv", "json", "log")
GB_NOTICE = "文本按 GB18030 解码；请核对个别字符。"
NUL_NOTICE = "文本中的不可见空字符已替换为空格；原文件保留。"


def listing(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """Files of a folder and those below it: ``path``, ``modificationTime``, ``length``, ``content`` (OPS08)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)


def folder_digest(files: DataFrame) -> DataFrame:
    """One row: ``files`` and ``digest`` over their sorted paths and contents, the identity of a model's folder (AGG20)."""
    one = F.concat_ws(" ", "path", F.sha2("content", 256))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sha2(F.array_join(F.array_sort(F.collect_list(one)), "\n"), 256).alias("digest"))


def decoded(files: DataFrame) -> DataFrame:
    """``path``, ``text``, ``warnings``: UTF-8 with or without a mark, else GB18030 with a notice (SRC02)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, warnings = [], []
            for raw in frame["content"]:
                try:
                    texts.append(bytes(raw).decode("utf-8-sig"))
                    warnings.append([])
                except UnicodeDecodeError:
                    texts.append(bytes(raw).decode("gb18030", "replace"))
                    warnings.append([GB_NOTICE])
            yield pd.DataFrame({"path": frame["path"], "text": texts, "warnings": warnings})

    return files.select("path", "content").mapInPandas(run, "path string, text string, warnings array<string>")


def text_chunks(texts: DataFrame) -> DataFrame:
    """``path``, ``ordinal``, ``text``, ``paragraph``, ``section`` of texts (``path``, ``text``): blocks between blank
    lines; blank blocks count for ``paragraph`` but are dropped, and a block that begins with ``#`` names the section
    of itself and those that follow (SRC02)."""
    clean = F.replace(without_nul(F.col("text")), F.lit("\r\n"), F.lit("\n"))
    blocks = texts.select("path", F.posexplode(F.split(clean, "\n\n")).alias("paragraph", "text")).withColumn("text", F.trim("text"))
    heading = F.when(F.startswith("text", F.lit("#")), F.btrim(F.regexp_replace(F.split_part("text", F.lit("\n"), F.lit(1)), "^#+", "")))
    named = sections(blocks, "path", "paragraph", heading).filter(F.regexp_replace("text", r"\s+", "") != "")
    nth = F.row_number().over(_by_path()) - 1
    return named.select("path", nth.alias("ordinal"), "text", (F.col("paragraph") + 1).alias("paragraph"), "section")


def _by_path():
    from pyspark.sql import Window as W

    return W.partitionBy("path").orderBy("paragraph")


def notices(texts: DataFrame) -> DataFrame:
    """``path``, ``warnings`` with the notice on NUL characters, once a file (STR10)."""
    return texts.select("path", F.when(F.contains("text", F.lit("\0")), F.array_append("warnings", F.lit(NUL_NOTICE))).otherwise(F.col("warnings")).alias("warnings"))


def append_failures(events: DataFrame, folder: str) -> None:
    """An append-only log of one line an event: time, kind, message, then key=value (SNK04)."""
    details = F.array_join(F.transform(F.array_sort(F.map_entries("details")), lambda e: F.concat_ws("=", e["key"], e["value"])), " ")
    line = F.concat_ws(" | ", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), "kind", F.regexp_replace("message", r"[\r\n]+", " "), details)
    events.select(line.alias("value")).write.mode("append").text(folder)
