"""License scans: an exact set-similarity join of text blocks with license templates; DataFrame operations only.

A block is as many consecutive words of a document as a template has, and a quarter more; line breaks, comment marks
and other punctuation are no words, so a template is found however it is wrapped. A block meets a template if it holds
at least ``threshold`` of the template's distinct words. Tokens are ordered by their frequency over all documents,
rarest first, and templates are a table, so more of them mean more rows and not a longer plan:

* prefix filter: of a template with n words that needs a of them, a match holds one of the n - a + 1 rarest; these are
  the index that the words of all documents are joined with;
* positional filter: around a place of the k-th rarest word, as far as a block reaches, there must be a words of the
  template at that rank or after it, or one of the rarer ones would have been met elsewhere;
* length filter: a block within the document has at least a words.

What is left is compared block by block. Phrases that stand word by word are found through the same index (``base``).

Rows: null texts are empty: no words, no labels, score 0. Rows are told apart by id and text, and repeated rows have
equal results. An empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.llm.common import LOWER, UPPER, materialize, settled, text_or_empty

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _listed_class(*ranges: tuple[int, int]) -> str:
    """Runs of characters outside the ranges, each of which is listed: Java looks single ones up in a table, but tries ranges one
    after another, at ten times the cost."""
    return "[^" + "".join(f"\\x{c:02X}" for low, high in ranges for c in range(low, high + 1)) + "]+"


#: ``WORD``, as Spark reads it.
LOW_WORD = _listed_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: The same words before capitals are lowered.
ANY_WORD = _listed_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

#: Phrases whose consecutive words are a label.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: (label, template)
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("all-rights-reserved", "all rights reserved"),
)
THRESHOLD = 0.8
#: Words of a block beyond those of the template, as a share of them.
SLACK = 0.25
#: Rows of the index up to which it is broadcast: short words and a few numbers each.
BROADCAST_ROWS = 200_000


def needed(n_distinct: int, threshold: float = THRESHOLD) -> int:
    """Distinct words of a template that a block must hold."""
    return math.ceil(threshold * n_distinct - 1e-9)


def block_length(n_words: int) -> int:
    return n_words + math.floor(SLACK * n_words)


def plain_words(text: Column) -> Column:
    """Words of a text with A-Z lowered, exact where a word is ASCII; other letters may be lowered too. Of all letters
    beyond ASCII only the Kelvin sign has a lower form in ASCII, so it is replaced by another letter first."""
    return F.regexp_extract_all(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\u0138"))), F.lit(LOW_WORD), F.lit(0))


def _patterns(spark, templates: tuple[tuple[str, str], ...], phrases: dict[str, str]) -> DataFrame:
    """One row a template or phrase: ``pattern`` (number), ``label``, ``phrase`` (whether it is one) and ``words``."""
    rows = [(k, label, False, t) for k, (label, t) in enumerate(templates)] + [(len(templates) + k, label, True, p) for k, (p, label) in enumerate(phrases.items())]
    made = spark.createDataFrame(rows, "pattern int, label string, phrase boolean, text string")
    return made.select("pattern", "label", "phrase", plain_words(F.col("text")).alias("words")).filter(F.size("words") > 0)


def _index(patterns: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Rows (``word``, ``pattern``, ``label``, ``phrase``, ``words``, ``tokens``, ``rank``, ``need``, ``length``) of the
    prefix of every template, of a phrase its rarest word. ``tokens``: its distinct words, rarest first over all texts
    (ties by word); ``rank``: place of the word among them, from 0."""
    vocabulary = patterns.select(F.explode("words").alias("word")).distinct()
    vocabulary = F.broadcast(vocabulary) if vocabulary.count() <= BROADCAST_ROWS else vocabulary
    counted = texts.select(F.explode(plain_words(F.col("_text"))).alias("word")).join(vocabulary, "word").groupBy("word").count()
    distinct = patterns.select("pattern", F.explode(F.array_distinct("words")).alias("word")).join(counted, "word", "left")
    order = F.array_sort(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "word")))
    sets = patterns.join(distinct.groupBy("pattern").agg(F.transform(order, lambda x: x["word"]).alias("tokens")), "pattern")
    n = F.size("words")
    need = F.when(F.col("phrase"), F.size("tokens")).otherwise(F.ceil(threshold * F.size("tokens") - 1e-9)).cast("int")
    length = F.when(F.col("phrase"), n).otherwise(n + F.floor(SLACK * n).cast("int"))
    shaped = sets.withColumn("need", need).withColumn("length", length)
    prefix = F.slice("tokens", F.lit(1), F.size("tokens") - F.col("need") + 1)
    rows = shaped.select("*", F.posexplode(prefix).alias("rank", "word"))
    return materialize(rows, "license-index")


def _hits(worded: DataFrame, index: DataFrame) -> DataFrame:
    """Places ``at`` of words of the index, with the words of the text from ``begin`` on as far as a block over this
    place can reach (``window``), that pass the length filter and the positional filter."""
    met = worded.select("_id", "_t", "doc_words", F.posexplode("doc_words").alias("at", "word")).join(index, "word").filter(F.size("doc_words") >= F.col("need"))
    met = met.withColumn("begin", F.greatest(F.lit(0), F.col("at") - F.col("length") + 1))
    met = met.withColumn("window", F.slice("doc_words", F.col("begin") + 1, F.col("at") - F.col("begin") + F.col("length")))
    # Words of lower rank are not counted: a block that holds one is found from there.
    room = F.expr("size(array_intersect(window, slice(tokens, rank + 1, size(tokens))))")
    return met.filter(room >= F.col("need")).drop("doc_words")


def _blocks(hits: DataFrame) -> DataFrame:
    """The blocks that meet a template: ``first`` (word at which one begins, a word of the template), ``containment``.

    Of the blocks over a place those whose rarest word it has: another block is found from its own rarest word.
    """
    near = hits.withColumn("near", F.expr("transform(window, w -> array_position(tokens, w))"))
    starts = F.expr("filter(sequence(0, at - begin), k -> near[k] > 0)")
    block = lambda k: F.filter(F.array_distinct(F.slice("near", k + 1, F.col("length"))), lambda r: r > 0)
    each = F.transform(starts, lambda k: F.struct((F.col("begin") + k).cast("long").alias("first"), F.size(block(k)).alias("have"), F.array_min(block(k)).alias("least")))
    met = F.filter(each, lambda x: (x["have"] >= F.col("need")) & (x["least"] == F.col("rank") + 1))
    return near.select("_id", "_t", "pattern", "label", "tokens", F.inline(met)).select("_id", "_t", "pattern", "label", "first", (F.col("have") / F.size("tokens")).alias("containment"))


def _places(hits: DataFrame) -> DataFrame:
    """The places of phrases, shaped as blocks without a pattern: the rarest word stands where the phrase has it."""
    here = F.expr("filter(sequence(0, size(words) - 1), k -> words[k] = word AND at >= k AND slice(window, at - begin - k + 1, size(words)) = words)")
    met = hits.select("_id", "_t", "label", "at", F.explode(here).alias("k"))
    return met.select("_id", "_t", F.lit(None).cast("int").alias("pattern"), "label", (F.col("at") - F.col("k")).cast("long").alias("first"), F.lit(1.0).alias("containment"))


@settled
def scan(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, phrases: dict[str, str] | None = None, threshold: float = THRESHOLD,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per row: id, ``n_words``, ``n_base`` (places of all phrases), ``first_word``, ``last_word`` (least and greatest
    start of a phrase, else null), ``base_labels``, ``labels`` (with those of the join), ``score`` (greatest
    containment that met the threshold, 1 for a phrase, else 0) and ``blocks``: an array of (template, first word,
    containment) of every block that meets a template. Templates are words of ASCII in lower case."""
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_t"), text_or_empty(F.col(text_col)).alias("_text"))
    patterns = _patterns(docs.sparkSession, templates, PHRASES if phrases is None else phrases)
    index = _index(patterns, texts, threshold)
    index = F.broadcast(index) if index.count() <= BROADCAST_ROWS else index

    worded = texts.select("_id", "_t", plain_words(F.col("_text")).alias("doc_words"))
    hits = materialize(_hits(worded, index), "license-hits")
    found = materialize(_blocks(hits.filter("not phrase")).unionByName(_places(hits.filter("phrase"))).distinct(), "license-blocks")

    base = F.col("pattern").isNull()
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per_text = found.groupBy("_id", "_t").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("containment").alias("score"),
        F.array_sort(F.collect_list(F.when(~base, F.struct(F.col("pattern").alias("template"), F.col("first").alias("first"), F.col("containment").alias("containment"))))).alias("blocks"),
    )
    rows = texts.select("_id", "_t", F.regexp_count("_text", F.lit(ANY_WORD)).cast("long").alias("n_words"))
    all_ = rows.join(per_text.withColumnRenamed("_id", "_of").withColumnRenamed("_t", "_of_t"), F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_t") == F.col("_of_t")), "left")
    none = F.array().cast("array<struct<template:int,first:bigint,containment:double>>")
    return all_.select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("blocks", none).alias("blocks"),
    )


def oracle(docs: str = "documents") -> str:
    """The same scan, without ``blocks``, for DuckDB: every block that begins at a word of a template."""
    starts = {}
    for phrase in PHRASES:
        parts = phrase.split()
        starts[phrase] = f"list_filter(range(len(words) - {len(parts) - 1}), lambda i: " + " AND ".join(f"words[i + {k + 1}] = '{p}'" for k, p in enumerate(parts)) + ")"
    rows = ", ".join(f"({k}, '{label}', {sorted(set(t.split()))!r}, {needed(len(set(t.split())))}, {block_length(len(t.split()))})" for k, (label, t) in enumerate(TEMPLATES))
    base = ", ".join(f"CASE WHEN len({starts[p]}) > 0 THEN '{label}' END" for p, label in PHRASES.items())
    return f"""
WITH worded AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words FROM {docs}),
based AS (SELECT doc_id, len(words) AS n_words, list_concat({', '.join(starts.values())}) AS pos, list_filter([{base}], lambda x: x IS NOT NULL) AS base FROM worded),
templates(template, label, tokens, need, length) AS (VALUES {rows}),
places AS (SELECT doc_id, words, unnest(words) AS word, unnest(range(len(words))) AS place FROM worded),
begun AS (SELECT p.doc_id, p.words, p.place, t.* FROM places p JOIN (SELECT template, label, tokens, need, length, unnest(tokens) AS word FROM templates) t ON p.word = t.word),
shares AS (SELECT doc_id, label, len(list_intersect(tokens, words[place + 1:place + length])) AS have, need, len(tokens) AS n FROM begun),
met AS (SELECT doc_id, list(label) AS labels, max(have / n::DOUBLE) AS share FROM shares WHERE have >= need GROUP BY doc_id)
SELECT b.doc_id, n_words, len(pos) AS n_base, list_min(pos) AS first_word, list_max(pos) AS last_word, coalesce(array_to_string(list_sort(list_distinct(base)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, coalesce(m.labels, [])))), ','), '') AS labels, CASE WHEN len(pos) > 0 THEN 1.0::DOUBLE ELSE coalesce(m.share, 0.0::DOUBLE) END AS score
FROM based b LEFT JOIN met m ON b.doc_id = m.doc_id
"""
