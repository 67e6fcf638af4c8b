"""Words of text that has no blanks between them (STR02, STR03).

A vocabulary is learned from the corpus: stretches of characters that stand together far more often than their parts
would by chance, and that have many neighbours on both sides. A text is then the path of greatest probability through
the lattice of its vocabulary words. Search mode also yields the words inside a longer one, so a query finds either.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.functions.text import IDENTIFIER, WORD_RUN
from lodestore.session import lean_batches

#: Runs of characters that have no blanks between words.
HAN = r"\p{IsHan}+"
BEGIN, END = "\x02", "\x03"


def grams(texts: DataFrame, text: str, longest: int, runs: str = HAN) -> DataFrame:
    """``gram``, ``n``: how often each stretch of 1 to ``longest`` characters stands in the runs of the texts (lower case),
    with marks before and after a run."""
    found = texts.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(f"({runs})"), F.lit(1))).alias("run"))
    marked = found.groupBy("run").agg(F.count("*").alias("n")).select(F.concat(F.lit(BEGIN), "run", F.lit(END)).alias("run"), "n")
    # the window at every place but the second half of a surrogate pair, in one pass over the run
    window = F.regexp_extract_all("run", F.lit(rf"(?s)(?=([^\uDC00-\uDFFF].{{0,{longest - 1}}}))"), F.lit(1))
    windows = marked.select("n", F.explode(window).alias("window")).groupBy("window").agg(F.sum("n").alias("n"))
    stretches = windows.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("window")), lambda k: F.left("window", k))).alias("gram"))
    return stretches.groupBy("gram").agg(F.sum("n").alias("n"))


def _variety(counted: DataFrame, word: Column, name: str) -> DataFrame:
    """Entropy of the neighbours: of grams one character longer, by the rest."""
    n = F.col("n").cast("double")
    return counted.groupBy(word.alias("word")).agg((F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)).alias(name))


def learn(texts: DataFrame, text: str = "text", longest: int = 4, least: int = 5, cohesion: float = 3.0, variety: float = 0.6, most: int = 200_000, runs: str = HAN) -> DataFrame:
    """``word``, ``n`` of at most ``most`` words, the most frequent first.

    Single characters are words. A longer stretch is one if it stands at least ``least`` times, at least e to the
    ``cohesion`` times as often as any two parts of it would side by side by chance, and with neighbours of an entropy
    of at least ``variety`` on either side, where the end of a run is a neighbour too. All by aggregates and joins on the
    stretch; every text counts.
    """
    spark = texts.sparkSession
    counted = grams(texts, text, longest + 1, runs).persist()
    try:
        size = F.length("gram")
        inner = ~F.col("gram").rlike(f"[{BEGIN}{END}]")
        own = counted.filter(inner & (size <= longest))
        total = own.filter(size == 1).agg(F.sum("n")).first()[0] or 0
        parts = own.filter((size > 1) & (F.col("n") >= least)).select(F.col("gram").alias("word"), F.col("n").alias("n_word"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
        cut = parts.select("word", "n_word", F.left("word", F.col("k")).alias("a"), F.substr("word", F.col("k") + 1).alias("b"))
        one = lambda c: own.select(F.col("gram").alias(c), F.col("n").cast("double").alias(f"n_{c}"))
        bound = F.log(F.col("n_word") * F.lit(float(max(total, 1))) / (F.col("n_a") * F.col("n_b")))
        held = cut.join(one("a"), "a").join(one("b"), "b").groupBy("word", "n_word").agg(F.min(bound).alias("bound")).filter(F.col("bound") >= cohesion)
        longer = counted.filter(size > 1)
        after = _variety(longer.filter(~F.startswith("gram", F.lit(BEGIN))), F.left("gram", size - 1), "after")
        before = _variety(longer.filter(~F.endswith("gram", F.lit(END))), F.substr("gram", F.lit(2)), "before")
        words = held.join(after, "word").join(before, "word").filter(F.least("after", "before") >= variety).select("word", F.col("n_word").alias("n"))
        listed = own.filter(size == 1).select(F.col("gram").alias("word"), "n").unionByName(words).orderBy(F.desc("n"), "word").limit(most)
        return spark.createDataFrame(listed.collect(), "word string, n long")
    finally:
        counted.unpersist()


@dataclass(frozen=True)
class Vocabulary:
    """Log probabilities of words; ``stems`` are the beginnings of words that are none themselves (the inner nodes of the
    trie), ``unknown`` is the log probability of a character that is in no word."""

    words: dict[str, float]
    stems: frozenset[str]
    unknown: float

    @staticmethod
    def of(counts: dict[str, int]) -> Vocabulary:
        total = max(sum(counts.values()), 1)
        stems = {w[:k] for w in counts for k in range(1, len(w))} - set(counts)
        return Vocabulary({w: math.log(n / total) for w, n in counts.items() if n > 0}, frozenset(stems), math.log(1 / (total + 1)))

    def cut(self, run: str) -> list[str]:
        """The words of the most probable path; of equal ones the path whose first differing word is longer."""
        n = len(run)
        best: list[tuple[float, int]] = [(0.0, n)] * (n + 1)
        for i in range(n - 1, -1, -1):
            score, end = self.words.get(run[i], self.unknown) + best[i + 1][0], i + 1
            for j in range(i + 2, n + 1):
                found = self.words.get(run[i:j])
                if found is not None and found + best[j][0] >= score:
                    score, end = found + best[j][0], j
                elif found is None and run[i:j] not in self.stems:
                    break
            best[i] = (score, end)
        out, at = [], 0
        while at < n:
            out.append(run[at : best[at][1]])
            at = best[at][1]
        return out

    def search(self, run: str) -> list[str]:
        """As ``cut``, and before each word of three characters and more the shorter words inside it, by length, then place."""
        return self.with_inner(self.cut(run))

    def with_inner(self, cut: list[str]) -> list[str]:
        """The words of ``search`` from those of ``cut``."""
        out = []
        for word in cut:
            for size in range(2, len(word)):
                out += [word[i : i + size] for i in range(len(word) - size + 1) if word[i : i + size] in self.words]
            out.append(word)
        return out


class Segmenter:
    """Columns of words by a vocabulary (``word``, ``n``) of bounded size, as ``learn`` makes it. Its session has lean
    batches from then on."""

    def __init__(self, vocabulary: DataFrame, runs: str = HAN):
        lean_batches(vocabulary.sparkSession)
        self.vocabulary = Vocabulary.of({r["word"]: r["n"] for r in vocabulary.collect()})
        self.runs = runs

    def words(self, run: Column, search: bool = True) -> Column:
        """The words of runs without blanks, given as an array of strings: all in one array."""
        known = self.vocabulary

        @F.pandas_udf("array<string>")
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            method = known.search if search else known.cut
            for series in batches:
                yield series.map(lambda runs: [w for r in runs for w in method(r)])

        return cut(F.coalesce(run, F.array().cast("array<string>")))

    def both(self, text: Column) -> Column:
        """The words of a text that is one run, without search mode and with it, as two arrays in one: cut once."""
        known = self.vocabulary

        @F.pandas_udf("array<array<string>>")
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for series in batches:
                yield series.map(lambda run: [words := known.cut(run or ""), known.with_inner(words)])

        return cut(text)

    def tokens(self, text: Column) -> Column:
        """The tokens of a text (STR02): words of its runs without blanks in search mode, other runs of letters and
        digits, then whole identifiers. Use it in place of ``functions.text.segmented``, for chunks and queries alike."""
        low = F.lower(F.coalesce(text, F.lit("")))
        inside = F.regexp_extract_all(low, F.lit(f"({self.runs})"), F.lit(1))
        others = F.regexp_extract_all(F.regexp_replace(low, self.runs, " "), F.lit(WORD_RUN), F.lit(0))
        return F.concat(self.words(inside), others, F.regexp_extract_all(low, F.lit(IDENTIFIER), F.lit(0)))
