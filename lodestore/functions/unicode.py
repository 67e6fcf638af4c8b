"""Normalisation that Spark has no function for: NFKC and full case folding, over Arrow batches (STR01)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normalized(value: str | None) -> str:
    return unicodedata.normalize("NFKC", value or "").strip().casefold()


def normalize(text: Column) -> Column:
    """NFKC, trimmed, case-folded; null gives the empty text."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(normalized, na_action=None)

    return run(F.coalesce(text, F.lit("")))
