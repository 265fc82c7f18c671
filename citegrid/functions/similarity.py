"""Similarity of strings from their longest common subsequence.

ratio = 2 * LCS / (len_a + len_b). Spark has no such function (``levenshtein``
counts a substitution as one step, here it is two), so this is the one place
that leaves the JVM, in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Bit-parallel: one row of the table is an integer with a bit per character of ``a``."""
    places: dict[str, int] = {}
    for i, ch in enumerate(a):
        places[ch] = places.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & places.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    if total == 0 or a == b:
        return 1.0
    return 2.0 * lcs_length(a, b) / total


@F.pandas_udf(DoubleType())
def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([
        None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)
    ], dtype="float64")


def similarity_ratio(a: Column, b: Column) -> Column:
    """Ratio of the strings as they are; null if either is null."""
    return _ratio(a, b)


def title_similarity(a: Column, b: Column) -> Column:
    """Ratio of lower-cased, trimmed titles; 0 if either is null."""
    return F.coalesce(_ratio(F.trim(F.lower(a)), F.trim(F.lower(b))), F.lit(0.0))


def match_flag(similarity: Column, threshold: float = 0.85) -> Column:
    return (similarity >= F.lit(threshold)).cast("int")
