"""Column expressions for titles: extraction, normalisation and length bounds."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that title queries replace by a space, in two variants.
QUERY_PUNCTUATION = ":;?-.,'"
QUERY_PUNCTUATION_SHORT = ":;?-'"


def extract_title(reference: Column) -> Column:
    """Text between the first ``": "`` and the next ``". "``.

    Without an opening the result is empty; without a close everything but the last
    character is taken.
    """
    opening = F.locate(": ", reference)
    begin = opening + 2
    # locate() takes a fixed start position only, so the close is sought in the tail.
    tail = F.substr(reference, begin)
    close = F.locate(". ", tail)
    return (
        F.when(opening == 0, "")
        .when(close == 0, F.substr(tail, F.lit(1), F.greatest(F.length(tail) - 1, F.lit(0))))
        .otherwise(F.substr(tail, F.lit(1), close - 1))
    )


def normalize(title: Column) -> Column:
    """Lower case without ASCII punctuation."""
    return F.translate(F.lower(title), string.punctuation, "")


def query_text(title: Column, punctuation: str = QUERY_PUNCTUATION) -> Column:
    """Punctuation replaced by spaces, as used for search queries."""
    return F.translate(title, punctuation, " " * len(punctuation))


def has_text(title: Column) -> Column:
    return title.isNotNull() & (F.trim(title) != "")


def tokens(title: Column) -> Column:
    """Sorted distinct words of the normalised title."""
    words = F.split(F.trim(normalize(title)), r"\s+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))


def ratio_bound(a: Column, b: Column) -> Column:
    """Largest similarity ratio two strings of these lengths can reach."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.least(la, lb) / (la + lb))
