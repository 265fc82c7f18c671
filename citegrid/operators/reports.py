"""Descriptive tables: counts by key with optional shares.

Rows without a key are left out, as the shares refer to keyed rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.operators.doi_quality import percent


def count_by(df: DataFrame, key: str, value: str | None = None, name: str = "count") -> DataFrame:
    """Rows per key, or non-null ``value`` per key."""
    counted = F.count(value) if value else F.count(F.lit(1))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(counted.alias(name))


def descending(counts: DataFrame, key: str, name: str = "count") -> DataFrame:
    return counts.orderBy(F.desc(name), F.asc(key))


def with_share(counts: DataFrame, name: str = "count", share: str = "percentage") -> DataFrame:
    """Percentage of the summed counts; the total is one scalar, not a global window."""
    total = counts.agg(F.sum(name)).scalar()
    return counts.withColumn(share, percent(F.col(name), total))


def top(counts: DataFrame, key: str, n: int = 10, name: str = "count") -> DataFrame:
    return descending(counts, key, name).limit(n)


def country_names(counts: DataFrame, iso_codes: DataFrame, key: str) -> DataFrame:
    """Counts with their ISO names; codes without an entry drop out."""
    return counts.join(iso_codes, F.col(key) == F.col("a2_code")).drop("a2_code")


def unknown_institutions(affiliations: DataFrame) -> DataFrame:
    return affiliations.agg(
        F.count_if(F.col("institution_id").isNull()).alias("unknown_institutions"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def open_access(df: DataFrame) -> DataFrame:
    rows, yes = F.count(F.lit(1)), F.count_if(F.col("is_oa"))
    return df.agg(
        yes.alias("oa_true"), F.count_if(~F.col("is_oa")).alias("oa_false"),
        percent(yes, rows).alias("pct_oa"),
    )


def licences(df: DataFrame) -> DataFrame:
    """Rows per licence as a share of all rows; a null licence is its own line."""
    counts = df.groupBy("license").agg(F.count(F.lit(1)).alias("count"))
    return with_share(counts)


def coverage(df: DataFrame, column: str = "doi") -> DataFrame:
    rows, have = F.count(F.lit(1)), F.count(column)
    return df.agg(rows.alias("total"), have.alias("with_value"), percent(have, rows).alias("pct"))


def search_summary(results: DataFrame) -> DataFrame:
    """Titles searched and titles with at least one hit."""
    return results.agg(
        F.count(F.lit(1)).alias("titles"), F.count_if(F.col("count") > 0).alias("matched")
    )


def top_terms(members: DataFrame, group: str, term: str, n: int) -> DataFrame:
    """The ``n`` most frequent terms of each group; ties go to the smaller term."""
    counts = members.where(F.col(term).isNotNull()).groupBy(group, term).agg(F.count(F.lit(1)).alias("count"))
    order = Window.partitionBy(group).orderBy(F.desc("count"), F.asc(term))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def criteria_combinations(df: DataFrame, criteria: dict[str, Column]) -> DataFrame:
    """Present/absent score per row, counted over all observed combinations."""
    flags = [F.coalesce(c, F.lit(False)).cast("int").alias(n) for n, c in criteria.items()]
    return df.select(*flags).groupBy(*criteria).agg(F.count(F.lit(1)).alias("n_rows"))


def fixed_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in hash order: random looking, the same on every run."""
    rank = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return df.orderBy(rank, F.col(key)).limit(n)
