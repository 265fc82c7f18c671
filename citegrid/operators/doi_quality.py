"""Profiling, cleaning and deduplication of DOI lists.

Input is a table with ``row_idx`` (the original row order) and a DOI column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.functions import doi as D
from citegrid.session import Scratch


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(F.lit(100.0) * part, whole)


def profile(df: DataFrame, column: str = "doi") -> DataFrame:
    """One row: totals, fill rate and the distribution of string lengths.

    Values collapse to (length, frequency) first, so quartiles are taken over as many
    rows as there are different lengths.
    """
    n = F.col("n")
    lengths = df.groupBy(F.length(column).alias("len")).agg(F.count(F.lit(1)).alias("n"))
    filled = F.col("len").isNotNull()
    size = F.col("len").cast("double")
    total, count = F.sum(n), F.coalesce(F.sum(F.when(filled, n)), F.lit(0))
    mean = F.try_divide(F.sum(size * n), count)
    stats = lengths.agg(
        total.alias("total"), (total - count).alias("missing"), count.alias("filled"),
        percent(count, total).alias("pct_filled"),
        mean.alias("mean_len"), F.min("len").alias("min_len"), F.max("len").alias("max_len"),
        F.sum(size * size * n).alias("squares"),
        F.percentile(F.col("len"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)),
                     F.when(filled, n).otherwise(F.lit(1))).alias("q"),
    )
    spread = F.col("squares") - F.col("filled") * F.col("mean_len") * F.col("mean_len")
    return stats.select(
        "total", "missing", "filled", "pct_filled", "mean_len",
        F.sqrt(F.try_divide(F.greatest(spread, F.lit(0.0)), F.col("filled") - 1)).alias("std_len"),
        "min_len", F.col("q")[0].alias("q25_len"), F.col("q")[1].alias("q50_len"),
        F.col("q")[2].alias("q75_len"), "max_len",
    )


def resolver_report(df: DataFrame, column: str = "doi") -> DataFrame:
    c = F.col(column)
    rows = F.count(F.lit(1))
    resolver, scheme = F.count_if(D.has_resolver(c)), F.count_if(D.has_scheme(c))
    return df.agg(
        rows.alias("total"), resolver.alias("with_resolver"),
        percent(resolver, rows).alias("pct_resolver"), scheme.alias("with_scheme"),
        percent(scheme, rows).alias("pct_scheme"),
    )


def not_available_report(df: DataFrame, column: str = "doi") -> DataFrame:
    """Count, distinct values, most frequent value and its frequency of NA/NF strings."""
    values = (
        df.where(D.is_not_available(F.col(column))).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    )
    top = F.max_by(F.struct(F.col(column), F.col("n")), F.struct(F.col("n"), F.col(column)))
    return values.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("count"), F.count(F.lit(1)).alias("unique"),
        top.alias("t"),
    ).select("count", "unique", F.col("t")[column].alias("top"), F.col("t.n").alias("freq"))


def error_flags(df: DataFrame, column: str = "doi") -> DataFrame:
    """One 0/1 flag per fault that can be read off the string, in a single projection."""
    c = F.col(column)
    tests = {
        "resolver": D.strip_resolver(c) != c, "two_dois": D.has_two_dois(c),
        "encoded_slash": D.has_encoded_slash(c), "trailing_period": D.ends_with_period(c),
        "outer_slash": D.has_outer_slash(c), "space": D.has_space(c),
        "not_available": D.is_not_available(c), "dotted_structure": D.has_dotted_structure(c),
        "test_prefix": D.has_test_prefix(c), "label": D.has_label(c),
    }
    flags = [F.coalesce(t, F.lit(False)).cast("int").alias(f"is_{n}") for n, t in tests.items()]
    return df.select("*", c.isNull().cast("int").alias("is_missing"), *flags)


def error_report(df: DataFrame, registry: DataFrame | None = None, column: str = "doi") -> DataFrame:
    """Rows per fault class in long form; unregistered and repeated DOIs included."""
    flagged = error_flags(df, column)
    names = [c for c in flagged.columns if c.startswith("is_")]
    sums = flagged.agg(*[F.sum(c).cast("bigint").alias(c[3:]) for c in names])
    classes = [c[3:] for c in names]
    report = sums.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("fault"), F.coalesce(F.col(n), F.lit(0)).alias("n_rows")) for n in classes
    ])).alias("r")).select("r.*")
    per_doi = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    repeated = per_doi.agg(
        F.lit("duplicated").alias("fault"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("n_rows"))
    report = report.unionByName(repeated)
    if registry is not None:
        known = registry.select(F.col("doi").alias(column))
        report = report.unionByName(
            per_doi.join(known, column, "left_anti")
            .agg(F.lit("unregistered").alias("fault"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows")))
    return report


def override(df: DataFrame, corrections: DataFrame, column: str = "doi", order: str | None = None) -> DataFrame:
    """Replace the value of listed rows; a listed null empties the row, unknown rows are ignored.

    Of several corrections of a row the last by ``order`` counts; without an order, or
    among equals, the greatest value, a null only if there is nothing else.
    """
    rank = [order] if order else []
    fixes = corrections.groupBy("row_idx").agg(
        F.max(F.struct(*rank, F.col(column).alias("_fix"))).alias("_last"))
    return (
        df.join(fixes, "row_idx", "left")
        .withColumn(column, F.when(F.col("_last").isNotNull(), F.col("_last._fix")).otherwise(F.col(column)))
        .drop("_last")
    )


def exclude_rows(df: DataFrame, rows: DataFrame) -> DataFrame:
    """Drop rows listed by a manual review."""
    return df.join(rows.select("row_idx"), "row_idx", "left_anti")


def duplicates(df: DataFrame, column: str = "doi") -> DataFrame:
    """All rows whose DOI occurs more than once, with its number of rows."""
    # Stored, so that the join meets two plain tables and a DOI on many rows can be split.
    repeated = Scratch(df.sparkSession, "duplicates").save(
        df.where(F.col(column).isNotNull()).groupBy(column)
        .agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1"), "repeated")
    return df.join(repeated, column)


def keep_first(df: DataFrame, column: str = "doi", keep_nulls: bool = False) -> DataFrame:
    """First row per DOI in row order; rows without one collapse to one unless kept.

    Filtering on the first row number lets the planner drop all but one row per DOI
    in every input partition before the shuffle, so a DOI (or null) shared by a large
    part of the rows does not travel.
    """
    order = Window.partitionBy(column).orderBy("row_idx")
    pool = df.where(F.col(column).isNotNull()) if keep_nulls else df
    first = pool.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")
    return first.unionByName(df.where(F.col(column).isNull())) if keep_nulls else first


def dedup_report(df: DataFrame, column: str = "doi") -> DataFrame:
    """Rows left, DOIs that had duplicates and duplicate rows removed."""
    n = F.col("n")
    shared = F.col(column).isNotNull() & (n > 1)
    per_doi = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return per_doi.agg(
        F.count(F.lit(1)).alias("rows_left"), F.count_if(shared).alias("dois_with_duplicates"),
        F.coalesce(F.sum(F.when(shared, n - 1)), F.lit(0)).alias("rows_removed"),
    )


def blank_not_found(df: DataFrame, column: str = "doi") -> DataFrame:
    return df.withColumn(column, D.null_if_not_found(F.col(column)))


def blank_test_prefixes(df: DataFrame, column: str = "doi", strict: bool = False) -> DataFrame:
    c = F.col(column)
    return df.withColumn(column, F.when(D.has_test_prefix(c, strict), None).otherwise(c))


def clean(df: DataFrame, corrections: DataFrame | None = None, blank_rows: DataFrame | None = None,
          column: str = "doi", strict: bool = False, keep_nulls: bool = False) -> DataFrame:
    """The whole repair sequence; its order matters.

    Labels come off after deduplication, so values that differ only by the label
    are both kept.
    """
    out = df.withColumn(column, D.repair(F.col(column)))
    if corrections is not None:
        out = override(out, corrections, column)
    out = blank_not_found(out, column)
    if blank_rows is not None:
        out = override(out, blank_rows.select("row_idx", F.lit(None).cast("string").alias(column)), column)
    out = blank_test_prefixes(out, column, strict)
    out = keep_first(out, column, keep_nulls)
    return out.withColumn(column, D.strip_label(F.col(column)))
