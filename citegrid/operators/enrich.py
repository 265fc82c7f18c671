"""Left joins that attach registry, catalogue and label data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.functions.doi import ends_with_period
from citegrid.session import Scratch

NOT_FOUND = "Resource not found"


def one_per_key(table: DataFrame, key: str) -> DataFrame:
    """One row per key, so that a join cannot multiply rows: of several the first by content.

    Rows are compared as JSON text, because records may hold maps, which have no order.
    """
    rest = F.struct(*[c for c in table.columns if c != key])
    return (
        table.groupBy(key).agg(F.min_by(rest, F.to_json(rest)).alias("_row")).select(key, "_row.*")
        if len(table.columns) > 1 else table.distinct()
    )


def _stored(lookup: DataFrame) -> DataFrame:
    """A lookup as a table of its own.

    Rows joined to an aggregate on the join key cannot be split where one key has many of
    them; against a stored table they can.
    """
    return Scratch(lookup.sparkSession, "lookup").save(lookup, "lookup")


def registration_agency(df: DataFrame, registry: DataFrame, column: str = "doi") -> DataFrame:
    """Agency of each DOI; unknown DOIs are marked, rows without a DOI stay null."""
    agencies = _stored(registry.groupBy(F.col("doi").alias(column)).agg(F.min("agency").alias("agency")))
    found = F.when(F.col(column).isNotNull(), F.coalesce("agency", F.lit(NOT_FOUND)))
    return df.join(agencies, column, "left").withColumn("registration_agency", found).drop("agency")


def registration_status(df: DataFrame, registry: DataFrame, column: str = "doi",
                        found: str = "ok", name: str = "registration_check") -> DataFrame:
    known = _stored(registry.select(F.col("doi").alias(column)).distinct()).withColumn("_status", F.lit(found))
    status = F.when(F.col(column).isNotNull(), F.coalesce("_status", F.lit(NOT_FOUND)))
    return df.join(known, column, "left").withColumn(name, status).drop("_status")


def trailing_period_check(df: DataFrame, registry: DataFrame, column: str = "doi") -> DataFrame:
    """Whether DOIs that end with a period are registered as they stand."""
    return registration_status(df.where(ends_with_period(F.col(column))), registry, column,
                               found="found", name="status")


def unresolved(df: DataFrame) -> DataFrame:
    return df.where(F.col("registration_agency") == NOT_FOUND).select("row_idx", "doi", "registration_agency")


def fill_missing(results: DataFrame, inputs: DataFrame) -> DataFrame:
    """Take a missing DOI from the input row with the same title.

    ``results(orig_title, doi, …)``, ``inputs(title, doi)``. One DOI per title is
    chosen first, so the join cannot multiply rows.
    """
    known = _stored(
        inputs.where(F.col("title").isNotNull() & F.col("doi").isNotNull())
        .groupBy(F.col("title").alias("orig_title")).agg(F.min("doi").alias("_doi")))
    return (
        results.join(known, "orig_title", "left")
        .withColumn("doi", F.coalesce("doi", "_doi")).drop("_doi")
    )


def records_by_id(ids: DataFrame, snapshot: DataFrame, key: str = "id") -> DataFrame:
    """Full record for each id; an id without a record keeps a row of nulls."""
    return ids.join(one_per_key(snapshot, key), key, "left")


def labels_by_id(ids: DataFrame, snapshot: DataFrame, key: str = "id") -> DataFrame:
    """Keywords and development-goal labels only."""
    return records_by_id(ids, snapshot.select(key, "keywords", "sustainable_development_goals"), key)


def core_flag(nodes: DataFrame, core_works: DataFrame) -> DataFrame:
    """1 where the node's label is a core work, else 0."""
    core = _stored(core_works.select(F.col("openalex_work_id").alias("Label")).distinct()).withColumn("_c", F.lit(1))
    return nodes.join(core, "Label", "left").withColumn("core_work", F.coalesce("_c", F.lit(0))).drop("_c")


def attach_sdg(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``labels(oa_id, sdgs)`` on the node label."""
    return nodes.join(one_per_key(labels, "oa_id"), F.col("Label") == F.col("oa_id"), "left")


def listed_in_corpus(listed: DataFrame, corpus: DataFrame) -> DataFrame:
    """Whether each listed title occurs among the corpus titles."""
    have = _stored(corpus.select("title").where(F.col("title").isNotNull()).distinct()).withColumn("_in", F.lit(True))
    return listed.join(have, "title", "left").withColumn("match", F.coalesce("_in", F.lit(False))).drop("_in")


def core_subset(works: DataFrame, core_works: DataFrame) -> DataFrame:
    """Full rows of the core works."""
    return works.join(core_works.select("openalex_work_id").distinct(), "openalex_work_id")
