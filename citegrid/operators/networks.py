"""Citation networks: coupling, direct citation, co-citation and their hybrids.

Inputs are ``works(id)`` and ``citations(citing_id, cited_id)`` with integer ids;
outputs are ``(source, target, weight[, type])``.

An edge of a coupling or co-citation network *is* a pair of works that share a
reference or a citer, so pairs have to be produced. What can be controlled is
that they never concentrate in one task and that what is shuffled is a list of
targets per source and key instead of a row per pair (``summed_pairs``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.operators.skew import BLOCK_ROWS, summed_pairs

HYBRIDS = {
    "bc_cc_dc": ("bc", "cc", "dc"),
    "bc_cc": ("bc", "cc"),
    "bc_dc": ("bc", "dc"),
    "cc_dc": ("cc", "dc"),
}
NETWORKS = ("bc", "dc", "cc", *HYBRIDS)


def typed_ids(works: DataFrame, citations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Integer ids, so that ``source < target`` is a numeric comparison."""
    return (
        works.withColumn("id", F.col("id").cast("bigint")),
        citations.select(F.col("citing_id").cast("bigint"), F.col("cited_id").cast("bigint")),
    )


def _shared(citations: DataFrame, works: DataFrame, item: str, key: str,
            multiset: bool, block_rows: int) -> DataFrame:
    ids = works.select(F.col("id").alias(item))
    own = citations.select(item, key).where(F.col(item).isNotNull() & F.col(key).isNotNull())
    if not multiset:
        rows = own.join(ids, item, "left_semi").distinct()
        carry, weight = (), F.count(F.lit(1))
    else:
        # Repeated citations multiply, and so do repeated ids of the source work.
        # Both are counted first, so copies never inflate the pair join.
        copies = ids.groupBy(item).agg(F.count(F.lit(1)).alias("w"))
        rows = own.groupBy(item, key).agg(F.count(F.lit(1)).alias("m")).join(copies, item)
        carry, weight = ("m", "w"), F.sum(F.col("m_source") * F.col("m_target") * F.col("w_source"))
    return summed_pairs(rows, key, item, weight, carry, block_rows).withColumn("type", F.lit("undirected"))


def coupling(works: DataFrame, citations: DataFrame, multiset: bool = False,
             block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Works that cite the same reference; weight = number of shared references."""
    return _shared(citations, works, "citing_id", "cited_id", multiset, block_rows)


def cocitation(works: DataFrame, citations: DataFrame, multiset: bool = False,
               block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Works cited together; weight = number of shared citers."""
    return _shared(citations, works, "cited_id", "citing_id", multiset, block_rows)


def direct_citation(works: DataFrame, citations: DataFrame) -> DataFrame:
    """Distinct citations with both ends in ``works``; self-citations stay."""
    ids = works.select("id")
    inside = (
        citations.select(F.col("citing_id").alias("source"), F.col("cited_id").alias("target"))
        .join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
        .join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    )
    return inside.distinct().select(
        "source", "target", F.lit(1).cast("bigint").alias("weight"), F.lit("directed").alias("type")
    )


def canonical(edges: DataFrame) -> DataFrame:
    """Smaller id first; no edge is merged or re-weighted."""
    return edges.select(
        F.least("source", "target").alias("source"),
        F.greatest("source", "target").alias("target"),
        "weight",
    )


def hybrid(*parts: DataFrame) -> DataFrame:
    """Undirected sum of edge tables; reciprocal citations add up, self-loops stay."""
    union = reduce(DataFrame.unionByName, [canonical(p) for p in parts])
    return union.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def base_networks(works: DataFrame, citations: DataFrame, multiset: bool = False) -> dict[str, DataFrame]:
    return {
        "bc": coupling(works, citations, multiset),
        "dc": direct_citation(works, citations),
        "cc": cocitation(works, citations, multiset),
    }


def wide(base: dict[str, DataFrame]) -> DataFrame:
    """One row per unordered pair with its weight in each base network, null where it is not in it."""
    parts = [
        canonical(df).select("source", "target", *[
            F.when(F.lit(n == name), F.col("weight")).cast("bigint").alias(n) for n in base])
        for name, df in base.items()
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("source", "target").agg(*[F.sum(n).alias(n) for n in base])


def hybrid_networks(base: dict[str, DataFrame], store=lambda df: df) -> dict[str, DataFrame]:
    """All hybrids as projections of one aggregation of the pairs, which ``store`` may keep."""
    pairs = store(wide(base))
    out = {}
    for name, parts in HYBRIDS.items():
        here = F.coalesce(*parts).isNotNull()
        weight = reduce(Column.__add__, [F.coalesce(p, F.lit(0)) for p in parts])
        out[name] = pairs.where(here).select("source", "target", weight.alias("weight"))
    return out


def stack(networks: dict[str, DataFrame]) -> DataFrame:
    """One edge table ``(network, source, target, weight, type)`` for all networks."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [df.withColumn("network", F.lit(name)) for name, df in networks.items()],
    ).select("network", "source", "target", "weight", "type")


def summary(edges: DataFrame) -> DataFrame:
    return edges.groupBy("network").agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum("weight").alias("weight_sum")
    )


def neighbourhood(citations: DataFrame, core: DataFrame) -> DataFrame:
    """Works that cite a core work or are cited by one: ``(id, cites_core, cited_by_core)``."""
    ids = core.select("id").distinct()
    citing = citations.join(ids.withColumnRenamed("id", "cited_id"), "cited_id", "left_semi").select(
        F.col("citing_id").alias("id"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    cited = citations.join(ids.withColumnRenamed("id", "citing_id"), "citing_id", "left_semi").select(
        F.col("cited_id").alias("id"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    return citing.unionByName(cited).groupBy("id").agg(
        F.max("a").alias("cites_core"), F.max("b").alias("cited_by_core"))
