"""Checks of a written network against an independently computed one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.operators.networks import canonical
from citegrid.session import Scratch


def edge_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges of both networks side by side with where each one occurs."""
    a = canonical(left).withColumnRenamed("weight", "weight_left")
    b = canonical(right).withColumnRenamed("weight", "weight_right")
    side = (
        F.when(F.col("weight_right").isNull(), "left_only")
        .when(F.col("weight_left").isNull(), "right_only")
        .otherwise("both")
    )
    return a.join(b, ["source", "target"], "full_outer").withColumn("side", side)


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: edge and weight totals, differences and the verdict."""
    differs = (F.col("side") == "both") & (F.col("weight_left") != F.col("weight_right"))
    counts = edge_diff(left, right).agg(
        F.count("weight_left").alias("left_edges"),
        F.coalesce(F.sum("weight_left"), F.lit(0)).alias("left_weight"),
        F.count("weight_right").alias("right_edges"),
        F.coalesce(F.sum("weight_right"), F.lit(0)).alias("right_weight"),
        F.count_if(F.col("side") == "left_only").alias("left_only"),
        F.count_if(F.col("side") == "right_only").alias("right_only"),
        F.count_if(differs).alias("weight_diff"),
    )
    same = (F.col("left_only") == 0) & (F.col("right_only") == 0) & (F.col("weight_diff") == 0)
    return counts.withColumn("verdict", F.when(same, "MATCH").otherwise("MISMATCH"))


def expected_strength(works: DataFrame, citations: DataFrame, item: str, key: str) -> DataFrame:
    """Sum of edge weights each work must have, without building a single pair.

    In the matrix product the row sum of a work is the number of *other* works
    behind each of its references, so it needs two counts per citation.
    """
    ids = works.select(F.col("id").alias(item))
    rows = citations.select(item, key).join(ids, item, "left_semi").distinct()
    # Stored, so that a key with many rows can be split in the join.
    shares = Scratch(rows.sparkSession, "shares").save(
        rows.groupBy(key).agg((F.count(F.lit(1)) - 1).alias("others")), "shares")
    return (
        rows.join(shares, key).groupBy(F.col(item).alias("id"))
        .agg(F.sum("others").alias("strength")).where("strength > 0")
    )


def plain_pairs(works: DataFrame, citations: DataFrame, item: str, key: str, spread: int = 8) -> DataFrame:
    """Edges of coupling or co-citation by one plain self-join and ``distinct`` at its end.

    A second formulation that shares neither the blocks nor the counting with the first:
    an edge's weight is the number of distinct keys behind its pair. Sources are dealt into
    ``spread`` parts that each meet all targets of a key, so a hub is not one task.
    """
    ids = works.select(F.col("id").alias(item)).distinct()
    rows = citations.select(item, key).join(ids, item)
    part = F.pmod(F.xxhash64("source"), F.lit(spread)).cast("int")
    other = rows.select(F.col(item).alias("target"), key, F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("part"))
    return (
        rows.withColumnRenamed(item, "source").withColumn("part", part).join(other, [key, "part"]).where("source < target")
        .groupBy("source", "target").agg(F.countDistinct(key).alias("weight"))
    )


def strength(edges: DataFrame) -> DataFrame:
    """Sum of edge weights at each work."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("id"), "weight")
    return ends.groupBy("id").agg(F.sum("weight").alias("strength"))
