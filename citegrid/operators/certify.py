"""Certificates of node tables: what must hold if the measures are right, checked by one pass each.

Every check joins the stored table to the edges and counts what breaks it; none repeats
the computation that it checks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.operators.graph import both_ways

TOLERANCE = 1e-6


def _ends(edges: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    """Arcs ``(network, src, dst)`` without loops, each once, with the columns at both ends."""
    out = both_ways(edges.where(F.col("source") != F.col("target"))).distinct()
    for end, suffix in (("src", "a"), ("dst", "b")):
        side = nodes.select("network", F.col("id").alias(end), *[F.col(c).alias(f"{c}_{suffix}") for c in columns])
        out = out.join(side, ["network", end])
    return out


def component_breaks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Labels that change along an edge, or are not the smallest member of what they name."""
    along = _ends(edges, nodes, "component").where("component_a <> component_b").groupBy("network").agg(
        F.count(F.lit(1)).alias("n"))
    named = nodes.groupBy("network", "component").agg(F.min("id").alias("least")).where(
        ~F.col("least").eqNullSafe(F.col("component"))).groupBy("network").agg(F.count(F.lit(1)).alias("n"))
    return along.unionByName(named).groupBy("network").agg(F.sum("n").alias("component_off"))


def cluster_breaks(nodes: DataFrame, column: str) -> DataFrame:
    """Clusters that reach over several components, or are not named by their smallest member."""
    per = nodes.groupBy("network", column).agg(F.min("id").alias("least"), F.countDistinct("component").alias("parts"))
    return per.where((F.col("parts") > 1) | ~F.col("least").eqNullSafe(F.col(column))).groupBy("network").agg(
        F.count(F.lit(1)).alias(f"{column}_off"))


def eigen_breaks(edges: DataFrame, nodes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Vertices where ``A x`` is not ``l x``, loops counted twice and repeated edges each.

    ``l`` is the Rayleigh quotient of the network's vector.
    """
    twice = F.when(F.col("src") == F.col("dst"), F.lit(2.0)).otherwise(F.lit(1.0))
    x = nodes.select("network", "id", F.col("eigen_centrality").alias("x"))
    pushed = (both_ways(edges).withColumn("n", twice).join(x.withColumnRenamed("id", "dst"), ["network", "dst"])
              .groupBy("network", F.col("src").alias("id")).agg(F.sum(F.col("n") * F.col("x")).alias("y")))
    both = x.join(pushed, ["network", "id"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    value = both.groupBy("network").agg(
        F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum(F.col("x") * F.col("x"))).alias("l"), F.max("x").alias("top"))
    off = F.coalesce(F.abs(F.col("y") - F.col("l") * F.col("x")) > tolerance * F.greatest(F.col("l"), F.lit(1.0)), F.lit(True))
    return both.join(F.broadcast(value), "network").groupBy("network").agg(
        (F.count_if(off) + F.max((F.abs(F.col("top") - 1.0) > tolerance).cast("int"))).alias("eigen_off"))


def closeness_breaks(edges: DataFrame, nodes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Vertices whose sum of hops cannot be: no integer, too small, or too far from a neighbour's.

    With n vertices in the component and d neighbours the sum is at least 2 (n - 1) - d, and
    the sums of neighbours differ by n - 2 at most. Only a vertex alone has none.
    """
    sizes = nodes.groupBy("network", "component").agg(F.count(F.lit(1)).alias("n"))
    near = both_ways(edges.where(F.col("source") != F.col("target"))).distinct().groupBy(
        "network", F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    sums = (nodes.select("network", "id", "component", "closeness").join(sizes, ["network", "component"])
            .join(near, ["network", "id"], "left").withColumn("hops", (F.col("n") - 1) / F.col("closeness")))
    whole = F.abs(F.col("hops") - F.round("hops")) <= tolerance * F.col("hops")
    right = F.when(F.col("n") == 1, F.col("closeness").isNull()).otherwise(
        F.coalesce(whole & (F.round("hops") >= 2 * (F.col("n") - 1) - F.col("d")), F.lit(False)))
    single = sums.where(~right).groupBy("network").agg(F.count(F.lit(1)).alias("bad"))
    across = _ends(edges, sums, "hops", "n").where(
        F.abs(F.round("hops_a") - F.round("hops_b")) > F.col("n_a") - 2).groupBy("network").agg(F.count(F.lit(1)).alias("bad"))
    return single.unionByName(across).groupBy("network").agg(F.sum("bad").alias("closeness_off"))


def certify(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per network how often each certificate of a node table is broken; all zero if it is right."""
    out = nodes.select("network").distinct()
    checks = (component_breaks(edges, nodes), cluster_breaks(nodes, "cluster_louvain"), cluster_breaks(nodes, "cluster_leiden"),
              eigen_breaks(edges, nodes), closeness_breaks(edges, nodes))
    for check in checks:
        out = out.join(F.broadcast(check), "network", "left")  # one row per network
    return out.na.fill(0)
