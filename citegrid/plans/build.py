"""From works and citations to all networks and their node tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrid.operators import community, graph
from citegrid.operators import networks as N
from citegrid.plans.stages import Stages, fingerprint
from citegrid.session import Scratch
from citegrid.sources import readers, writers


#: Stores the table that a function makes under a name, or finds it stored already.
Keep = Callable[[str, Callable[[], DataFrame]], DataFrame]


def edge_tables(works: DataFrame, citations: DataFrame, multiset: bool = False,
                scratch: Scratch | None = None, keep: Keep | None = None) -> DataFrame:
    """All seven networks in one edge table.

    The base networks are written once; one aggregation of their pairs, written too, gives
    all hybrids, so no pair is generated or shuffled again for each of them.
    """
    works, citations = N.typed_ids(works, citations)
    scratch = scratch or Scratch(works.sparkSession, "networks")
    keep = keep or (lambda name, make: scratch.save(make(), name))
    make = {
        "bc": lambda: N.coupling(works, citations, multiset),
        "dc": lambda: N.direct_citation(works, citations),
        "cc": lambda: N.cocitation(works, citations, multiset),
    }
    base = {name: keep(name, one) for name, one in make.items()}
    wide = N.hybrid_networks(base, lambda pairs: keep("wide", lambda: pairs))
    return N.stack({**base, **wide})


def node_table(edges: DataFrame, works: DataFrame, closeness_max_nodes: int | None = None,
               seed: int = 42, scratch: Scratch | None = None, keep: Keep | None = None) -> DataFrame:
    """All node measures per network, with the work's link as ``Label``."""
    scratch = scratch or Scratch(edges.sparkSession, "nodes")
    keep = keep or (lambda name, make: scratch.save(make(), name))
    measures = {
        "component": lambda: graph.components(edges, scratch),
        "louvain": lambda: community.louvain(edges, seed, scratch=scratch),
        "leiden": lambda: community.leiden(edges, seed, scratch=scratch),
        "degree": lambda: graph.degree(edges),
        "closeness": lambda: graph.closeness(edges, closeness_max_nodes, scratch=scratch),
        "eigen": lambda: graph.eigenvector(edges, scratch=scratch),
    }
    nodes = graph.vertices(edges)
    for name, measure in measures.items():
        # Each measure is stored before the next one reuses the scratch names.
        nodes = nodes.join(keep(f"measure-{name}", measure), ["network", "id"], "left")
    labels = works.groupBy("id").agg(F.min("openalex_id").alias("Label"))
    return nodes.join(labels, "id", "left").select(
        "network", "id", "component", "cluster_louvain", "cluster_leiden", "degree",
        "closeness", "eigen_centrality", "Label")


def run(spark: SparkSession, works_path: str, citations_path: str, out: str,
        closeness_max_nodes: int | None = None, seed: int = 42, multiset: bool = False, resume: bool = False) -> None:
    """Read both tables, write ``<out>/edges`` and ``<out>/nodes`` partitioned by network.

    The base networks, their pairs and each measure are kept under ``<out>/_stages`` until
    the run ends well. With ``resume`` a run goes on behind those that an earlier one with
    the same inputs and parameters has finished; without, it starts anew.
    """
    stages = Stages(
        spark, f"{out}/_stages", works=fingerprint(spark, works_path), citations=fingerprint(spark, citations_path),
        closeness_max_nodes=closeness_max_nodes, seed=seed, multiset=multiset)
    if not resume:
        stages.clear()
    works = readers.read_works(spark, works_path)
    citations = readers.read_citations(spark, citations_path)
    scratch = Scratch(spark, "build")
    try:
        writers.write_by_network(edge_tables(works, citations, multiset, scratch, stages.table), f"{out}/edges")
        edges = spark.read.parquet(f"{out}/edges")
        writers.write_by_network(
            node_table(edges, works, closeness_max_nodes, seed, scratch, stages.table), f"{out}/nodes")
        stages.clear()
    finally:
        scratch.clear()
