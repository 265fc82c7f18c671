"""Queries over citation networks."""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrid.operators import networks as N
from citegrid.operators import verify as V
from citegrid.operators.certify import certify
from citegrid.plans import build
from citegrid.plans.build import edge_tables
from citegrid.plans.catalogue import query
from citegrid.session import Scratch
from citegrid.sources import readers, writers

# The checks count pairs with a plain self-join over distinct citations.
BC_SQL = """SELECT a.citing_id AS source, b.citing_id AS target, count(*) AS weight
    FROM uniq a JOIN uniq b ON a.cited_id = b.cited_id AND a.citing_id < b.citing_id
    WHERE a.citing_id IN (SELECT id FROM {w}) AND b.citing_id IN (SELECT id FROM {w}) GROUP BY 1, 2"""
CC_SQL = """SELECT a.cited_id AS source, b.cited_id AS target, count(*) AS weight
    FROM uniq a JOIN uniq b ON a.citing_id = b.citing_id AND a.cited_id < b.cited_id
    WHERE a.cited_id IN (SELECT id FROM {w}) AND b.cited_id IN (SELECT id FROM {w}) GROUP BY 1, 2"""
DC_SQL = """SELECT citing_id AS source, cited_id AS target, 1 AS weight FROM uniq
    WHERE citing_id IN (SELECT id FROM {w}) AND cited_id IN (SELECT id FROM {w})"""


def network_ctes(works: str = "works", citations: str = "citations", prefix: str = "") -> str:
    """``uniq, bc, dc, cc`` as further common table expressions."""
    def sub(sql: str) -> str:
        return sql.format(w=works).replace("uniq", f"{prefix}uniq")
    return (f", {prefix}uniq AS (SELECT DISTINCT citing_id, cited_id FROM {citations}), "
            f"{prefix}bc AS ({sub(BC_SQL)}), {prefix}dc AS ({sub(DC_SQL)}), {prefix}cc AS ({sub(CC_SQL)})")


LINES = network_ctes()
NETS = network_ctes(citations="order_citations")


def hybrid_sql(*parts: str, prefix: str = "") -> str:
    union = " UNION ALL ".join(f"SELECT source, target, weight FROM {prefix}{p}" for p in parts)
    return (f"SELECT least(source, target) AS source, greatest(source, target) AS target, "
            f"CAST(sum(weight) AS BIGINT) AS weight FROM ({union}) u GROUP BY 1, 2")


@query("bc_edges", LINES + " SELECT *, 'undirected' AS type FROM bc", "works citations")
def bc_edges(t):
    return N.coupling(t.works, t.citations)


@query("cc_edges", LINES + " SELECT *, 'undirected' AS type FROM cc", "works citations")
def cc_edges(t):
    return N.cocitation(t.works, t.citations)


@query("dc_edges", LINES + " SELECT source, target, CAST(weight AS BIGINT) AS weight, 'directed' AS type FROM dc",
       "works citations")
def dc_edges(t):
    return N.direct_citation(t.works, t.citations)


@query("bc_edges_multiset", """SELECT a.citing_id AS source, b.citing_id AS target, count(*) AS weight,
    'undirected' AS type FROM order_citations a JOIN order_citations b
    ON a.cited_id = b.cited_id AND a.citing_id < b.citing_id GROUP BY 1, 2""", "works order_citations")
def bc_edges_multiset(t):
    return N.coupling(t.works, t.order_citations, multiset=True)


@query("cc_edges_multiset", """SELECT a.cited_id AS source, b.cited_id AS target, count(*) AS weight,
    'undirected' AS type FROM order_citations a JOIN order_citations b
    ON a.citing_id = b.citing_id AND a.cited_id < b.cited_id GROUP BY 1, 2""", "works order_citations")
def cc_edges_multiset(t):
    return N.cocitation(t.works, t.order_citations, multiset=True)


@query("bc_core_only", network_ctes("core_ids", "order_citations") + " SELECT *, 'undirected' AS type FROM bc", "core_ids order_citations")
def bc_core_only(t):
    return N.coupling(t.core_ids, t.order_citations)


@query("cc_core_only", network_ctes("core_ids", "order_citations") + " SELECT *, 'undirected' AS type FROM cc", "core_ids order_citations")
def cc_core_only(t):
    return N.cocitation(t.core_ids, t.order_citations)


@query("dc_core_only", network_ctes("core_ids", "order_citations")
       + " SELECT source, target, CAST(weight AS BIGINT) AS weight, 'directed' AS type FROM dc", "core_ids order_citations")
def dc_core_only(t):
    return N.direct_citation(t.core_ids, t.order_citations)


def _register_hybrid(name: str, parts: tuple[str, ...]) -> None:
    @query(f"hybrid_{name}", f"{NETS} {hybrid_sql(*parts)}", "works order_citations")
    def hybrid(t):
        base = N.base_networks(t.works, t.order_citations)
        return N.hybrid(*[base[p] for p in parts])


for _name, _parts in N.HYBRIDS.items():
    _register_hybrid(_name, _parts)


_HYBRID_CTES = "".join(f", {n} AS ({hybrid_sql(*p)})" for n, p in N.HYBRIDS.items())


@query("network_summary", f"{NETS}{_HYBRID_CTES} " + " UNION ALL ".join(
    f"SELECT '{n}' AS network, count(*) AS n_edges, CAST(sum(weight) AS BIGINT) AS weight_sum FROM {n}"
    for n in N.NETWORKS), "works order_citations")
def network_summary(t):
    return N.summary(edge_tables(t.works, t.order_citations))


@query("network_diff", NETS + """, raw AS (
    SELECT a.citing_id AS source, b.citing_id AS target, count(*) AS weight FROM order_citations a JOIN order_citations b
    ON a.cited_id = b.cited_id AND a.citing_id < b.citing_id GROUP BY 1, 2)
    SELECT count(l.weight) AS left_edges, CAST(sum(l.weight) AS BIGINT) AS left_weight,
      count(r.weight) AS right_edges, CAST(sum(r.weight) AS BIGINT) AS right_weight,
      count(*) FILTER (r.weight IS NULL) AS left_only, count(*) FILTER (l.weight IS NULL) AS right_only,
      count(*) FILTER (l.weight <> r.weight) AS weight_diff, 'MISMATCH' AS verdict
    FROM bc l FULL JOIN raw r ON l.source = r.source AND l.target = r.target""", "works order_citations")
def network_diff(t):
    """Set against multiset coupling: the difference the repeated citations make."""
    return V.compare(N.coupling(t.works, t.order_citations), N.coupling(t.works, t.order_citations, multiset=True))


@query("network_edge_diff", NETS + """ SELECT coalesce(l.source, r.source) AS source,
      coalesce(l.target, r.target) AS target, l.weight AS weight_left, r.weight AS weight_right,
      CASE WHEN r.weight IS NULL THEN 'left_only' WHEN l.weight IS NULL THEN 'right_only' ELSE 'both' END AS side
    FROM bc l FULL JOIN cc r ON l.source = r.source AND l.target = r.target""", "works order_citations")
def network_edge_diff(t):
    base = N.base_networks(t.works, t.order_citations)
    return V.edge_diff(base["bc"], base["cc"])


@query("network_strength", NETS + """, ends AS (
    SELECT source AS id, weight FROM bc UNION ALL SELECT target AS id, weight FROM bc)
    SELECT id, CAST(sum(weight) AS BIGINT) AS strength, CAST(sum(weight) AS BIGINT) AS expected,
    true AS matches FROM ends GROUP BY 1""", "works order_citations")
def network_strength(t):
    """Strength per work from the edges and from the citation counts alone."""
    works, citations = t.works, t.order_citations
    have = V.strength(N.coupling(works, citations))
    want = V.expected_strength(works, citations, "citing_id", "cited_id").withColumnRenamed("strength", "expected")
    return have.join(want, "id", "full_outer").withColumn("matches", F.col("strength").eqNullSafe(F.col("expected")))


@query("core_neighbourhood", """SELECT id, max(a) AS cites_core, max(b) AS cited_by_core FROM (
    SELECT citing_id AS id, 1 AS a, 0 AS b FROM order_citations WHERE cited_id IN (SELECT id FROM core_ids)
    UNION ALL SELECT cited_id AS id, 0 AS a, 1 AS b FROM order_citations WHERE citing_id IN (SELECT id FROM core_ids)
    ) x GROUP BY id""", "core_ids order_citations")
def core_neighbourhood(t):
    return N.neighbourhood(t.order_citations, t.core_ids)


@query("coauthor_links", """, u AS (SELECT DISTINCT work_id, author_id FROM author_links)
    SELECT a.author_id AS source, b.author_id AS target, count(*) AS weight
    FROM u a JOIN u b ON a.work_id = b.work_id AND a.author_id < b.author_id GROUP BY 1, 2""", "author_links")
def coauthor_links(t):
    from citegrid.operators.skew import summed_pairs

    rows = t.author_links.select("work_id", "author_id").distinct()
    return summed_pairs(rows, "work_id", "author_id", F.count(F.lit(1)))


def _verify(name: str, item: str, key: str, edges) -> None:
    cte = name.removeprefix("verify_")

    @query(name, f"""{NETS} SELECT count(*) AS left_edges, CAST(sum(weight) AS BIGINT) AS left_weight,
        count(*) AS right_edges, CAST(sum(weight) AS BIGINT) AS right_weight, 0 AS left_only, 0 AS right_only,
        0 AS weight_diff, 'MATCH' AS verdict FROM {cte}""", "works order_citations")
    def verify(t):
        """Edge by edge against the plain formulation."""
        return V.compare(edges(t.works, t.order_citations), V.plain_pairs(t.works, t.order_citations, item, key))


_verify("verify_bc", "citing_id", "cited_id", N.coupling)
_verify("verify_cc", "cited_id", "citing_id", N.cocitation)


@query("roundtrip_networks", f"""{NETS}, all_edges AS (
    SELECT 'bc' AS network, source, target, weight, 'undirected' AS type FROM bc
    UNION ALL SELECT 'dc', source, target, weight, 'directed' FROM dc
    UNION ALL SELECT 'bc_dc', source, target, weight, NULL FROM ({hybrid_sql("bc", "dc")}) h)
    SELECT network, source, target, CAST(weight AS BIGINT) AS weight, type FROM all_edges""", "works order_citations")
def roundtrip_networks(t):
    """Edge files with their columns in another order, and hybrids without a type, read back by name."""
    base = N.base_networks(t.works, t.order_citations)
    folder = Scratch(t.spark, "network-files").base
    writers.write_csv(base["bc"].select("source", "target", "weight", "type"), f"{folder}/net_bc.csv")
    writers.write_csv(base["dc"].select("type", "target", "weight", "source"), f"{folder}/net_dc.csv")
    writers.write_csv(N.hybrid(base["bc"], base["dc"]).select("weight", "target", "source"), f"{folder}/net_bc_dc.csv")
    return readers.read_networks(t.spark, folder)


@query("network_run", network_ctes("thread_works", "thread_citations") + _HYBRID_CTES + ", edges AS (" + " UNION ALL ".join(
    f"SELECT '{n}' AS network, source, target FROM {n}" for n in N.NETWORKS) + """),
    ends AS (SELECT network, source AS id FROM edges UNION ALL SELECT network, target FROM edges)
    SELECT network, count(*) // 2 AS n_edges, count(DISTINCT id) AS n_nodes, count(*) AS degrees,
      count(DISTINCT id) AS complete, 1.0::DOUBLE AS top_eigen, count(DISTINCT id) AS distinct_ids,
      0 AS component_off, 0 AS cluster_louvain_off, 0 AS cluster_leiden_off, 0 AS eigen_off, 0 AS closeness_off
    FROM ends GROUP BY network""", "thread_works thread_citations")
def network_run(t):
    """The whole run over files, and what it wrote per network.

    Edges, nodes, sum of degrees, rows with every label and a centrality in range, the
    largest centrality, and how often a certificate of the measures is broken.
    """
    folder = Scratch(t.spark, "run").base
    t.thread_works.write.parquet(f"{folder}/works")
    t.thread_citations.write.parquet(f"{folder}/citations")
    build.run(t.spark, f"{folder}/works", f"{folder}/citations", f"{folder}/out")
    written, table = (t.spark.read.parquet(f"{folder}/out/{name}") for name in ("edges", "nodes"))
    edges = written.groupBy("network").agg(F.count(F.lit(1)).alias("n_edges"))
    full = F.col("component").isNotNull() & F.col("cluster_louvain").isNotNull() & F.col("cluster_leiden").isNotNull()
    nodes = table.groupBy("network").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("degree").alias("degrees"),
        F.count_if(full & F.col("Label").isNotNull() & F.col("eigen_centrality").between(0, 1)).alias("complete"),
        F.round(F.max("eigen_centrality"), 9).alias("top_eigen"), F.countDistinct("id").alias("distinct_ids"))
    return edges.join(nodes, "network").join(certify(written, table), "network")
