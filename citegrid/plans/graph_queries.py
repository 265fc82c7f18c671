"""Node measures and clusters.

``dc`` is the direct-citation network of the line items, one dense component;
``thread`` that of the conversations, many small ones.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from citegrid.functions.nested import first_display_name
from citegrid.operators import community, graph
from citegrid.operators import enrich as E
from citegrid.operators import networks as N
from citegrid.plans.build import edge_tables, node_table
from citegrid.plans.catalogue import query
from citegrid.plans.doi_queries import rounded
from citegrid.plans.network_queries import hybrid_sql, network_ctes
from citegrid.session import Scratch

VIEWS = "works citations thread_works thread_citations"
EDGES = network_ctes() + network_ctes("thread_works", "thread_citations", "t_") + """,
    edges AS (SELECT 'dc' AS network, source, target, weight FROM dc
              UNION ALL SELECT 'thread', source, target, weight FROM t_dc)"""
ARCS = """, arcs AS (SELECT network, source AS src, target AS dst FROM edges
    UNION ALL SELECT network, target, source FROM edges WHERE source <> target),
    nodes AS (SELECT DISTINCT network, src AS id FROM arcs)"""


def _edges(t):
    both = N.stack({
        "dc": N.direct_citation(t.works, t.citations),
        "thread": N.direct_citation(t.thread_works, t.thread_citations),
    })
    return Scratch(t.spark, "edges").save(both, "edges")


@query("nodes_degree", EDGES + """ SELECT network, id, count(*) AS degree FROM (
    SELECT network, source AS id FROM edges UNION ALL SELECT network, target FROM edges) e GROUP BY 1, 2""", VIEWS)
def nodes_degree(t):
    return graph.degree(_edges(t))


def _unrolled_labels(rounds: int) -> str:
    """Smallest label around each vertex, as many rounds as the longest shortest path."""
    parts = [", l0 AS (SELECT network, id, id AS c FROM nodes)"]
    for i in range(1, rounds + 1):
        parts.append(f""", l{i} AS MATERIALIZED (SELECT network, id, min(c) AS c FROM (
            SELECT * FROM l{i - 1} UNION ALL SELECT a.network, a.dst, l.c FROM arcs a
            JOIN l{i - 1} l ON a.network = l.network AND a.src = l.id) x GROUP BY 1, 2)""")
    return "".join(parts)


# Conversations are chains of at most a few turns and the dense network is a few hops wide.
_LABELS = EDGES + ARCS + _unrolled_labels(12)


@query("nodes_components", _LABELS + " SELECT network, id, c AS component FROM l12", VIEWS)
def nodes_components(t):
    return graph.components(_edges(t))


@query("modularity_of_components", _LABELS + """, comp AS (SELECT * FROM l12),
    per AS (SELECT c.network, c.c, sum(e.w) AS tot FROM comp c JOIN (
        SELECT network, source AS id, weight AS w FROM edges UNION ALL SELECT network, target, weight FROM edges) e
      ON c.network = e.network AND c.id = e.id GROUP BY 1, 2)
    SELECT network, count(*) AS n_communities, round(1 - sum(tot * tot) / (sum(tot) * sum(tot)), 6) AS modularity
    FROM per GROUP BY 1""", VIEWS)
def modularity_of_components(t):
    edges = _edges(t)
    return rounded(graph.modularity(edges, graph.components(edges), "component"), "modularity")


def _unrolled_search(depth: int) -> str:
    """Shortest distances up to ``depth`` hops, one table of new pairs per hop."""
    near = """, near AS (SELECT DISTINCT network, src, dst FROM arcs WHERE src <> dst),
        d0 AS (SELECT network, id AS s, id AS v FROM nodes), seen0 AS (SELECT * FROM d0)"""
    parts = [near]
    for i in range(1, depth + 1):
        parts.append(f""", d{i} AS MATERIALIZED (SELECT DISTINCT f.network, f.s, a.dst AS v FROM d{i - 1} f
            JOIN near a ON f.network = a.network AND f.v = a.src
            ANTI JOIN seen{i - 1} p ON f.network = p.network AND f.s = p.s AND a.dst = p.v),
            seen{i} AS MATERIALIZED (SELECT * FROM seen{i - 1} UNION ALL SELECT * FROM d{i})""")
    return "".join(parts)


THIN_VIEWS = "thread_works thread_citations works order_citations"
THIN_EDGES = network_ctes("thread_works", "thread_citations", "t_") + network_ctes(citations="order_citations") + """,
    edges AS (SELECT 'thread' AS network, source, target, weight FROM t_dc
              UNION ALL SELECT 'dc', source, target, weight FROM dc)"""


def _thin_edges(t):
    both = N.stack({
        "thread": N.direct_citation(t.thread_works, t.thread_citations),
        "dc": N.direct_citation(t.works, t.order_citations),
    })
    return Scratch(t.spark, "edges").save(both, "edges")


# The longest shortest path is below ten hops at every scale; later hops add no pair.
@query("nodes_closeness", THIN_EDGES + ARCS + _unrolled_search(10) + ", hops AS (" + " UNION ALL ".join(
    f"SELECT network, s AS id, {i} AS d FROM d{i}" for i in range(1, 11)) + """)
    SELECT n.network, n.id, round(h.c / h.total, 6) AS closeness FROM nodes n LEFT JOIN (
      SELECT network, id, CAST(count(*) AS DOUBLE) AS c, sum(d) AS total FROM hops GROUP BY 1, 2) h
    ON n.network = h.network AND n.id = h.id""", THIN_VIEWS)
def nodes_closeness(t):
    return rounded(graph.closeness(_thin_edges(t)), "closeness")


# The second eigenvalue of the dense network is far enough below the first for these steps.
_STEPS = 64


def _unrolled_power(steps: int) -> str:
    parts = [", x0 AS (SELECT network, id, 1.0::DOUBLE AS x FROM nodes)"]
    for i in range(1, steps + 1):
        parts.append(f""", y{i} AS (SELECT a.network, a.dst AS id, sum(x.x) AS x FROM pull a
            JOIN x{i - 1} x ON a.network = x.network AND a.src = x.id GROUP BY 1, 2),
            x{i} AS MATERIALIZED (SELECT network, id, x / max(x) OVER (PARTITION BY network) AS x FROM y{i})""")
    return "".join(parts)


_DC_EDGES = EDGES.replace("\n              UNION ALL SELECT 'thread', source, target, weight FROM t_dc", "")


@query("nodes_eigen", _DC_EDGES + ARCS + """, pull AS MATERIALIZED (SELECT * FROM arcs
    UNION ALL SELECT network, source, target FROM edges WHERE source = target
    UNION ALL SELECT network, id, id FROM nodes)""" + _unrolled_power(_STEPS)
    + f" SELECT network, id, round(x, 4) AS eigen_centrality FROM x{_STEPS}", VIEWS)
def nodes_eigen(t):
    """To convergence; the check iterates until nothing changes in the digits compared."""
    edges = N.stack({"dc": N.direct_citation(t.works, t.citations)})
    return rounded(graph.eigenvector(Scratch(t.spark, "edges").save(edges, "edges")), "eigen_centrality", digits=4)


def _both_powers(steps: int, squarings: int) -> str:
    """The dense network by steps of power iteration, the conversations by squared matrices per component.

    The matrix of each small component is squared until a single vector is left, so that
    its eigenvalue and its share of the start are right however close the eigenvalues are.
    """
    parts = [_unrolled_labels(12), """, pull AS MATERIALIZED (SELECT * FROM arcs WHERE network = 'dc'
          UNION ALL SELECT network, source, target FROM edges WHERE source = target AND network = 'dc'
          UNION ALL SELECT network, id, id FROM nodes WHERE network = 'dc')""",
        _unrolled_power(steps).replace("FROM nodes)", "FROM nodes WHERE network = 'dc')"), """,
        a AS MATERIALIZED (SELECT l.c, a.src AS i, a.dst AS j, sum(CASE WHEN a.src = a.dst THEN 2.0 ELSE 1.0 END::DOUBLE) AS v
          FROM arcs a JOIN l12 l ON l.network = 'thread' AND a.network = 'thread' AND l.id = a.src GROUP BY 1, 2, 3),
        m0 AS MATERIALIZED (SELECT c, i, j, sum(v) AS v FROM (SELECT * FROM a
          UNION ALL SELECT c, id, id, 1.0::DOUBLE FROM l12 WHERE network = 'thread') s GROUP BY 1, 2, 3)"""]
    for k in range(1, squarings + 1):
        parts.append(f""", m{k} AS MATERIALIZED (SELECT c, i, j, v / max(v) OVER (PARTITION BY c) AS v FROM (
            SELECT x.c, x.i, y.j, sum(x.v * y.v) AS v FROM m{k - 1} x JOIN m{k - 1} y ON x.c = y.c AND x.j = y.i
            GROUP BY 1, 2, 3) s)""")
    return "".join(parts) + f""", z AS MATERIALIZED (SELECT c, i, sum(v) AS x FROM m{squarings} GROUP BY 1, 2),
        pushed AS (SELECT a.c, a.i, sum(a.v * z.x) AS y FROM a JOIN z ON a.c = z.c AND a.j = z.i GROUP BY 1, 2),
        part AS (SELECT z.c, sum(z.x * p.y) / sum(z.x * z.x) AS value, sum(z.x) / sum(z.x * z.x) AS share
          FROM z JOIN pushed p ON z.c = p.c AND z.i = p.i GROUP BY 1),
        kept AS (SELECT z.i, CASE WHEN value >= (SELECT max(value) FROM part) - 1e-8 * (1 + (SELECT max(value) FROM part))
            THEN share * x ELSE 0 END AS x FROM z JOIN part ON z.c = part.c)
        SELECT network, id, round(x, 6) AS eigen_centrality FROM x{steps}
        UNION ALL SELECT 'thread', i, round(x / (SELECT max(x) FROM kept), 6) FROM kept"""


@query("nodes_eigen_networks", EDGES + ARCS + _both_powers(128, 30), VIEWS)
def nodes_eigen_networks(t):
    """Both networks at six digits."""
    return rounded(graph.eigenvector(_edges(t)), "eigen_centrality")


@query("nodes_louvain")
def nodes_louvain(t):
    return community.louvain(_thin_edges(t))


@query("nodes_leiden")
def nodes_leiden(t):
    return community.leiden(_thin_edges(t))


@query("nodes_table")
def nodes_table(t):
    """All measures on all seven networks of the conversations."""
    edges = Scratch(t.spark, "edges").save(edge_tables(t.thread_works, t.thread_citations), "edges")
    return node_table(edges, t.thread_works)


_HYBRID = hybrid_sql("bc", "cc", "dc")


def _labelled_nodes(t):
    base = N.base_networks(t.works, t.order_citations)
    edges = N.hybrid(*base.values()).withColumn("network", F.lit("bc_cc_dc"))
    labels = t.works.select("id", F.col("openalex_id").alias("Label"))
    return graph.degree(edges).join(labels, "id", "left")


_NODES = network_ctes(citations="order_citations") + f""", h AS ({_HYBRID}),
    n AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM h UNION ALL SELECT target FROM h) e GROUP BY 1),
    labelled AS (SELECT 'bc_cc_dc' AS network, n.id, n.degree, w.openalex_id AS "Label"
      FROM n LEFT JOIN works w ON n.id = w.id)"""


@query("nodes_core_flag", _NODES + """ SELECT l.*, CAST(l."Label" IN (SELECT openalex_work_id FROM core_works) AS INT)
    AS core_work FROM labelled l""", "works order_citations core_works")
def nodes_core_flag(t):
    return E.core_flag(_labelled_nodes(t), t.core_works)


@query("nodes_sdg", _NODES + """, goals AS (SELECT concat('https://openalex.org/W', CAST(p_partkey AS VARCHAR)) AS oa_id,
      CASE WHEN p_partkey % 5 <> 0 THEN p_type END AS sdgs FROM part)
    SELECT l.*, g.oa_id, g.sdgs FROM labelled l LEFT JOIN goals g ON l."Label" = g.oa_id""", "works order_citations")
def nodes_sdg(t):
    labels = t.metadata.select(
        F.col("id").alias("oa_id"), first_display_name(F.col("sustainable_development_goals")).alias("sdgs"))
    return E.attach_sdg(_labelled_nodes(t), labels)


def _cluster_invariants(edges, labels, column: str, connected: bool):
    """Per network: vertices, labels, vertices outside their component, split communities, modularity not below."""
    components = graph.components(edges)
    both = labels.join(components, ["network", "id"], "full_outer")
    whole = labels.withColumnRenamed("id", "at")
    named = edges.join(whole.withColumnRenamed("at", "source").withColumnRenamed(column, "cs"), ["network", "source"]).join(
        whole.withColumnRenamed("at", "target").withColumnRenamed(column, "ct"), ["network", "target"])
    inner = named.where("cs = ct").select("network", "source", "target", "weight")
    pieces = labels.join(graph.components(inner).withColumnRenamed("component", "piece"), ["network", "id"], "left").groupBy(
        "network", column).agg(F.countDistinct(F.coalesce("piece", "id")).alias("pieces"))
    split = pieces.groupBy("network").agg(F.count_if(F.col("pieces") > 1).alias("split"))
    outside = both.groupBy("network", column).agg(F.countDistinct("component").alias("components"))
    mixed = outside.groupBy("network").agg(F.count_if(F.col("components") > 1).alias("across_components"))
    quality = graph.modularity(edges, labels, column).select("network", F.col("modularity").alias("q")).join(
        graph.modularity(edges, components, "component").select("network", F.col("modularity").alias("base")), "network")
    counts = both.groupBy("network").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col(column).isNotNull()).alias("labelled"))
    out = counts.join(mixed, "network").join(split, "network").join(quality, "network").withColumn(
        "no_worse", F.col("q") >= F.col("base") - 1e-9)
    return out.select("network", "n_nodes", "labelled", "across_components",
                      *(["split"] if connected else []), "no_worse")


_INVARIANTS = THIN_EDGES + ARCS + """ SELECT network, count(*) AS n_nodes, count(*) AS labelled,
    0 AS across_components, {extra}true AS no_worse FROM nodes GROUP BY network"""


@query("louvain_invariants", _INVARIANTS.replace("{extra}", ""), THIN_VIEWS)
def louvain_invariants(t):
    edges = _thin_edges(t)
    labels = Scratch(t.spark, "labels").save(community.louvain(edges), "labels")
    return _cluster_invariants(edges, labels, "cluster_louvain", False)


@query("leiden_invariants", _INVARIANTS.replace("{extra}", "0 AS split, "), THIN_VIEWS)
def leiden_invariants(t):
    edges = _thin_edges(t)
    labels = Scratch(t.spark, "labels").save(community.leiden(edges), "labels")
    return _cluster_invariants(edges, labels, "cluster_leiden", True)

