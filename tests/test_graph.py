"""Node measures against brute force and clusters against their invariants."""

import random
import math
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from citegrid.operators import community as C
from citegrid.operators import graph as G
from citegrid.plans.build import edge_tables, node_table


def ring_of_cliques(k, size, base=0):
    edges = []
    for c in range(k):
        ids = [base + c * size + i for i in range(size)]
        edges += [(a, b, 1) for i, a in enumerate(ids) for b in ids[i + 1:]]
        edges.append((ids[0], base + ((c + 1) % k) * size + 1, 1))
    return edges


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(2)
    sparse = [(rng.randint(0, 79), rng.randint(0, 79), rng.randint(1, 3)) for _ in range(60)]
    sparse += [(200 + i, 201 + i, 1) for i in range(12)] + [(300, 300, 2), (1, 2, 1), (2, 1, 1)]
    nets = {"a": sparse, "b": ring_of_cliques(5, 5, 1000)}
    rows = [(n, *e) for n, es in nets.items() for e in es]
    df = spark.createDataFrame(rows, "network string, source long, target long, weight long")
    path = G.Scratch(spark, "test").save(df, "edges")
    return nets, path


def neighbours(edges):
    near = defaultdict(set)
    for a, b, _ in edges:
        near[a].add(b)
        near[b].add(a)
    return near


def distances(near, s):
    seen, queue = {s: 0}, deque([s])
    while queue:
        u = queue.popleft()
        for v in near[u]:
            if v not in seen:
                seen[v] = seen[u] + 1
                queue.append(v)
    return seen


def by_node(df, column):
    return {(r.network, r.id): r[column] for r in df.collect()}


def test_degree(data):
    nets, edges = data
    want = defaultdict(int)
    for n, es in nets.items():
        for a, b, _ in es:
            want[n, a] += 1
            want[n, b] += 1
    assert by_node(G.degree(edges), "degree") == want


def test_components_and_closeness(data):
    nets, edges = data
    comp, close = {}, {}
    for n, es in nets.items():
        near = neighbours(es)
        for v in near:
            d = distances(near, v)
            comp[n, v] = min(d)
            close[n, v] = (len(d) - 1) / sum(d.values()) if len(d) > 1 else None
    assert by_node(G.components(edges), "component") == comp
    got = by_node(G.closeness(edges), "closeness")
    assert got.keys() == close.keys()
    for k, v in close.items():
        assert got[k] == (pytest.approx(v, abs=1e-12) if v is not None else None)
    capped = by_node(G.closeness(edges, max_nodes=25), "closeness")
    assert all(v is None for (n, _), v in capped.items() if n == "a")
    assert capped["b", 1000] == got["b", 1000]


def test_hubs_in_parts_change_nothing(data):
    _, edges = data
    ring = edges.where("network = 'b'")
    assert by_node(G.closeness(ring, hub_arcs=2), "closeness") == by_node(G.closeness(ring), "closeness")
    whole = by_node(G.eigenvector(ring), "eigen_centrality")
    one = by_node(G.eigenvector(ring, dense_vertices=0, tolerance=1e-9), "eigen_centrality")
    two = by_node(G.eigenvector(ring, dense_vertices=0, tolerance=1e-9, stride=7, hub_arcs=2), "eigen_centrality")
    assert two == pytest.approx(one, abs=1e-6) and one == pytest.approx(whole, abs=1e-6)


def test_closeness_beyond_one_source_group(spark):
    """More sources than one group of bits: a path of 1500 vertices in short pieces."""
    rows = [("p", i, i + 1, 1) for i in range(3000) if i % 2 == 0] + [("p", 0, 3000, 1), ("p", 0, 2999, 1)]
    edges = spark.createDataFrame(rows, "network string, source long, target long, weight long")
    got = by_node(G.closeness(edges), "closeness")
    assert len(got) == 3001 and got["p", 4] == 1.0
    near = neighbours([r[1:] for r in rows])
    for v in (0, 1, 2998, 2999, 3000):
        d = distances(near, v)
        assert got["p", v] == pytest.approx((len(d) - 1) / sum(d.values()))


def test_eigenvector_is_an_eigenvector(data):
    nets, edges = data
    only = edges.where("network = 'b'")
    x = {k[1]: v for k, v in by_node(G.eigenvector(only), "eigen_centrality").items()}
    near = neighbours(nets["b"])
    assert max(x.values()) == pytest.approx(1.0)
    ratios = [sum(x[u] for u in near[v]) / x[v] for v in near]
    assert max(ratios) - min(ratios) < 1e-9


def test_eigenvector_of_paths(spark):
    """Closed form sin(pi i / (n + 1)); a shorter path in the network keeps nothing, an equal one the same."""
    n = 400
    rows = [("p", i, i + 1, 1) for i in range(1, n)] + [("p", 1000 + i, 1001 + i, 1) for i in range(1, n)]
    rows += [("p", 5000, 5001, 1), ("q", 1, 2, 1), ("q", 3, 3, 1)]
    got = by_node(G.eigenvector(spark.createDataFrame(rows, "network string, source long, target long, weight long")),
                  "eigen_centrality")
    top = math.sin(math.pi * (n // 2) / (n + 1))
    for i in range(1, n + 1):
        want = math.sin(math.pi * i / (n + 1)) / top
        assert got["p", i] == pytest.approx(want, abs=1e-6) and got["p", 1000 + i] == pytest.approx(want, abs=1e-6)
    assert got["p", 5000] == 0 and got["q", 1] == 0 and got["q", 3] == 1


def test_eigenvector_limit_is_an_error(spark):
    rows = [("p", i, i + 1, 1) for i in range(60)]
    edges = spark.createDataFrame(rows, "network string, source long, target long, weight long")
    with pytest.raises(RuntimeError, match="converge"):
        G.eigenvector(edges, dense_vertices=10, max_steps=20)


def plain_modularity(edges, label):
    twice = sum(2 * w for _, _, w in edges)
    inside, total = defaultdict(float), defaultdict(float)
    for a, b, w in edges:
        total[label[a]] += w
        total[label[b]] += w
        if label[a] == label[b]:
            inside[label[a]] += 2 * w
    return sum(inside[c] / twice - (t / twice) ** 2 for c, t in total.items())


@pytest.fixture(scope="module")
def clusters(data):
    _, edges = data
    return {"cluster_louvain": C.louvain(edges).collect(), "cluster_leiden": C.leiden(edges).collect()}


@pytest.mark.parametrize("column", ["cluster_louvain", "cluster_leiden"])
def test_clusters(spark, data, clusters, column):
    nets, edges = data
    labels = spark.createDataFrame(clusters[column])
    quality = {r.network: r.modularity for r in G.modularity(edges, labels, column).collect()}
    for n, es in nets.items():
        mine = {r.id: r[column] for r in clusters[column] if r.network == n}
        near = neighbours(es)
        assert mine.keys() == near.keys()                          # each vertex once
        assert quality[n] == pytest.approx(plain_modularity(es, mine))
        assert quality[n] > plain_modularity(es, {v: v for v in near})
        whole = {v: min(distances(near, v)) for v in near}
        assert all(whole[v] == whole[mine[v]] for v in near)        # inside one component
        assert quality[n] >= plain_modularity(es, whole) - 1e-9
    ring = {r.id: r[column] for r in clusters[column] if r.network == "b"}
    assert all(ring[1000 + 5 * c + i] == 1000 + 5 * c for c in range(5) for i in range(5))


def test_leiden_communities_are_connected(data, clusters):
    nets, _ = data
    for n, es in nets.items():
        mine = {r.id: r.cluster_leiden for r in clusters["cluster_leiden"] if r.network == n}
        near = neighbours(es)
        inner = {v: {u for u in near[v] if mine[u] == mine[v]} for v in near}
        for v in near:
            assert {u for u in near if mine[u] == mine[v]} == set(distances(inner, v))


def test_clusters_do_not_depend_on_partitioning(spark, data, clusters):
    _, edges = data
    again = C.louvain(edges.repartition(7, "target")).collect()
    key = lambda rows: sorted((r.network, r.id, r.cluster_louvain) for r in rows)
    assert key(again) == key(clusters["cluster_louvain"])


def test_clusters_of_a_network_alone_and_beside_others(data, clusters):
    _, edges = data
    alone = {r.id: r.cluster_louvain for r in C.louvain(edges.where("network = 'a'")).collect()}
    assert alone == {r.id: r.cluster_louvain for r in clusters["cluster_louvain"] if r.network == "a"}


def test_cluster_limits_are_errors(data):
    _, edges = data
    with pytest.raises(RuntimeError):
        C.louvain(edges, max_rounds=1, block_arcs=8)


def test_node_table(spark):
    works = spark.createDataFrame([(i, f"W{i}") for i in range(8)], "id long, openalex_id string")
    citations = spark.createDataFrame(
        [(1, 0), (2, 0), (2, 1), (3, 2), (3, 1), (6, 5), (7, 5)], "citing_id long, cited_id long")
    edges = edge_tables(works, citations)
    edges = G.Scratch(spark, "test").save(edges, "edges")
    nodes = node_table(edges, works)
    assert nodes.columns == ["network", "id", "component", "cluster_louvain", "cluster_leiden", "degree",
                             "closeness", "eigen_centrality", "Label"]
    got = nodes.where(F.col("network") == "dc").collect()
    assert {r.id for r in got} == {0, 1, 2, 3, 5, 6, 7} and {r.Label for r in got} >= {"W0", "W7"}
    assert nodes.dropna().count() == nodes.count()
