"""What bounds the work on large graphs: blocks of vertices, batches of sources; and certificates."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citegrid.operators import certify
from citegrid.operators import community as C
from citegrid.operators import graph as G

SCHEMA = "network string, source long, target long, weight long"


def planted(seed, sizes, inner, outer):
    """Groups with dense insides and a few edges between them."""
    draw = random.Random(seed)
    group = [g for g, n in enumerate(sizes) for _ in range(n)]
    first = {g: group.index(g) for g in set(group)}
    rows = set()
    for v, g in enumerate(group):
        for _ in range(inner):
            rows.add((min(v, u := first[g] + draw.randrange(sizes[g])), max(v, u)))
        if draw.random() < outer:
            rows.add((min(v, u := draw.randrange(len(group))), max(v, u)))
    return group, [(a, b) for a, b in sorted(rows) if a != b]


@pytest.fixture(scope="module")
def two(spark):
    """``big``: one community of 80 %; ``even``: four alike."""
    nets = {"big": planted(1, [80] + [5] * 4, 6, 0.1), "even": planted(2, [15] * 4, 5, 0.1)}
    rows = [(n, a, b, 1 + (a + b) % 2) for n, (_, edges) in nets.items() for a, b in edges]
    return nets, G.Scratch(spark, "test").save(spark.createDataFrame(rows, SCHEMA), "edges")


@pytest.mark.parametrize("method, column", [(C.louvain, "cluster_louvain"), (C.leiden, "cluster_leiden")])
def test_several_blocks_find_what_one_finds(two, method, column):
    nets, edges = two
    one, many = (G.Scratch(edges.sparkSession, "test").save(method(edges, block_arcs=n), "labels") for n in (500_000, 250))
    quality = [{r.network: r.modularity for r in G.modularity(edges, x, column).collect()} for x in (one, many)]
    for n, (group, _) in nets.items():
        assert quality[1][n] > 0.95 * quality[0][n] - 0.01
        found = {r.id: r[column] for r in many.where(F.col("network") == n).collect()}
        if n == "even":  # the planted groups come out, but for a few vertices
            share = [max(sum(found[v] == c for v in found if group[v] == g) for c in set(found.values())) / 15 for g in range(4)]
            assert sorted(share)[1] >= 0.8
    assert {r.network: r.split for r in _split(edges, many, column).collect()} == {"big": 0, "even": 0} or column != "cluster_leiden"


def _split(edges, labels, column):
    """Communities that are not connected."""
    ends = edges
    for end in ("source", "target"):
        ends = ends.join(labels.select("network", F.col("id").alias(end), F.col(column).alias(f"c_{end}")), ["network", end])
    pieces = G.components(ends.where("c_source = c_target").select("network", "source", "target"))
    return (labels.join(pieces, ["network", "id"], "left").groupBy("network", column)
            .agg(F.countDistinct(F.coalesce("component", "id")).alias("n")).groupBy("network").agg(F.count_if(F.col("n") > 1).alias("split")))


def test_a_network_of_one_block_rests_after_a_round(two):
    _, edges = two
    assert C.louvain(edges, max_rounds=1).count() == 160


def test_half_a_million_arcs_and_more_are_one_block(spark):
    """A network that a task can hold rests after one round a level; dealt into blocks it took hundreds."""
    ends = [F.pmod(F.xxhash64("id", F.lit(i)), F.lit(20_000)) for i in (1, 2)]
    edges = spark.range(270_000).select(
        F.lit("n").alias("network"), ends[0].alias("source"), ends[1].alias("target"), F.lit(1).cast("bigint").alias("weight"))
    edges = G.Scratch(spark, "test").save(edges, "edges")
    labels = G.Scratch(spark, "test").save(C.louvain(edges, max_rounds=1), "labels")
    assert labels.count() == 20_000 and G.modularity(edges, labels, "cluster_louvain").first().modularity > 0.1


def test_big_community_totals_are_met_in_salts(spark):
    """No salt has more than a few times its share of a community of 80 %."""
    rows = spark.range(10_000).select(F.lit("n").alias("network"), F.col("id").alias("v"), F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(-1).alias("c"))
    totals = rows.groupBy("network", "c").agg(F.count(F.lit(1)).alias("tot"))
    joined = C._salted(rows, totals, ["network", "c"], "v")
    assert joined.count() == 10_000 and joined.where("c = -1").agg(F.min("tot"), F.max("tot")).first()[:] == (8_000, 8_000)
    met = rows.where("c = -1").groupBy(F.pmod(F.xxhash64("v"), F.lit(C.SALTS))).count().agg(F.max("count")).first()[0]
    assert met < 2 * 8_000 / C.SALTS


def rounded(df):
    return sorted((r.network, r.id, None if r.closeness is None else round(r.closeness, 12)) for r in df.collect())


def test_closeness_in_batches_and_from_where_a_run_ended(spark, monkeypatch, tmp_path):
    rows = [("p", i, i + 1, 1) for i in range(0, 5_000, 2)] + [("p", i, i + 2, 1) for i in range(0, 40, 2)] + [("q", 1, 1, 1)]
    edges = G.Scratch(spark, "test").save(spark.createDataFrame(rows, SCHEMA), "edges")
    whole = rounded(G.closeness(edges))
    folder, search, calls = str(tmp_path / "totals"), G._search, []

    def ends_early(*args):
        calls.append(args[3])
        if len(calls) == 3:
            raise RuntimeError("executor lost")
        return search(*args)

    monkeypatch.setattr(G, "_search", ends_early)
    with pytest.raises(RuntimeError, match="lost"):
        G.closeness(edges, state_rows=1, resume=folder)
    assert rounded(G.closeness(edges, state_rows=1, resume=folder)) == whole
    assert calls == [0, 1, 2, 2, 3, 4]  # groups of sources; the first two are not searched again


def test_components_move_vertices_and_not_links(spark, monkeypatch):
    """In a dense network the star rounds get links between trees, and not the network's links."""
    rows = [("d", i, (i * k + k) % 400, 1) for i in range(400) for k in range(1, 40)] + [("e", i, i + 1, 1) for i in range(300)]
    edges = G.Scratch(spark, "test").save(spark.createDataFrame(rows, SCHEMA), "edges")
    sizes, star = [], G._large_star
    monkeypatch.setattr(G, "_large_star", lambda links, *args: sizes.append(links.count()) or star(links, *args))
    got = {(r.network, r.id): r.component for r in G.components(edges).collect()}
    assert got == {("d", i): 0 for i in range(400)} | {("e", i): 0 for i in range(301)}
    assert max(sizes, default=0) <= 701


def test_small_components_are_searched_in_few_batches(spark, monkeypatch):
    """Batches follow the rows that searches hold, not the square of the vertices."""
    edges = G.Scratch(spark, "test").save(spark.range(0, 60_000, 3).selectExpr(
        "'p' AS network", "explode(array(struct(id AS a, id + 1 AS b), struct(id + 1 AS a, id + 2 AS b))) AS e").selectExpr(
        "network", "e.a AS source", "e.b AS target", "1L AS weight"), "edges")
    calls, search = [], G._search
    monkeypatch.setattr(G, "_search", lambda *args: calls.append(args[3:5]) or search(*args))
    got = G.closeness(edges, state_rows=100_000)
    assert calls == [(0, 59)]
    assert got.groupBy("closeness").count().orderBy("closeness").collect() == [(2 / 3, 40_000), (1.0, 20_000)]


def test_rounds_of_closeness_leave_no_shuffle_files_behind(spark, monkeypatch):
    """Disk in use does not add up over rounds and batches."""
    rows = [("p", i, i + 1, 1) for i in range(1_200)] + [("p", i, (i * 7) % 1_200, 1) for i in range(1_200)]
    edges = G.Scratch(spark, "test").save(spark.createDataFrame(rows, SCHEMA), "edges")
    rounds, measure, release = [], G.Scratch.measure, G.Scratch.release
    monkeypatch.setattr(G.Scratch, "measure", lambda *a: rounds.append("round") or measure(*a))
    monkeypatch.setattr(G.Scratch, "release", lambda self: rounds.append("release") or release(self))
    assert G.closeness(edges).count() == 1_201
    assert rounds and rounds == ["round", "release"] * (len(rounds) // 2)
    assert G.STATE_ROWS * 300 < 2e9


def test_steps_of_eigenvector_move_blocks_and_not_arcs(spark, monkeypatch):
    """What a step moves follows the vertices and not arcs times partitions; the vectors are those of the dense solver."""
    rng = np.random.default_rng(3)
    rows = [("d", *e, 1) for e in rng.integers(0, 700, (14_000, 2)).tolist()] + [("d", 5, 5, 1), ("d", 8, 9, 1), ("d", 9, 8, 1), ("d", 8, 9, 1)]
    rows += [("d", 2_000 + i, 2_001 + i, 1) for i in range(30)] + [("e", *e, 1) for e in rng.integers(-90, 30, (2_000, 2)).tolist()]
    edges = G.Scratch(spark, "test").save(spark.createDataFrame(rows, SCHEMA), "edges")
    want = {(r.network, r.id): r.eigen_centrality for r in G.eigenvector(edges).collect()}
    moved, multiply = [], G._multiply

    def counted(*args):
        out = multiply(*args)
        if len(moved) < 2:
            moved.append(out.count())
        return out

    monkeypatch.setattr(G, "_multiply", counted)
    got = {(r.network, r.id): r.eigen_centrality for r in G.eigenvector(edges, dense_vertices=50).collect()}
    assert got == pytest.approx(want, abs=1e-7) and got["d", 2_000] == 0
    # 36 blocks of each of the two networks are returned.
    assert max(moved) <= 2 * 36
    monkeypatch.undo()
    parts = {(r.network, r.id): r.eigen_centrality for r in G.eigenvector(edges, dense_vertices=50, hub_arcs=300).collect()}
    assert parts == pytest.approx(want, abs=1e-7)


@pytest.fixture(scope="module")
def table(two):
    _, edges = two
    small = edges.where("source < 90").unionByName(edges.sparkSession.createDataFrame([("loop", 7, 7, 1), ("loop", 8, 9, 1)], SCHEMA))
    nodes = G.vertices(small)
    clusters = G.Scratch(edges.sparkSession, "test").save(C.louvain(small), "clusters")
    for measure in (G.components(small), clusters, clusters.withColumnRenamed("cluster_louvain", "cluster_leiden"),
                    G.closeness(small), G.eigenvector(small)):
        nodes = nodes.join(measure, ["network", "id"], "left")
    return small, G.Scratch(edges.sparkSession, "test").save(nodes, "nodes")


def test_right_tables_break_no_certificate(table):
    edges, nodes = table
    found = certify.certify(edges, nodes).collect()
    assert len(found) == 3 and all(not any(r[1:]) for r in found)


@pytest.mark.parametrize("column, value, broken", [
    ("component", "cast(3 as bigint)", "component_off"),
    ("cluster_louvain", "cast(5 as bigint)", "cluster_louvain_off"),
    ("cluster_leiden", "cast(null as bigint)", "cluster_leiden_off"),
    ("eigen_centrality", "eigen_centrality * 1.01 + 0.001", "eigen_off"),
    ("closeness", "closeness * 0.999", "closeness_off"),
])
def test_wrong_values_break_their_certificate(table, column, value, broken):
    edges, nodes = table
    wrong = nodes.withColumn(column, F.when((F.col("network") == "big") & (F.col("id") == 11), F.expr(value)).otherwise(F.col(column)))
    found = {r.network: r for r in certify.certify(edges, wrong).collect()}
    assert found["big"][broken] > 0 and found["even"][broken] == 0
