"""Communities of networks that one task holds: all levels in arrays, one job whatever the number of levels."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citegrid.operators import community as C
from citegrid.operators import graph as G
from citegrid.operators import moves as M

SCHEMA = "network string, source long, target long, weight long"


def drawn(seed, n=600, groups=12, edges=4_000):
    """A network with planted groups, loops, repeated and weighted edges, and chains beside it."""
    draw, rows = random.Random(seed), []
    for _ in range(edges):
        a = draw.randrange(n)
        b = draw.randrange(n) if draw.random() < 0.4 else a % groups + groups * draw.randrange(n // groups)
        rows.append((7 * a, 7 * b, draw.randrange(1, 4)))
    return rows + [(10_000 + i, 10_001 + i, 1) for i in range(0, 300) if i % 6]


def packs(rows):
    pairs = {}
    for a, b, w in rows:
        pairs[min(a, b), max(a, b)] = pairs.get((min(a, b), max(a, b)), 0.0) + w
    a, b = np.array(list(pairs)).T
    batch = pa.RecordBatch.from_arrays(
        [pa.array(["n"] * len(a)), pa.array(a), pa.array(b), pa.array(list(pairs.values()))], names=["network", "a", "b", "w"])
    return pa.Table.from_batches(list(M.packed([batch])))


def modularity(rows, label):
    m2, inside, tot = 2.0 * sum(r[2] for r in rows), 0.0, {}
    for a, b, w in rows:
        inside += 2 * w * (label[a] == label[b])
        for v in (a, b):
            tot[label[v]] = tot.get(label[v], 0.0) + w
    return inside / m2 - sum(t * t for t in tot.values()) / m2 ** 2


def connected(rows, label):
    root = {v: v for v in label}

    def top(v):
        while root[v] != v:
            v = root[v]
        return v
    for a, b, _ in rows:
        if label[a] == label[b]:
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return all(label[v] == top(v) for v in label)


@pytest.mark.parametrize("refine", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_slices_find_what_single_moves_find(monkeypatch, seed, refine):
    rows, found = drawn(seed), []
    for few in (M.FEW_ARCS, 0):
        monkeypatch.setattr(M, "FEW_ARCS", few)
        monkeypatch.setattr(M, "SLICE_ARCS", M.SLICE_ARCS if few else 200)
        out = M.whole_network(42, 100, 1e-6, refine)(packs(rows))
        label = dict(zip(out["id"].to_pylist(), out["label"].to_pylist()))
        assert set(label) == {v for r in rows for v in r[:2]}
        assert all(label[c] == c and c <= v for v, c in label.items())
        assert not refine or connected(rows, label)
        found.append(modularity(rows, label))
    assert found[1] > 0.95 * found[0] > 0.2


def test_slices_leave_no_vertex_that_gains(monkeypatch):
    monkeypatch.setattr(M, "FEW_ARCS", 0)
    monkeypatch.setattr(M, "SLICE_ARCS", 300)
    rows = drawn(3)
    graph = M.read_graph(packs(rows))
    m2 = float(graph.k.sum())
    assert m2 == 2 * sum(r[2] for r in rows)
    before = modularity(rows, {v: v for r in rows for v in r[:2]})
    label, name, quality = M._local(graph, graph.ids, m2, 42)
    assert quality > before and quality == pytest.approx(modularity(rows, dict(zip(graph.ids.tolist(), name[label].tolist()))))
    tot, worst = np.bincount(label, graph.k, len(name)), 0
    for v in range(len(graph.ids)):
        to = {}
        for u, w in zip(graph.to[graph.cut[v]:graph.cut[v + 1]], graph.w[graph.cut[v]:graph.cut[v + 1]]):
            to[label[u]] = to.get(label[u], 0.0) + float(w)
        stay = to.get(label[v], 0.0) - graph.k[v] * (tot[label[v]] - graph.k[v]) / m2
        worst += any(w - graph.k[v] * tot[c] / m2 > stay + 1e-9 for c, w in to.items() if c != label[v])
    # Totals change after a vertex was looked at, so a few may gain again on the next level.
    assert worst < 0.02 * len(graph.ids)


def test_contracting_keeps_weight_and_quality():
    rows = drawn(4)
    graph = M.read_graph(packs(rows))
    m2 = float(graph.k.sum())
    label, name, quality = M._local(graph, graph.ids, m2, 42)
    small, at = M._contract(graph, label)
    assert float(small.k.sum()) == m2 and (np.diff(small.ids) > 0).all() and (small.ids[at] <= graph.ids).all()
    still = np.arange(len(small.ids))
    inside = float(small.own.sum())
    assert inside / m2 - float((small.k ** 2).sum()) / m2 ** 2 == pytest.approx(quality) and len(still) == len(set(label.tolist()))


@pytest.mark.parametrize("method, column", [(C.louvain, "cluster_louvain"), (C.leiden, "cluster_leiden")])
def test_all_levels_are_one_job(spark, monkeypatch, method, column):
    """The tables that a run writes do not grow with its levels: the driver kept a plan of each."""
    rows = [("a", *r) for r in drawn(5)] + [("b", *r) for r in drawn(6)] + [("c", 5, 5, 2)]
    edges = G.Scratch(spark, "test").save(spark.createDataFrame(rows, SCHEMA), "edges")
    saved, save = [], G.Scratch.save
    monkeypatch.setattr(G.Scratch, "save", lambda self, df, name: saved.append(name) or save(self, df, name))
    found = method(edges).collect()
    assert len(saved) <= 2
    monkeypatch.undo()
    label = {(r.network, r.id): r[column] for r in found}
    assert len(label) == len(found) and set(label) == {(r[0], v) for r in rows for v in r[1:3]} and label["c", 5] == 5
    for n in ("a", "b"):
        mine = {v: c for (m, v), c in label.items() if m == n}
        assert modularity([r[1:] for r in rows if r[0] == n], mine) > 0.2


def test_vertices_of_edges_without_an_end_stay(spark):
    edges = spark.createDataFrame([("n", 1, 2, 1), ("n", 2, 3, 1), ("n", 9, None, 1), ("n", None, 8, 1)], SCHEMA)
    got = {r.id: r.cluster_louvain for r in C.louvain(edges).collect()}
    assert got[9] == 9 and got[8] == 8 and set(got) == {1, 2, 3, 8, 9}


def test_networks_beyond_a_task_are_dealt_beside_the_others(spark):
    rows = [("big", *r) for r in drawn(7)] + [("small", i, i + 1, 1) for i in range(20)]
    edges = G.Scratch(spark, "test").save(spark.createDataFrame(rows, SCHEMA), "edges")
    got = C.louvain(edges, block_arcs=3_000).groupBy("network").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))
    want = {n: len({v for r in rows if r[0] == n for v in r[1:3]}) for n in ("big", "small")}
    assert {r.network: (r.n, r.ids) for r in got.collect()} == {n: (m, m) for n, m in want.items()}


def test_small_components_are_solved_together(monkeypatch):
    """One call of the solver for all components of a size, also of those that are cut between batches."""
    rng, rows, want = np.random.default_rng(5), [], {}
    for network, base in (("m", 0), ("n", -500)):
        for c in range(40):
            size = 1 + c % 5
            a = np.triu(rng.integers(0, 3, (size, size))) + np.eye(size, k=1, dtype=int)
            a = a + a.T + (0 if size > 1 else 2)
            ids = base + 10 * c + np.sort(rng.permutation(9)[:size])
            values, vectors = np.linalg.eigh(a.astype(float))
            want |= {(network, base + 10 * c, int(v)): (abs(x), values[-1]) for v, x in zip(ids, vectors[:, -1])}
            rows += [(network, base + 10 * c, int(ids[i]), int(ids[j]), int(a[i, j])) for i in range(size) for j in range(size) if a[i, j]]
    calls, eigh = [], np.linalg.eigh
    monkeypatch.setattr(np.linalg, "eigh", lambda m: calls.append(m.shape) or eigh(m))
    for step in (len(rows), 7, 1):
        calls.clear()
        batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i:i + step])], names=["network", "component", "src", "dst", "n"])
                   for i in range(0, len(rows), step)]
        got = [r for b in G._leading(iter(batches)) for r in b.to_pylist()]
        assert {(r["network"], r["component"], r["id"]): pytest.approx((r["x"], r["value"])) for r in got} == want
        assert len(got) == len(want) and (step < len(rows) or len(calls) <= 10)
