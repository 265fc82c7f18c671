"""Networks against brute force, with hubs, repeated citations and repeated works."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citegrid.operators import networks as N
from citegrid.operators import skew
from citegrid.operators import verify as V
from citegrid.operators.skew import grid_join, pairs_within
from citegrid.plans import build


@pytest.fixture(scope="module")
def data(spark):
    rng = random.Random(5)
    works = list(range(1, 41))
    citations = [(rng.randint(1, 50), rng.randint(1, 60)) for _ in range(300)]
    citations += [(w, 7) for w in range(1, 41)]          # a hub everyone cites
    citations += citations[:20] + [(3, 3), (5, 9), (9, 5), (8, None)]
    return (works, citations,
            spark.createDataFrame([(w,) for w in works], "id long"),
            spark.createDataFrame(citations, "citing_id long, cited_id long"))


def brute(works, citations, item, key, multiset, copies=None):
    known, groups = set(works), {}
    rows = [c for c in citations if None not in c and c[item] in known]
    for c in rows if multiset else set(rows):
        groups.setdefault(c[key], []).append(c[item])
    weight = Counter()
    for members in groups.values():
        for a, b in itertools.permutations(members, 2):
            if a < b:
                weight[a, b] += (copies or {}).get(a, 1)
    return sorted((a, b, w) for (a, b), w in weight.items())


@pytest.mark.parametrize("multiset", [False, True])
@pytest.mark.parametrize("block_rows", [3, 10_000])
def test_coupling_and_cocitation(data, rows, multiset, block_rows):
    works, citations, w, c = data
    columns = ("source", "target", "weight")
    assert rows(N.coupling(w, c, multiset, block_rows), *columns) == brute(works, citations, 0, 1, multiset)
    assert rows(N.cocitation(w, c, multiset, block_rows), *columns) == brute(works, citations, 1, 0, multiset)


def test_repeated_work_ids_multiply_only_as_multiset(spark, data, rows):
    works, citations, w, c = data
    twice = w.unionByName(w.where("id <= 5"))
    copies = {i: 2 for i in range(1, 6)}
    columns = ("source", "target", "weight")
    assert rows(N.coupling(twice, c), *columns) == brute(works, citations, 0, 1, False)
    assert rows(N.coupling(twice, c, multiset=True), *columns) == brute(works, citations, 0, 1, True, copies)


def test_orientation_is_numeric(spark, rows):
    works, citations = N.typed_ids(
        spark.createDataFrame([("99",), ("100",)], "id string"),
        spark.createDataFrame([("100", "1"), ("99", "1")], "citing_id string, cited_id string"))
    assert rows(N.coupling(works, citations), "source", "target") == [(99, 100)]


def test_direct_citation_is_distinct_and_keeps_loops(data, rows):
    works, citations, w, c = data
    want = sorted({(a, b, 1) for a, b in citations if a in works and b in works})
    assert rows(N.direct_citation(w, c), "source", "target", "weight") == want
    assert (3, 3, 1) in want


def test_hybrid_sums_reciprocal_edges(data, rows):
    _, _, w, c = data
    base = N.base_networks(w, c)
    merged = Counter()
    for df in base.values():
        for s, t, x in rows(df, "source", "target", "weight"):
            merged[min(s, t), max(s, t)] += x
    want = sorted((s, t, x) for (s, t), x in merged.items())
    assert rows(N.hybrid(*base.values())) == want
    only_dc = dict(((s, t), x) for s, t, x in rows(N.hybrid(base["dc"])))
    assert only_dc[5, 9] == 2 and only_dc[3, 3] == 1


def test_strength_identity(data, rows):
    _, _, w, c = data
    assert rows(V.strength(N.coupling(w, c))) == rows(V.expected_strength(w, c.dropna(), "citing_id", "cited_id"))
    assert rows(V.strength(N.cocitation(w, c))) == rows(V.expected_strength(w, c.dropna(), "cited_id", "citing_id"))


def test_compare(spark, data):
    _, _, w, c = data
    edges = N.coupling(w, c)
    assert V.compare(edges, edges).first().verdict == "MATCH"
    other = V.compare(edges, edges.where("source > 2")).first()
    assert other.verdict == "MISMATCH" and other.left_only > 0 and other.right_only == 0


def test_stack_and_summary(data, rows):
    _, _, w, c = data
    base = N.base_networks(w, c)
    edges = N.stack({**base, **N.hybrid_networks(base)})
    assert [r[0] for r in rows(N.summary(edges))] == sorted(N.NETWORKS)


def test_blocked_joins_lose_and_repeat_nothing(spark, rows):
    left = spark.createDataFrame([("h", i) for i in range(50)] + [("c", i) for i in range(3)], "k string, a long")
    right = spark.createDataFrame([("h", i) for i in range(37)] + [("d", 1)], "k string, b long")
    want = sorted(("h", i, j) for i in range(50) for j in range(37))
    assert rows(grid_join(left, right, "k", "a", "b", block_rows=4), "k", "a", "b") == want
    pairs = pairs_within(left, "k", "a", block_rows=4)
    want = list(itertools.combinations(range(50), 2)) + list(itertools.combinations(range(3), 2))
    assert rows(pairs) == sorted(want)


def test_partitions_follow_the_pairs(spark, monkeypatch):
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert skew.tasks_for(spark, 0) == least
    assert skew.tasks_for(spark, 100 * skew.TASK_PAIRS) == 101
    assert skew.tasks_for(spark, 1e30) == skew.MOST_TASKS
    monkeypatch.setattr(skew, "TASK_PAIRS", 50)
    rows = spark.createDataFrame([(k, i) for k in range(3) for i in range(30 if k else 2)], "key int, item int")
    pairs = skew.pairs_within(rows, "key", "item", block_rows=7)
    found = [tuple(r) for r in pairs.collect()]
    want = [(a, b) for n in (2, 30, 30) for a in range(n) for b in range(a + 1, n)]
    assert sorted(found) == sorted(want)
    assert pairs.rdd.getNumPartitions() == 871 // 50 + 1
    empty = skew.pairs_within(rows.where("key > 9"), "key", "item")
    assert empty.count() == 0


def test_a_run_goes_on_behind_finished_stages(spark, tmp_path, monkeypatch):
    works, cites, out = (str(tmp_path / n) for n in ("works", "citations", "out"))
    spark.createDataFrame([(i, f"w{i}") for i in range(6)], "id bigint, openalex_id string").write.parquet(works)
    spark.createDataFrame([(a, b) for a in range(6) for b in range(a)], "citing_id bigint, cited_id bigint").write.parquet(cites)
    calls = []

    def measured(name):
        def measure(edges, *args, **kwargs):
            calls.append(name)
            if name == "leiden" and calls.count(name) == 1:
                raise RuntimeError("ended")
            column = {"component": "component", "louvain": "cluster_louvain", "leiden": "cluster_leiden",
                      "closeness": "closeness", "eigen": "eigen_centrality"}[name]
            return build.graph.vertices(edges).withColumn(column, F.lit(1))
        return measure

    for module, attribute, name in ((build.graph, "components", "component"), (build.community, "louvain", "louvain"),
                                    (build.community, "leiden", "leiden"), (build.graph, "closeness", "closeness"),
                                    (build.graph, "eigenvector", "eigen")):
        monkeypatch.setattr(module, attribute, measured(name))
    with pytest.raises(RuntimeError, match="ended"):
        build.run(spark, works, cites, out)
    assert calls == ["component", "louvain", "leiden"]
    monkeypatch.setattr(build.N, "cocitation", lambda *a: pytest.fail("made again"))
    build.run(spark, works, cites, out, resume=True)
    assert calls[3:] == ["leiden", "closeness", "eigen"]
    nodes = spark.read.parquet(f"{out}/nodes")
    assert nodes.groupBy("network").count().count() == 7 and nodes.where("cluster_leiden IS NULL").count() == 0
    assert not (tmp_path / "out" / "_stages").exists()
    # Other parameters take nothing that is finished.
    kept = build.Stages(spark, f"{out}/_stages", seed=1)
    kept.table("t", lambda: nodes)
    assert kept.finished("t") and not build.Stages(spark, f"{out}/_stages", seed=2).finished("t")


@pytest.mark.parametrize("multiset", [False, True])
def test_pairs_of_heavy_sources_are_dealt_and_summed(data, rows, multiset):
    """Sources of more than a few keys go to several tasks, hubs to cells; nothing is lost or counted twice."""
    works, citations, w, c = data
    known = c.where("citing_id <= 40 AND cited_id IS NOT NULL")
    counted = (known.groupBy("citing_id", "cited_id").agg(F.count(F.lit(1)).alias("m")) if multiset
               else known.distinct().withColumn("m", F.lit(1).cast("bigint")))
    for block_rows in (4, 10_000):
        found = skew.summed_pairs(counted, "cited_id", "citing_id", F.sum(F.col("m_source") * F.col("m_target")),
                                  ("m",), block_rows, heavy_keys=3)
        assert rows(found) == brute(works, citations, 0, 1, multiset)


def test_tasks_that_sum_pairs_follow_their_number(spark, data, monkeypatch):
    """A fixed number of partitions let the pairs of a task grow with the input."""
    _, _, w, c = data
    monkeypatch.setattr(skew, "TASK_PAIRS", 20)
    edges = N.coupling(w, c)
    tasks = max(spark.sparkContext.defaultParallelism, edges.agg(F.sum("weight")).first()[0] // 20)
    per = edges.groupBy(F.spark_partition_id()).agg(F.sum("weight").alias("n")).agg(F.max("n"), F.count("n")).first()
    assert per[1] > 20 and per[0] < tasks * 20 / 4
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3
