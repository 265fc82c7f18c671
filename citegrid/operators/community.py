"""Louvain and Leiden communities by blocks of vertices.

A level holds ``arcs(network, src, dst, w)`` in both directions and ``nodes(network,
v, k, own)``: ``k`` is the weighted degree and ``own`` the weight inside the vertex,
counted from both ends.

A network of at most ``WHOLE_ARCS`` arcs is solved in one task, through all its levels
(``moves.py``), so that the driver runs the same few jobs however many levels and moves it takes.

The vertices of a larger one are dealt into blocks of about ``block_arcs`` arcs. In a round
every block is one group of two sides: it gets its vertices, their arcs and the communities and
community totals at the far ends, and moves its vertices one after the other until none
gains. What lies in other blocks stands still meanwhile, so a network of one block is at
rest after one round, however many moves that takes. Between several blocks half of them
move at a time, and the best partition seen is kept, since moves made at the same time can
lose modularity together. After the first round only vertices beside moved ones are looked
at, and only blocks that have some are read (the *frontier*).

Community totals are combined map-side and joined salted, so one big community is no hot
key. The driver sees one row per network and round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrid.operators.graph import both_ways, components, vertices
from citegrid.operators.moves import EPS, move_vertices, packed, refine_parts, turn_order, whole_network
from citegrid.session import Scratch

# A network of that many arcs is solved in one task, in some 30 bytes an arc.
WHOLE_ARCS = 32_000_000
# Arcs of a block of a larger one in the mean; a group of rows of that size is moved in one task. A
# network of several blocks needs some hundred rounds, so blocks are as large as a task can hold.
BLOCK_ARCS = 4_000_000
# Copies of a community's total that its vertices are joined to.
SALTS = 16


def _level_zero(edges: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    loop = F.col("source") == F.col("target")
    arcs = scratch.save(
        both_ways(edges.where(~loop), "weight").groupBy("network", "src", "dst")
        .agg(F.sum(F.col("weight").cast("double")).alias("w")), "arcs")
    degree = arcs.groupBy("network", F.col("src").alias("v")).agg(F.sum("w").alias("k"))
    loops = edges.where(loop).groupBy("network", F.col("source").alias("v")).agg(
        F.sum(2.0 * F.col("weight")).alias("own"))
    nodes = (
        vertices(edges).withColumnRenamed("id", "v")
        .join(degree, ["network", "v"], "left").join(loops, ["network", "v"], "left")
        .select("network", "v", (F.coalesce("k", F.lit(0.0)) + F.coalesce("own", F.lit(0.0))).alias("k"),
                F.coalesce("own", F.lit(0.0)).alias("own"))
    )
    return arcs, scratch.save(nodes, "nodes")


def _salted(rows: DataFrame, totals: DataFrame, keys: list[str], vertex: str) -> DataFrame:
    """``rows`` joined to a table of one row per community; a big community is met in ``SALTS`` places."""
    copies = totals.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    return (rows.withColumn("salt", F.pmod(F.xxhash64(vertex), F.lit(SALTS)).cast("int"))
            .join(copies, [*keys, "salt"]).drop("salt"))


def _block_counts(arcs: DataFrame, nodes: DataFrame, block_arcs: int) -> DataFrame:
    """``(network, m2, blocks)``, one row per network."""
    sizes = arcs.groupBy("network").agg(F.count(F.lit(1)).alias("n"))
    return nodes.groupBy("network").agg(F.sum("k").alias("m2")).join(sizes, "network", "left").select(
        "network", "m2", F.greatest(F.ceil(F.coalesce("n", F.lit(0)) / F.lit(block_arcs)), F.lit(1)).cast("int").alias("blocks"))


class _Block:
    """Rows of one group as arrays: vertices by number, arcs by source and target.

    Arcs stay in arrays, 32 bytes each; only those of the vertex at hand become Python objects.
    """

    def __init__(self, own: pa.Table, heard: pa.Table):
        self.rows = own.sort_by("v")
        outer = heard.drop_columns(["network", "block"]).sort_by([("v", "ascending"), ("dst", "ascending")])
        self.v = self.rows["v"].to_numpy()
        self.k, self.c, self.tot = (self.rows[x].to_numpy() for x in ("k", "c", "tot"))
        self.source = np.searchsorted(self.v, outer["v"].to_numpy())
        far = outer["dst"].to_numpy()
        at = np.minimum(np.searchsorted(self.v, far), max(len(self.v) - 1, 0))
        self.target = np.where(self.v[at] == far, at, -1) if len(self.v) else at
        self.far_c, self.far_tot, self.w = (outer[x].to_numpy() for x in ("dst_c", "dst_tot", "w"))
        self.cut = np.searchsorted(self.source, np.arange(len(self.v) + 1)).tolist()

    def arcs(self, *columns: np.ndarray) -> Callable[[int], Iterable[tuple]]:
        """The columns of a vertex' arcs."""
        cut = self.cut
        return lambda v: zip(*[x[cut[v]:cut[v + 1]].tolist() for x in columns])


def _move_block(seed: int):
    def run(own: pa.Table, heard: pa.Table) -> pa.Table:
        b = _Block(own, heard)
        name, index = np.unique(np.concatenate([b.c, b.far_c]), return_inverse=True)
        tot = np.zeros(len(name))
        tot[index] = np.concatenate([b.tot, b.far_tot])
        n, label, far, m2 = len(b.v), index[:len(b.c)].tolist(), index[len(b.c):], float(b.rows["m2"][0].as_py())
        order = turn_order(b.v, seed)
        first = order[b.rows["dirty"].to_numpy(zero_copy_only=False)[order]].tolist()
        tot = tot.tolist()
        if m2 > 0:
            move_vertices(b.k.tolist(), label, b.arcs(b.target, far, b.w), tot, name.tolist(), m2, first)
        now = np.array(label, dtype=np.int64)
        same = np.where(b.target >= 0, now[b.target], far) == now[b.source]
        inside = np.bincount(b.source[same], weights=b.w[same], minlength=n)
        out = b.rows.select(["network", "block", "v", "k", "own", "c", "best"])
        out = out.append_column("next", pa.array(name[label] if n else [], pa.int64()))
        out = out.append_column("inside", pa.array(inside, pa.float64()))
        return out.append_column("tot_next", pa.array([tot[c] for c in label], pa.float64()))
    return run


_STATE = "network string, block int, v bigint, k double, own double, c bigint, best bigint"


def _labelled(state: DataFrame, counts: DataFrame, dirty: Column) -> DataFrame:
    """The state with its communities' totals and its network's weight."""
    totals = state.groupBy("network", "c").agg(F.sum("k").alias("tot"))
    return _salted(state, totals, ["network", "c"], "v").join(
        F.broadcast(counts.select("network", "m2", "blocks")), "network").withColumn("dirty", dirty)


def _move_round(arcs: DataFrame, labelled: DataFrame, going: Column, seed: int) -> DataFrame:
    """One round of the blocks ``going``: each vertex with its community before and after."""
    blocks = labelled.where(going & F.col("dirty")).select("network", "block").distinct()
    ours = labelled.join(blocks, ["network", "block"], "left_semi")
    rest = labelled.join(blocks, ["network", "block"], "left_anti").select(
        "network", "block", "v", "k", "own", "c", "best", F.col("c").alias("next"),
        F.lit(None).cast("double").alias("inside"), F.lit(None).cast("double").alias("tot_next"))
    far = labelled.select("network", F.col("v").alias("dst"), F.col("c").alias("dst_c"), F.col("tot").alias("dst_tot"))
    heard = arcs.join(blocks, ["network", "block"], "left_semi").join(far, ["network", "dst"]).select(
        "network", "block", F.col("src").alias("v"), "dst", "dst_c", "dst_tot", "w")
    own = ours.select("network", "block", "v", "k", "own", "c", "best", "tot", "m2", "dirty")
    moved = own.groupBy("network", "block").cogroup(heard.groupBy("network", "block")).applyInArrow(
        _move_block(seed), f"{_STATE}, next bigint, inside double, tot_next double")
    return moved.unionByName(rest)


def _quality(arcs: DataFrame, state: DataFrame, label: str) -> DataFrame:
    """``(network, quality)``: modularity of the labels on a level."""
    here = state.select("network", F.col("v").alias("src"), F.col(label).alias("a"))
    there = state.select("network", F.col("v").alias("dst"), F.col(label).alias("b"))
    inside = arcs.join(here, ["network", "src"]).join(there, ["network", "dst"]).where("a = b").groupBy("network").agg(
        F.sum("w").alias("inside"))
    squares = state.groupBy("network", label).agg(F.sum("k").alias("tot"), F.sum("own").alias("own")).groupBy("network").agg(
        F.sum("tot").alias("m2"), F.sum("own").alias("own"), F.sum(F.col("tot") * F.col("tot")).alias("squares"))
    return squares.join(inside, "network", "left").select("network", F.coalesce(F.try_divide(
        F.coalesce("inside", F.lit(0.0)) + F.col("own"), "m2") - F.try_divide("squares", F.col("m2") * F.col("m2")),
        F.lit(0.0)).alias("quality"))


def _local_moves(arcs: DataFrame, nodes: DataFrame, seed: int, max_rounds: int, min_gain: float, block_arcs: int,
                 scratch: Scratch) -> tuple[DataFrame, dict[str, float]]:
    """Best partition found from ``nodes.c``: ``(network, v, k, own, c)`` and its modularity.

    A network of one block rests after a round. One of several rests once two rounds, which
    cover all blocks, moved none of its vertices or brought it less than ``min_gain``; its
    result does not depend on the networks beside it. One that has not come to rest after
    ``max_rounds`` is an error.
    """
    counts = scratch.save(_block_counts(arcs, nodes, block_arcs), "blocks")
    per = {r.network: r.blocks for r in counts.collect()}  # one row per network
    block = F.pmod(F.xxhash64("v", F.lit(seed)), "blocks").cast("int").alias("block")
    state = nodes.join(F.broadcast(counts), "network").select(
        "network", block, "v", "k", "own", "c", F.col("c").alias("best"))
    if any(n > 1 for n in per.values()):
        state = scratch.save(state, "start")
    arcs = scratch.save(
        arcs.join(F.broadcast(counts), "network").select(
            "network", F.pmod(F.xxhash64("src", F.lit(seed)), "blocks").cast("int").alias("block"), "src", "dst", "w"), "block-arcs")
    best: dict[str, float] = {}
    history: dict[str, list[float]] = {n: [] for n, m in per.items() if m > 1}
    idle = dict.fromkeys(history, 0)
    active, dirty = set(per), None
    for turn in range(max_rounds):
        labelled = _labelled(state, counts, F.lit(True))
        if dirty is not None:
            labelled = labelled.drop("dirty").join(dirty, ["network", "v"], "left").withColumn(
                "dirty", F.coalesce("dirty", F.lit(False)))
        labelled = scratch.save(labelled, "labelled")
        going = (F.col("blocks") == 1) | (F.pmod(F.xxhash64("block", F.lit(turn // 2)) + F.lit(turn), F.lit(2)) == 0)
        after = scratch.save(_move_round(arcs, labelled, going & F.col("network").isin(sorted(active)), seed + turn), "moves")
        seen = {r["network"]: r for r in after.groupBy("network").agg(
            F.count_if(F.col("next") != F.col("c")).alias("moved"), F.sum("k").alias("m2"),
            F.sum(F.col("inside") + F.col("own")).alias("inside"),
            F.sum(F.col("k") * F.col("tot_next")).alias("squares")).collect()}
        some = sorted(n for n in active if per[n] > 1)
        quality = {r["network"]: r["quality"] for r in _quality(
            arcs, after.where(F.col("network").isin(some)), "next").collect()} if some else {}
        better = []
        for n in sorted(active):
            r = seen[n]
            if per[n] == 1:
                quality[n] = (r["inside"] / r["m2"] - r["squares"] / r["m2"] ** 2) if r["m2"] else 0.0
                active.discard(n)
            else:
                idle[n] = 0 if r["moved"] else idle[n] + 1
                known = history[n]
                known.append(max(quality[n], best.get(n, quality[n])))
                if idle[n] == 2 or (len(known) > 2 and known[-1] - known[-3] < min_gain):
                    active.discard(n)
            if n not in best or quality[n] > best[n] + EPS:
                best[n] = quality[n]
                better.append(n)
        improved = F.col("network").isin(better) if better else F.lit(False)
        state = after.select("network", "block", "v", "k", "own", F.col("next").alias("c"),
                             F.when(improved, F.col("next")).otherwise(F.col("best")).alias("best"))
        if not active:
            break
        # A vertex beside a moved one, or one whose block did not move in this round, is looked at next.
        shifted = after.where(F.col("next") != F.col("c")).select("network", F.col("v").alias("src"))
        beside = arcs.join(shifted, ["network", "src"]).select("network", F.col("dst").alias("v"))
        waiting = labelled.where(F.col("dirty") & ~going).select("network", "v")
        dirty = scratch.save(beside.unionByName(waiting).distinct().withColumn("dirty", F.lit(True)), "frontier")
        state = scratch.save(state, "start")
    else:
        raise RuntimeError(f"communities of {sorted(active)} did not come to rest in {max_rounds} rounds")
    done = scratch.save(state.select("network", "v", "k", "own", F.col("best").alias("c")), "partition")
    return done, best


def _refine_block(seed: int):
    """Parts of the communities of a group: every vertex starts alone and may join a neighbour's part once."""
    def run(own: pa.Table, heard: pa.Table) -> pa.Table:
        b = _Block(own, heard)
        n, m2 = len(b.v), float(b.rows["m2"][0].as_py())
        part = refine_parts(b.v, b.k, b.rows["bound"].to_numpy(), b.tot, b.c, b.arcs(b.target, b.w), m2, seed)
        out = b.rows.select(["network", "v", "k", "own", "c"])
        return out.append_column("s", pa.array(b.v[part] if n else [], pa.int64()))
    return run


def _refine(arcs: DataFrame, parts: DataFrame, seed: int, block_arcs: int, scratch: Scratch) -> DataFrame:
    """Split each community ``c`` into well-connected parts ``s``, named by one of their vertices.

    Every vertex starts alone. One that is still alone, and well connected to its community,
    may join the well-connected part beside it that raises modularity most, so parts are
    connected. Communities are dealt into groups of about ``block_arcs`` arcs; a larger
    community is cut by vertex, and parts grow inside each cut, which the next level joins.
    """
    here = parts.select("network", F.col("v").alias("src"), F.col("c").alias("a"))
    there = parts.select("network", F.col("v").alias("dst"), F.col("c").alias("b"))
    inside = scratch.save(arcs.join(here, ["network", "src"]).join(there, ["network", "dst"]).where("a = b").select(
        "network", "src", "dst", F.col("a").alias("c"), "w"), "inside")
    counts = F.broadcast(_block_counts(inside, parts, block_arcs).withColumnRenamed("blocks", "groups"))
    sizes = inside.groupBy("network", "c").agg(F.count(F.lit(1)).alias("n"))
    whole = scratch.save(
        parts.groupBy("network", "c").agg(F.sum("k").alias("tot")).join(sizes, ["network", "c"], "left").join(counts, "network")
        .select("network", "c", "tot", "m2", "groups",
                F.greatest(F.ceil(F.coalesce("n", F.lit(0)) / F.lit(block_arcs)), F.lit(1)).cast("int").alias("cuts")), "whole")

    def group(v: str) -> Column:
        return F.when(F.col("cuts") > 1, F.concat_ws("/", "c", F.pmod(F.xxhash64(v, F.lit(seed)), "cuts"))).otherwise(
            F.pmod(F.xxhash64("c", F.lit(seed)), "groups").cast("string")).alias("block")

    bound = inside.groupBy("network", F.col("src").alias("v")).agg(F.sum("w").alias("bound"))
    own = _salted(parts, whole, ["network", "c"], "v").join(bound, ["network", "v"], "left").select(
        "network", group("v"), "v", "k", "own", "c", "tot", "m2", F.coalesce("bound", F.lit(0.0)).alias("bound"))
    heard = _salted(inside, whole, ["network", "c"], "src").where(
        (F.col("cuts") == 1) | F.pmod(F.xxhash64("src", F.lit(seed)), "cuts").eqNullSafe(F.pmod(F.xxhash64("dst", F.lit(seed)), "cuts"))
    ).select("network", group("src"), F.col("src").alias("v"), "dst", F.col("c").alias("dst_c"), F.lit(0.0).alias("dst_tot"), "w")
    return scratch.save(own.groupBy("network", "block").cogroup(heard.groupBy("network", "block")).applyInArrow(
        _refine_block(seed), "network string, v bigint, k double, own double, c bigint, s bigint"), "refined")


def _contract(arcs: DataFrame, state: DataFrame, group: str, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Arcs and nodes between groups, each named by its smallest vertex, and the renaming."""
    name = state.groupBy("network", group).agg(F.min("v").alias("rep"))
    renamed = scratch.save(state.join(name, ["network", group]), "renamed")
    to = renamed.select("network", "v", "rep")
    ends = (
        arcs.join(to.select("network", F.col("v").alias("src"), F.col("rep").alias("a")), ["network", "src"])
        .join(to.select("network", F.col("v").alias("dst"), F.col("rep").alias("b")), ["network", "dst"])
        .groupBy("network", "a", "b").agg(F.sum("w").alias("w"))
    )
    ends = scratch.save(ends, "contracted")
    inner = ends.where("a = b").select("network", F.col("a").alias("rep"), F.col("w").alias("inner"))
    columns = [F.sum("k").alias("k"), F.sum("own").alias("own")]
    if group != "c":
        columns.append(F.first("c").alias("c"))
    nodes = renamed.groupBy("network", "rep").agg(*columns).join(inner, ["network", "rep"], "left").withColumn(
        "own", F.col("own") + F.coalesce("inner", F.lit(0.0))).drop("inner").withColumnRenamed("rep", "v")
    between = ends.where("a <> b").select("network", F.col("a").alias("src"), F.col("b").alias("dst"), "w")
    return scratch.save(between, "arcs"), nodes, to


def _follow(members: DataFrame, step: DataFrame, label: str, scratch: Scratch) -> DataFrame:
    """Carry the original vertices along one renaming; networks that are done keep their place."""
    return scratch.save(
        members.join(step.select("network", F.col("v").alias("at"), F.col(label).alias("to")), ["network", "at"], "left")
        .select("network", "id", F.coalesce("to", "at").alias("at")), "members")


def _gained(best: dict[str, float], reached: dict[str, float], min_gain: float) -> list[str]:
    """Networks that a level improved by ``min_gain`` at least; only they go on."""
    return sorted(n for n, q in best.items() if q - reached.get(n, float("-inf")) >= min_gain)


def _smallest_member(members: DataFrame, label: str) -> DataFrame:
    name = members.groupBy("network", "at").agg(F.min("id").alias(label))
    return members.join(name, ["network", "at"]).select("network", "id", label)


def _solved(edges: DataFrame, whole_arcs: int, seed: int, max_levels: int, min_gain: float, refine: bool,
            scratch: Scratch) -> tuple[DataFrame, list[str]]:
    """``(network, id, label)`` of the networks of at most ``whole_arcs`` arcs, each solved in a task; the other networks."""
    # Each pair once. A vertex stays if the other end is missing.
    both = F.col("source").isNotNull() & F.col("target").isNotNull()
    pairs = edges.where("network IS NOT NULL").select(
        "network", F.least("source", "target").cast("bigint").alias("a"), F.greatest("source", "target").cast("bigint").alias("b"),
        F.when(both, F.col("weight")).cast("double").alias("w")).where("a IS NOT NULL")
    packs = scratch.save(
        pairs.groupBy("network", "a", "b").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).mapInArrow(
            packed, "network string, n bigint, a binary, b binary, w binary"), "packs")
    arcs = {r.network: 2 * r.n for r in packs.groupBy("network").agg(F.sum("n").alias("n")).collect()}  # one row per network
    large = sorted(n for n, m in arcs.items() if m > whole_arcs)
    # An explicit number of partitions is left alone, so that networks are not put together by their few bytes.
    labels = packs.where(~F.col("network").isin(large)).repartition(max(_partitions(edges), 8 * len(arcs)), "network")
    return scratch.save(labels.groupBy("network").applyInArrow(
        whole_network(seed, max_levels, min_gain, refine), "network string, id bigint, label bigint"), "solved"), large


def _partitions(edges: DataFrame) -> int:
    return int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def louvain(edges: DataFrame, seed: int = 42, max_levels: int = 100, max_rounds: int = 1_000,
            min_gain: float = 1e-6, block_arcs: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``(network, id, cluster_louvain)`` by weighted modularity; a label is the smallest member.

    A network ends at the level that brings it less than ``min_gain``; the limits are
    errors, not results. One of more than ``block_arcs`` arcs, or ``WHOLE_ARCS``, is dealt into blocks.
    """
    scratch = scratch or Scratch(edges.sparkSession, "louvain")
    solved, large = _solved(edges, block_arcs or WHOLE_ARCS, seed, max_levels, min_gain, False, scratch)
    solved = solved.withColumnRenamed("label", "cluster_louvain")
    if not large:
        return solved
    arcs, nodes = _level_zero(edges.where(F.col("network").isin(large)), scratch)
    members = scratch.save(nodes.select("network", F.col("v").alias("id"), F.col("v").alias("at")), "members")
    reached: dict[str, float] = {}
    for level in range(max_levels):
        state, best = _local_moves(arcs, nodes.withColumn("c", F.col("v")), seed + 1000 * level, max_rounds, min_gain,
                                   block_arcs or BLOCK_ARCS, scratch)
        going = _gained(best, reached, min_gain)
        if not going:
            break
        reached.update({n: best[n] for n in going})
        here = F.col("network").isin(going)
        arcs, nodes, step = _contract(arcs.where(here), state.where(here), "c", scratch)
        nodes = scratch.save(nodes, "nodes")
        members = _follow(members, step, "rep", scratch)
    else:
        raise RuntimeError(f"louvain did not end in {max_levels} levels")
    return solved.unionByName(_smallest_member(members, "cluster_louvain"))


def leiden(edges: DataFrame, seed: int = 42, max_levels: int = 100, max_rounds: int = 1_000,
           min_gain: float = 1e-6, block_arcs: int | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``(network, id, cluster_leiden)``: as Louvain, but contracting refined communities.

    Parts of a community stay separate vertices of the next level and start there in
    their community, so a badly placed part can still leave. Communities that ended up
    disconnected are split, which can only raise modularity.
    """
    scratch = scratch or Scratch(edges.sparkSession, "leiden")
    solved, large = _solved(edges, block_arcs or WHOLE_ARCS, seed, max_levels, min_gain, True, scratch)
    solved = solved.withColumnRenamed("label", "cluster_leiden")
    if not large:
        return solved
    edges = edges.where(F.col("network").isin(large))
    members = _leiden_blocks(edges, seed, max_levels, max_rounds, min_gain, block_arcs or BLOCK_ARCS, scratch)
    return solved.unionByName(_connected(edges, members, scratch))


def _leiden_blocks(edges: DataFrame, seed: int, max_levels: int, max_rounds: int, min_gain: float, block_arcs: int,
                   scratch: Scratch) -> DataFrame:
    """``(network, id, at)``: the communities before disconnected ones are split."""
    arcs, nodes = _level_zero(edges, scratch)
    members = scratch.save(nodes.select("network", F.col("v").alias("id"), F.col("v").alias("at")), "members")
    nodes = nodes.withColumn("c", F.col("v"))
    reached: dict[str, float] = {}
    final = members
    for level in range(max_levels):
        state, best = _local_moves(arcs, nodes, seed + 1000 * level, max_rounds, min_gain, block_arcs, scratch)
        going = _gained(best, reached, min_gain)
        if not going:
            break
        reached.update({n: best[n] for n in going})
        here = F.col("network").isin(going)
        state = scratch.save(state.where(here), "going")
        found = members.join(state.select("network", F.col("v").alias("at"), "c"), ["network", "at"]).select(
            "network", "id", F.col("c").alias("at"))
        final = scratch.save(final.where(~here).unionByName(found), "final")
        refined = _refine(arcs.where(here), state, seed + 1000 * level, block_arcs, scratch)
        arcs, nodes, step = _contract(arcs.where(here), refined, "s", scratch)
        nodes = scratch.save(nodes, "nodes")
        members = _follow(members, step, "rep", scratch)
    else:
        raise RuntimeError(f"leiden did not end in {max_levels} levels")
    return final


def _connected(edges: DataFrame, members: DataFrame, scratch: Scratch) -> DataFrame:
    """Split communities into connected ones, named by their smallest member."""
    a = members.select("network", F.col("id").alias("source"), F.col("at").alias("ca"))
    b = members.select("network", F.col("id").alias("target"), F.col("at").alias("cb"))
    inside = edges.select("network", "source", "target").join(a, ["network", "source"]).join(
        b, ["network", "target"]).where("ca = cb").select("network", "source", "target")
    pieces = components(scratch.save(inside, "inside"), scratch)
    return members.select("network", "id").join(pieces, ["network", "id"], "left").select(
        "network", "id", F.coalesce("component", "id").alias("cluster_leiden"))
