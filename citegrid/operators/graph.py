"""Node measures on the undirected graph of an edge table.

Every operator is keyed by ``(network, id)``, so all networks run in one job. Loops
write each round to the scratch area, end on a one-row aggregate and never bring
rows to the driver. ``edges`` is ``(network, source, target, weight)``; repeated
edges and self-loops count as they stand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegrid.operators.keys import dense_id
from citegrid.session import Scratch

# Arcs of one vertex that a single task may hold in the iterative jobs.
HUB_ARCS = 1_000_000


def vertices(edges: DataFrame) -> DataFrame:
    """Distinct endpoints; works without an edge do not appear."""
    return edges.select("network", F.explode(F.array("source", "target")).alias("id")).distinct()


def both_ways(edges: DataFrame, *carry: str) -> DataFrame:
    """Each edge as ``(network, src, dst)`` in both directions; a self-loop once."""
    ends = F.when(
        F.col("source") == F.col("target"),
        F.array(F.struct(F.col("source").alias("src"), F.col("target").alias("dst"))),
    ).otherwise(F.array(
        F.struct(F.col("source").alias("src"), F.col("target").alias("dst")),
        F.struct(F.col("target").alias("src"), F.col("source").alias("dst")),
    ))
    return edges.select("network", *carry, F.explode(ends).alias("e")).select("network", "e.src", "e.dst", *carry)


def degree(edges: DataFrame) -> DataFrame:
    """Edge ends per vertex: repeated edges count each, a self-loop counts twice."""
    ends = edges.select("network", F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("network", "id").agg(F.count(F.lit(1)).alias("degree"))


# --- components -------------------------------------------------------------------

def components(edges: DataFrame, scratch: Scratch | None = None, max_rounds: int = 200) -> DataFrame:
    """Component of each vertex, named by its smallest vertex id.

    First every vertex follows its smallest neighbours down to one that has none below it,
    which names a tree. Only links between different trees are left after that, mostly few,
    and settle the names of the trees. So most rounds move vertices and not links.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    links = edges.where(F.col("source") != F.col("target")).select("network", "source", "target")
    both = links.unionByName(links.select("network", F.col("target").alias("source"), F.col("source").alias("target")))
    named = scratch.save(both.groupBy("network", F.col("source").alias("u")).agg(
        F.least("u", F.min("target")).alias("v")), "named")
    for _ in range(max_rounds):
        above = named.select("network", F.col("u").alias("v"), F.col("v").alias("w"))
        named, now = scratch.measure(
            named.join(above, ["network", "v"]).select("network", "u", F.col("w").alias("v"), (F.col("v") != F.col("w")).alias("moved")),
            "named", F.count_if("moved").alias("moved"))
        scratch.release()
        if not now["moved"]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    named = named.select("network", "u", "v")
    for end, tree in (("source", "a"), ("target", "b")):
        links = links.join(named.select("network", F.col("u").alias(end), F.col("v").alias(tree)), ["network", end])
    rest = scratch.save(
        links.where("a <> b").select("network", F.col("a").alias("source"), F.col("b").alias("target")).distinct(), "rest")
    if not rest.isEmpty():
        joined = scratch.save(_settle(rest, scratch, max_rounds), "joined").select(
            "network", F.col("u").alias("v"), F.col("v").alias("root"))
        named = named.join(joined, ["network", "v"], "left").select("network", "u", F.coalesce("root", "v").alias("v"))
    stars = named.select("network", F.col("u").alias("id"), F.col("v").alias("component"))
    every = vertices(edges)
    return every.join(stars, ["network", "id"], "left").withColumn(
        "component", F.coalesce("component", "id"))


def _settle(edges: DataFrame, scratch: Scratch, max_rounds: int) -> DataFrame:
    """Links ``(network, u, v)`` of each vertex but the smallest to the smallest of its component.

    Alternates two local steps on vertex pairs (Kiveris et al., 2014): every vertex
    links its larger neighbours, then its smaller ones, to its minimum neighbour. The
    edge set shrinks to one star per component in a logarithmic number of rounds.
    """
    links = scratch.save(
        edges.select(
            "network", F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v")
        ).distinct(), "links")
    mark = None
    for _ in range(max_rounds):
        # The round changed nothing if count and digest of the pairs are unchanged.
        links, now = scratch.measure(
            _small_star(_large_star(links, scratch), scratch), "links", F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("network", "u", "v").cast("decimal(38,0)")).alias("digest"))
        scratch.release()
        if now == mark:
            return links
        mark = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _large_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """For each vertex: its larger neighbours point to the minimum around it."""
    both = links.select("network", "u", "v").unionByName(
        links.select("network", F.col("v").alias("u"), F.col("u").alias("v")))
    # Minima are stored before they are joined: the centre of a giant star is one key, which
    # Spark can split only if neither side is an aggregate on it.
    low = scratch.save(
        both.groupBy("network", "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "low")
    return (
        both.where(F.col("v") > F.col("u")).join(low, ["network", "u"])
        .select("network", F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(links: DataFrame, scratch: Scratch) -> DataFrame:
    """For each vertex: it and its smaller neighbours point to the smallest of them."""
    links = scratch.save(links, "half")
    low = scratch.save(links.groupBy("network", "u").agg(F.min("v").alias("m")), "lowest")
    rest = links.join(low, ["network", "u"]).where(F.col("v") != F.col("m")).select(
        "network", F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(low.select("network", "u", F.col("m").alias("v"))).distinct()


# --- eigenvector centrality -------------------------------------------------------

# Components up to this size are solved whole, each in one task (a dense matrix of 32 MB).
DENSE_VERTICES = 2_000
# Larger ones: the matrix of a network is cut into a grid of this many vertex blocks, more if
# a block would have more vertices than that, and a cell into parts of so many edges.
SIDE = 6
BLOCK_VERTICES = 4_000_000
CELL_EDGES = 16_000_000
# Edges in one row of a cell, and rows packed together before they are dealt to cells.
SLICE_EDGES = 1 << 19
PACKED_ROWS = 1 << 18
_CELL = ["network", "i", "j", "p"]


def eigenvector(edges: DataFrame, tolerance: float = 1e-10, max_steps: int = 100_000, stride: int = 10,
                dense_vertices: int = DENSE_VERTICES, hub_arcs: int = CELL_EDGES,
                scratch: Scratch | None = None) -> DataFrame:
    """Unweighted eigenvector centrality with the largest value of a network at 1.

    It is the limit of power iteration on ``A + I`` from equal values, a self-loop
    counting twice in ``A``. The matrix falls into components, each with one leading
    vector: small components are solved directly, large ones by power iteration until
    the residual ``max|Ax - lx|`` is at most ``tolerance`` times ``l * max(x)``. In the
    limit only components with the network's largest eigenvalue keep values, in
    proportion to what the start has of their vectors. A component that has not
    converged after ``max_steps`` is an error. ``hub_arcs`` is the number of edges that
    a single task may hold.
    """
    scratch = scratch or Scratch(edges.sparkSession, "eigenvector")
    part = ["network", "component"]
    member = scratch.save(components(edges), "member")
    sizes = scratch.save(
        member.groupBy(*part).agg(F.count(F.lit(1)).alias("size")).withColumn(
            "small", F.col("size") <= dense_vertices), "sizes")
    large = sizes.where("NOT small").select(*part)
    solved = []
    few = scratch.save(member.join(sizes.where("small").select(*part), part, "left_semi"), "few")
    if not few.isEmpty():
        loops = F.when(F.col("src") == F.col("dst"), F.lit(2)).otherwise(F.lit(1))
        # Parallel edges become a multiplicity; both ends of an arc lie in one component.
        counted = (
            both_ways(edges.join(few.withColumnRenamed("id", "source"), ["network", "source"]), "component")
            .withColumn("n", loops).groupBy(*part, "src", "dst").agg(F.sum("n").alias("n")))
        solved.append(scratch.save(counted.repartition(*part).sortWithinPartitions(*part).mapInArrow(
            _leading, "network string, component bigint, id bigint, x double, value double"), "solved"))
    if not large.isEmpty():
        solved.append(_iterate(edges, member.join(large, part, "left_semi"), tolerance, max_steps, stride, hub_arcs, scratch))
    if not solved:
        return edges.sparkSession.createDataFrame([], "network string, id bigint, eigen_centrality double")
    solved = reduce(DataFrame.unionByName, solved)
    share = solved.groupBy(*part).agg(
        F.first("value").alias("value"), (F.sum("x") / F.sum(F.col("x") * F.col("x"))).alias("share"),
        F.max("x").alias("top"))
    leads = share.groupBy("network").agg(F.max("value").alias("most"))
    led = scratch.save(
        share.join(leads, "network").where(F.col("value") >= F.col("most") - 1e-8 * (1 + F.col("most"))), "led")
    tops = led.groupBy("network").agg(F.max(F.col("share") * F.col("top")).alias("most_x"))
    scale = led.join(tops, "network").select(*part, (F.col("share") / F.col("most_x")).alias("scale"))
    return scratch.save(
        solved.join(scale, part, "left").select(
            "network", "id", (F.col("x") * F.coalesce("scale", F.lit(0.0))).alias("eigen_centrality")), "centrality")


def _leading(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leading eigenvector and eigenvalue of each component; its arcs come one after the other."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        network, component = batch["network"], batch["component"].to_numpy()
        key = (network[-1].as_py(), int(component[-1]))
        if held and (network[0].as_py(), int(component[0])) == last == key:
            held.append(batch)
            continue
        # What belongs to the last component may go on in the next batch.
        other = np.flatnonzero((component != key[1]) | ~pc.equal(network, key[0]).to_numpy(zero_copy_only=False))
        whole = int(other[-1]) + 1 if len(other) else 0
        if held or whole:
            yield _solved([*held, batch.slice(0, whole)])
        held, last = [batch.slice(whole)], key
    if held:
        yield _solved(held)


def _solved(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Components of one size are solved together, as many as make some 32 MB."""
    arcs = pa.Table.from_batches(held).combine_chunks()
    component, src, dst, n = (arcs[c].to_numpy() for c in ("component", "src", "dst", "n"))
    network = arcs["network"].combine_chunks().dictionary_encode()
    code = network.indices.to_numpy()
    first = np.concatenate([[True], (component[1:] != component[:-1]) | (code[1:] != code[:-1])])
    of = np.cumsum(first) - 1
    ids = np.unique(np.concatenate([src, dst]))
    # Every vertex is the source of an arc.
    vertices, at = np.unique(of * len(ids) + np.searchsorted(ids, src), return_inverse=True)
    to = np.searchsorted(vertices, of * len(ids) + np.searchsorted(ids, dst))
    member = vertices // len(ids)
    size = np.bincount(member)
    start = np.cumsum(size) - size
    x, value = np.zeros(len(vertices)), np.zeros(len(size))
    by_size = np.argsort(size[of], kind="stable")
    for s, arc in zip(np.unique(size), np.split(by_size, np.flatnonzero(np.diff(size[of][by_size])) + 1)):
        which = np.flatnonzero(size == s)
        rank = np.searchsorted(which, of[arc])
        many = max(1, DENSE_VERTICES ** 2 // int(s * s))
        for lo in range(0, len(which), many):
            here = (rank >= lo) & (rank < lo + many)
            a, some = arc[here], which[lo:lo + many]
            matrix = np.zeros((len(some), s, s))
            matrix[rank[here] - lo, at[a] - start[of[a]], to[a] - start[of[a]]] = n[a]
            values, vectors = np.linalg.eigh(matrix)
            value[some] = values[:, -1]
            x[start[some][:, None] + np.arange(s)] = np.abs(vectors[:, :, -1])
    return pa.RecordBatch.from_arrays(
        [network.dictionary.take(pa.array(code[first][member])), component[first][member], ids[vertices % len(ids)], x, value[member]],
        names=["network", "component", "id", "x", "value"])


def _iterate(edges: DataFrame, members: DataFrame, tolerance: float, max_steps: int, stride: int,
             cell_edges: int, scratch: Scratch) -> DataFrame:
    """Power iteration on ``A + I`` for all components of ``members`` at once.

    ``stride`` steps form one Spark job, which ends with scaling and the residual test. A
    step sends the blocks of the vector to the cells of the grid and sums what these return,
    so that a value moves ``SIDE`` times there and back, whatever the number of edges.
    """
    part = ["network", "component"]
    members = scratch.save(members, "members")
    most = members.groupBy("network").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"]
    side = max(SIDE, -(-most // BLOCK_VERTICES))
    blocks = scratch.save(
        members.withColumn("block", _block("id", side)).groupBy("network", "block")
        .applyInArrow(_listed, "network string, block int, ids binary, components binary"), "blocks")
    cells, routes = _cells(edges, blocks, side, cell_edges, scratch)
    x = members.withColumn("x", F.lit(1.0))
    done, left = 0, 1
    try:
        while left:
            if done >= max_steps:
                raise RuntimeError(f"eigenvector: {left} components did not converge in {max_steps} steps")
            y = x.withColumn("block", _block("id", side)).select("network", "block", "id", "x").groupBy(
                "network", "block").applyInArrow(_packed, "network string, block int, x binary")
            for _ in range(stride - 1):
                y = _multiply(cells, routes, y, False).groupBy("network", "block").applyInArrow(
                    _summed, "network string, block int, x binary")
            done += stride
            raw = scratch.save(
                _multiply(cells, routes, y, True).groupBy("network", "block").cogroup(blocks.groupBy("network", "block"))
                .applyInArrow(_unpacked, "network string, component bigint, id bigint, x double, before double"), "raw")
            value = scratch.save(raw.groupBy(*part).agg(
                (F.sum(F.col("x") * F.col("before")) / F.sum(F.col("before") * F.col("before"))).alias("value"),
                F.max("x").alias("top")), "value")
            x = scratch.save(
                raw.join(value, part).select(
                    "id", *part, (F.col("x") / F.col("top")).alias("x"), "value",
                    (F.abs(F.col("x") - F.col("value") * F.col("before")) / F.col("top")).alias("rest")), "vector")
            off = x.groupBy(*part).agg(F.max("rest").alias("rest")).where(F.col("rest") > tolerance)
            left = off.count()
            scratch.release()
    finally:
        cells.unpersist()
        scratch.drop("members", "blocks", "grid", "routes", "raw", "value")
    return x.select("network", "component", "id", "x", (F.col("value") - 1.0).alias("value"))


def _block(vertex: str, side: int) -> Column:
    return F.pmod(F.xxhash64(F.col(vertex).cast("bigint")), F.lit(side)).cast("int")


def _cells(edges: DataFrame, blocks: DataFrame, side: int, cell_edges: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The edges by cell, resident for all steps, and the routes of the vertex blocks to the cells.

    Cell ``(i, j)`` with ``i <= j`` has the edges between two blocks once, as places in the
    blocks; it serves both directions. Cells of many edges are dealt into parts ``p``. Edges
    without a place in the blocks belong to small components and are left out.
    """
    networks = F.broadcast(blocks.select("network").distinct())  # a few rows
    ends = edges.join(networks, "network", "left_semi").where("source IS NOT NULL AND target IS NOT NULL").select(
        "network", F.col("source").cast("bigint").alias("a"), F.col("target").cast("bigint").alias("b"),
        _block("source", side).alias("i"), _block("target", side).alias("j"))
    turned = F.col("i") > F.col("j")
    sided = ends.select(
        "network", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"),
        F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))
    # A row per cell, and one per block for its diagonal cell, which adds the block itself.
    counts = sided.groupBy("network", "i", "j").agg(F.count(F.lit(1)).alias("n")).unionByName(
        blocks.select("network", F.col("block").alias("i"), F.col("block").alias("j"), F.lit(1).cast("bigint").alias("n")))
    grid = scratch.save(counts.groupBy("network", "i", "j").agg(
        F.ceil(F.max("n") / cell_edges).cast("int").alias("parts")), "grid")
    routes = scratch.save(
        grid.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("block", F.explode(F.array_distinct(F.array("i", "j")))).select(*_CELL, "block"), "routes")
    dealt = sided.join(F.broadcast(grid), ["network", "i", "j"]).withColumn(
        "p", F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int")).select(*_CELL, "a", "b").mapInArrow(
        _dealt, "network string, i int, j int, p int, a binary, b binary")
    lists = blocks.join(F.broadcast(routes), ["network", "block"]).select(*_CELL, "block", "ids")
    placed = dealt.groupBy(*_CELL).cogroup(lists.groupBy(*_CELL)).applyInArrow(
        _placed, "network string, i int, j int, p int, a binary, b binary")
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, *_CELL).sortWithinPartitions(*_CELL).persist(), routes


def _multiply(cells: DataFrame, routes: DataFrame, x: DataFrame, keep: bool) -> DataFrame:
    """What each cell adds to its two blocks in one step: ``(network, block, y, own)``."""
    spread = x.join(F.broadcast(routes), ["network", "block"]).select(*_CELL, "block", "x")
    return cells.groupBy(*_CELL).cogroup(spread.groupBy(*_CELL)).applyInArrow(
        _pushed(keep), "network string, block int, y binary, own boolean")


def _bytes(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _arrays(column: pa.ChunkedArray, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(v.as_buffer(), kind) for v in column]


def _block_table(rows: pa.Table, **columns: np.ndarray) -> pa.Table:
    return pa.table({"network": rows["network"].slice(0, 1).cast(pa.string()), "block": rows["block"].slice(0, 1).cast(pa.int32()),
                     **{name: _bytes([a]) for name, a in columns.items()}})


def _listed(rows: pa.Table) -> pa.Table:
    """Vertices of a block in ascending order, with their components."""
    ids, of = rows["id"].to_numpy(), rows["component"].to_numpy()
    order = np.argsort(ids)
    return _block_table(rows, ids=ids[order], components=of[order])


def _packed(rows: pa.Table) -> pa.Table:
    """Values of a block in the order of its vertices."""
    return _block_table(rows, x=rows["x"].to_numpy()[np.argsort(rows["id"].to_numpy())])


def _dealt(batches):
    """Edges of many rows as one row per cell."""
    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).group_by(_CELL, use_threads=False).aggregate([("a", "list"), ("b", "list")])
        ends = {}
        for side in ("a", "b"):
            lists = pa.concat_arrays(table[f"{side}_list"].chunks)
            ids, at = lists.values.to_numpy(), lists.offsets.to_numpy()
            ends[side] = _bytes([ids[k:m] for k, m in zip(at[:-1], at[1:])])
        return pa.RecordBatch.from_arrays(
            [pa.array(table[c].to_pylist(), kind) for c, kind in zip(_CELL, (pa.string(), pa.int32(), pa.int32(), pa.int32()))]
            + [ends["a"], ends["b"]], names=[*_CELL, "a", "b"])

    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= PACKED_ROWS:
            yield pack(held)
            held, rows = [], 0
    if held:
        yield pack(held)


def _placed(edges: pa.Table, lists: pa.Table) -> pa.Table:
    """Edges of a cell as places in its two blocks, cut into slices."""
    columns = {c: [] for c in (*_CELL, "a", "b")}
    if lists.num_rows:
        key = [lists[c][0].as_py() for c in _CELL]
        ids = dict(zip(lists["block"].to_pylist(), _arrays(lists["ids"], np.int64)))
        first, second = ids[key[1]], ids[key[2]]
        held, many = [], 0

        def cut():
            for c, v in zip(_CELL, key):
                columns[c].append(v)
            for c, k in (("a", 0), ("b", 1)):
                columns[c].append(np.concatenate([h[k] for h in held]).tobytes())

        for a, b in zip(_arrays(edges["a"], np.int64), _arrays(edges["b"], np.int64)):
            at, to = np.searchsorted(first, a), np.searchsorted(second, b)
            inside = first[np.minimum(at, len(first) - 1)] == a
            held.append((at[inside].astype(np.int32), to[inside].astype(np.int32)))
            many += len(held[-1][0])
            if many >= SLICE_EDGES:
                cut()
                held, many = [], 0
        if many:
            cut()
    kinds = {"network": pa.string(), "i": pa.int32(), "j": pa.int32(), "p": pa.int32(), "a": pa.binary(), "b": pa.binary()}
    return pa.table({c: pa.array(v, kinds[c]) for c, v in columns.items()})


def _pushed(keep: bool):
    """One step in a cell; the first part of a diagonal cell also returns its block, apart if ``keep``."""
    def run(cells: pa.Table, spread: pa.Table) -> pa.Table:
        network, i, j, p = (spread[c][0].as_py() for c in _CELL)
        x = dict(zip(spread["block"].to_pylist(), _arrays(spread["x"], np.float64)))
        y = {b: np.zeros(len(v)) for b, v in x.items()}
        for a, b in zip(_arrays(cells["a"], np.int32), _arrays(cells["b"], np.int32)):
            y[i] += np.bincount(a, x[j][b], len(x[i]))
            y[j] += np.bincount(b, x[i][a], len(x[j]))
        out = [(b, v, False) for b, v in y.items()]
        if i == j and p == 0:
            if keep:
                out.append((i, x[i], True))
            else:
                y[i] += x[i]
        return pa.table({
            "network": pa.array([network] * len(out), pa.string()), "block": pa.array([o[0] for o in out], pa.int32()),
            "y": _bytes([o[1] for o in out]), "own": pa.array([o[2] for o in out])})
    return run


def _summed(rows: pa.Table) -> pa.Table:
    return _block_table(rows, x=reduce(np.add, _arrays(rows["y"], np.float64)))


def _unpacked(rows: pa.Table, blocks: pa.Table) -> pa.Table:
    """A row per vertex with its value after and before the last step."""
    parts = _arrays(rows["y"], np.float64)
    ids = _arrays(blocks["ids"], np.int64)[0]
    return pa.table({
        "network": pa.array([rows["network"][0].as_py()] * len(ids), pa.string()),
        "component": _arrays(blocks["components"], np.int64)[0], "id": ids, "x": reduce(np.add, parts),
        "before": parts[rows["own"].to_pylist().index(True)]})


def _renumber(arcs: DataFrame, numbered: DataFrame, *carry: str) -> DataFrame:
    """Arcs between vertex numbers; one integer replaces network and id in every round."""
    return (
        arcs.join(numbered.select("network", F.col("id").alias("src"), F.col("v").alias("s")), ["network", "src"])
        .join(numbered.select("network", F.col("id").alias("dst"), F.col("v").alias("t")), ["network", "dst"])
        .select("s", "t", *carry)
    )


def _resident(arcs: DataFrame, hub_arcs: int, scratch: Scratch) -> tuple[DataFrame, DataFrame | None]:
    """Arcs shuffled and sorted by source once for all rounds, and the hubs among the sources.

    A round's sums come out partitioned by vertex as the next round's join wants them,
    so only one value per vertex and partition moves. A cached side cannot be split
    later, so the arcs of a vertex with more than ``hub_arcs`` are dealt into parts
    ``p`` here; without any hub the part is left out.
    """
    parts = int(arcs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stored = scratch.save(arcs, "arcs")
    hubs = scratch.save(
        stored.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub_arcs)
        .select("s", F.ceil(F.col("n") / hub_arcs).cast("int").alias("parts")), "hubs")
    if hubs.isEmpty():
        return stored.repartition(parts, "s").sortWithinPartitions("s").persist(), None
    part = F.pmod(F.xxhash64("t"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = stored.join(hubs, "s", "left").withColumn("p", part).drop("parts")
    return dealt.repartition(parts, "s", "p").sortWithinPartitions("s", "p").persist(), hubs


def _send(values: DataFrame, arcs: DataFrame, hubs: DataFrame | None) -> DataFrame:
    """Values of the vertices ``s`` along their arcs; a hub's value goes to each of its parts."""
    if hubs is None:
        return arcs.join(values, "s")
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    spread = values.join(hubs, "s", "left").withColumn("p", copies).drop("parts")
    return arcs.join(spread, ["s", "p"])


# --- closeness --------------------------------------------------------------------

# Sources are handled 1024 at a time as 16 columns of 64 bits, which keeps the
# generated aggregation small enough to be compiled.
_LANES = 16
_GROUP = 64 * _LANES


# Rows (vertex, source group) that the searches of one batch may hold, some 300 bytes each;
# a round shuffles some ten times as much.
STATE_ROWS = 4_000_000


def closeness(edges: DataFrame, max_nodes: int | None = None, hub_arcs: int = HUB_ARCS, state_rows: int = STATE_ROWS,
              resume: str | None = None, scratch: Scratch | None = None) -> DataFrame:
    """``(reached - 1) / sum of hops`` within the reachable set; null where isolated.

    All networks are measured; with ``max_nodes``, larger ones get nulls instead.
    Sources are searched in batches, one after the other, so that what is alive at a time
    is bounded by ``state_rows`` whatever the number of vertices; components that are small
    need few batches (``_batches``). In a batch all searches
    run at once: a row ``(vertex, source group)`` holds a bit per source that has reached
    the vertex, and a round ORs the new bits of the neighbours. Distances are symmetric, so
    the bits set at a vertex in round d count the sources at distance d *from it*, and no
    pair is ever listed. A batch leaves one row of totals per vertex.

    ``resume`` names a folder, for these edges alone, where the totals of finished batches
    are kept; a run that was ended goes on behind the last of them.
    """
    scratch = scratch or Scratch(edges.sparkSession, "closeness")
    member = scratch.save(components(edges, scratch), "member")
    nodes = member.select("network", "id")
    sizes = nodes.groupBy("network").agg(F.count(F.lit(1)).alias("n"))
    allowed = F.broadcast((sizes if max_nodes is None else sizes.where(F.col("n") <= max_nodes)).select("network"))

    # Vertices of a component have neighbouring numbers, so few groups have sources in it.
    numbered = scratch.save(dense_id(
        member.join(allowed, "network", "left_semi"), ["network", "component", "id"], "v", 0, scratch), "numbered")
    near = both_ways(edges.where(F.col("source") != F.col("target"))).distinct()
    arcs, hubs = _resident(_renumber(near, numbered), hub_arcs, scratch)
    kept = f"{(resume or scratch.base).rstrip('/')}/totals"
    done = []
    try:
        for first, end in _batches(numbered, state_rows, scratch):
            path = f"{kept}-{first}-{end}"
            if not (resume and _written(edges.sparkSession, path)):
                _search(arcs, hubs, numbered, first, end, scratch).groupBy("v").agg(
                    F.sum("reached").alias("reached"), F.sum("hops").alias("hops")).write.mode("overwrite").parquet(path)
            done.append(path)
    finally:
        arcs.unpersist()
        scratch.drop("arcs", "hubs", "state")
    # One scan of all batches, however many there are.
    totals = edges.sparkSession.read.schema("v bigint, reached bigint, hops bigint").parquet(*done).groupBy("v").agg(
        F.sum("reached").alias("reached"), F.sum("hops").alias("hops")) if done else numbered.select(
        "v", F.lit(0).cast("bigint").alias("reached"), F.lit(0).cast("bigint").alias("hops"))
    value = F.try_divide(F.col("reached").cast("double"), F.col("hops"))
    scored = numbered.join(totals, "v").select("network", "id", value.alias("closeness"))
    return nodes.join(scored, ["network", "id"], "left")


def _batches(numbered: DataFrame, state_rows: int, scratch: Scratch) -> list[tuple[int, int]]:
    """Source groups in batches ``(first, end)`` whose searches hold about ``state_rows`` rows each.

    A search stays in its component, so a source group holds a row for each vertex of the
    components that it has sources in, and one of small components little more than its own.
    """
    spans = numbered.groupBy("network", "component").agg(
        F.count(F.lit(1)).alias("n"), F.floor(F.min("v") / _GROUP).alias("low"), F.floor(F.max("v") / _GROUP).alias("high"))
    held = spans.select("n", F.explode(F.sequence("low", "high")).alias("g")).groupBy("g").agg(F.sum("n").alias("n"))
    # One row per 1024 vertices, so this window over everything is small.
    before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    dealt = held.withColumn("batch", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / F.lit(state_rows)))
    ends = scratch.save(dealt.groupBy("batch").agg(F.min("g").alias("first"), (F.max("g") + 1).alias("end")), "batches")
    return sorted((r.first_, r.end) for r in ends.withColumnRenamed("first", "first_").collect())  # one row per batch


def _written(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def _search(arcs: DataFrame, hubs: DataFrame | None, numbered: DataFrame, first: int, end: int, scratch: Scratch) -> DataFrame:
    """Breadth-first searches from the source groups ``first`` to ``end - 1``: ``(v, g, reached, hops, ...)``."""
    seen = [f"seen{i}" for i in range(_LANES)]
    new = [f"new{i}" for i in range(_LANES)]
    lane = F.floor(F.col("v") / 64).cast("int") % _LANES
    own = F.expr("shiftleft(1L, cast(v % 64 as int))")
    start = [F.when(lane == i, own).otherwise(F.lit(0).cast("bigint")) for i in range(_LANES)]
    sources = numbered.where((F.col("v") >= first * _GROUP) & (F.col("v") < end * _GROUP))
    state = scratch.save(sources.select(
        "v", F.floor(F.col("v") / _GROUP).alias("g"),
        *[s.alias(seen[i]) for i, s in enumerate(start)], *[s.alias(new[i]) for i, s in enumerate(start)],
        F.lit(0).cast("bigint").alias("reached"), F.lit(0).cast("bigint").alias("hops"),
    ), "state")
    zero = F.lit(0).cast("bigint")
    hop = 0
    while True:
        hop += 1
        active = reduce(Column.__or__, [F.col(c) != 0 for c in new])
        heard = (
            _send(state.where(active).select(F.col("v").alias("s"), "g", *new), arcs, hubs)
            .groupBy(F.col("t").alias("v"), "g")
            .agg(*[F.bit_or(c).alias(f"in{i}") for i, c in enumerate(new)])
        )
        met = state.drop(*new).join(heard, ["v", "g"], "full_outer")
        fresh = [
            F.coalesce(f"in{i}", zero).bitwiseAND(F.bitwise_not(F.coalesce(seen[i], zero))) for i in range(_LANES)
        ]
        step = met.select(
            "v", "g", "reached", "hops", *seen, *[f.alias(new[i]) for i, f in enumerate(fresh)])
        gained = reduce(Column.__add__, [F.bit_count(c).cast("bigint") for c in new])
        state, seen_now = scratch.measure(step.select(
            "v", "g",
            *[F.coalesce(seen[i], zero).bitwiseOR(F.col(new[i])).alias(seen[i]) for i in range(_LANES)],
            *new,
            (F.coalesce("reached", zero) + gained).alias("reached"),
            (F.coalesce("hops", zero) + gained * hop).alias("hops"),
        ), "state", F.count_if(active).alias("active"))
        scratch.release()
        if not seen_now["active"]:
            return state


# --- modularity -------------------------------------------------------------------

def modularity(edges: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Weighted modularity per network of ``labels(network, id, <label>)``."""
    named = labels.select("network", F.col("id").alias("source"), F.col(label).alias("cs"))
    other = labels.select("network", F.col("id").alias("target"), F.col(label).alias("ct"))
    joined = edges.join(named, ["network", "source"]).join(other, ["network", "target"])
    w = F.col("weight").cast("double")
    ends = F.explode(F.array(
        F.struct(F.col("cs").alias("c"), w.alias("tot"), F.when(F.col("cs") == F.col("ct"), 2 * w).otherwise(0.0).alias("inside")),
        F.struct(F.col("ct").alias("c"), w.alias("tot"), F.lit(0.0).alias("inside")),
    )).alias("e")
    per = joined.select("network", ends).groupBy("network", "e.c").agg(
        F.sum("e.tot").alias("tot"), F.sum("e.inside").alias("inside"))
    return per.groupBy("network").agg(
        F.sum("tot").alias("all"), F.sum("inside").alias("inside"), F.sum(F.col("tot") * F.col("tot")).alias("squares"),
        F.count(F.lit(1)).alias("n_communities"),
    ).select(
        "network", "n_communities",
        (F.col("inside") / F.col("all") - F.col("squares") / (F.col("all") * F.col("all"))).alias("modularity"),
    )
