"""Louvain and Leiden on a network that one task holds, all levels in arrays.

An edge lies in the graph from both ends, 8 to 12 bytes each, ordered by vertex and far
end, and vertices are known by their place among the sorted ids. Levels of few arcs move
their vertices one after the other; larger ones look at a slice of them at a time, find
their best communities with numpy, and then move them one after the other too. A vertex
waits if a neighbour in its slice goes first, and a move that others of the slice have
made bad is put off, so that every move raises modularity, and a level is at rest when no
vertex beside a moved one gains.
"""

from __future__ import annotations

from array import array
from collections import deque
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

EPS = 1e-12
# Arcs of a level that is moved vertex by vertex in Python, some 2 microseconds an arc.
FEW_ARCS = 1 << 19
# Arcs of a slice.
SLICE_ARCS = 1 << 18
# Edges packed in one row.
PACKED_ROWS = 1 << 18


def turn_order(vertices: np.ndarray, seed: int) -> np.ndarray:
    """Positions of the vertices in an order drawn by hash."""
    digest = xxhash.xxh3_64_intdigest
    return np.argsort(np.fromiter(
        (digest(int(v).to_bytes(8, "little", signed=True), seed) for v in vertices.tolist()), np.uint64, len(vertices)), kind="stable")


def best_target(weights: dict[int, float], tot: list[float], k: float, m2: float, name: list[int], here: int):
    """(gain, community) of the best other community; ties go to the smaller name."""
    top, to = float("-inf"), -1
    for c, w in weights.items():
        if c != here:
            gain = w - k * tot[c] / m2
            if gain > top or (gain == top and name[c] < name[to]):
                top, to = gain, c
    return top, to


def move_vertices(k: list[float], label: list[int], arcs: Callable[[int], Iterable[tuple[int, int, float]]],
                  tot: list[float], name: list[int], m2: float, first: list[int]) -> None:
    """Move vertices to their best neighbouring community until none of them gains.

    ``arcs`` gives (vertex or -1, community of a vertex outside the block, weight) for a vertex.
    ``label`` and ``tot`` are changed in place. A vertex is looked at again after a neighbour left.
    """
    queue, waiting = deque(first), [False] * len(k)
    for v in first:
        waiting[v] = True
    while queue:
        v = queue.popleft()
        waiting[v] = False
        weights: dict[int, float] = {}
        for u, c, w in arcs(v):
            c = label[u] if u >= 0 else c
            weights[c] = weights.get(c, 0.0) + w
        here = label[v]
        gain, to = best_target(weights, tot, k[v], m2, name, here)
        if to < 0 or gain <= weights.get(here, 0.0) - k[v] * (tot[here] - k[v]) / m2 + EPS * k[v]:
            continue
        tot[here] -= k[v]
        tot[to] += k[v]
        label[v] = to
        for u, _, _ in arcs(v):
            if u >= 0 and label[u] != to and not waiting[u]:
                queue.append(u)
                waiting[u] = True


def refine_parts(v_: np.ndarray, k_: np.ndarray, bound_: np.ndarray, whole_: np.ndarray, c_: np.ndarray,
                 near: Callable[[int], Iterable[tuple[int, float]]], m2: float, seed: int) -> np.ndarray:
    """Part of each vertex, as a vertex: every one starts alone and may join a neighbour's part once.

    ``near`` gives (vertex or -1, weight) for the arcs of a vertex inside its community, ``bound``
    their sum and ``whole`` the community's total.
    """
    n = len(v_)
    k, bound, whole, tot, open_ = (array("d", np.ascontiguousarray(x, np.float64).tobytes()) for x in (k_, bound_, whole_, k_, bound_))
    c, name, part = (array("q", np.ascontiguousarray(x, np.int64).tobytes()) for x in (c_, v_, np.arange(n)))
    size, within = array("i", [1]) * n, array("d", [0.0]) * n

    def linked(cut: float, weight: float, all_: float) -> bool:
        return cut >= weight * (all_ - weight) / m2 - EPS

    for v in turn_order(v_, seed).tolist() if m2 > 0 else []:
        if size[part[v]] > 1 or not linked(bound[v], k[v], whole[v]):
            continue
        weights: dict[int, float] = {}
        for u, w in near(v):
            if u >= 0 and c[u] == c[v] and part[u] != part[v]:
                weights[part[u]] = weights.get(part[u], 0.0) + w
        weights = {p: w for p, w in weights.items() if linked(open_[p] - within[p], tot[p], whole[v])}
        gain, to = best_target(weights, tot, k[v], m2, name, -1)
        if to < 0 or gain <= EPS:
            continue
        within[to] += 2 * weights[to]
        tot[to] += k[v]
        open_[to] += bound[v]
        size[to] += 1
        size[v] = 0
        part[v] = to
    return np.array(part, np.int64)


# --- packed edges -------------------------------------------------------------------

def _slim(w: np.ndarray) -> np.ndarray:
    """Half the bytes if that changes no weight."""
    short = w.astype(np.float32)
    return short if np.array_equal(short, w) else w


def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``(network, a, b, w)`` as one row per network and ``PACKED_ROWS``: ``(network, n, a, b, w)``."""
    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        network = table["network"].combine_chunks().dictionary_encode()
        a, b, w = (table[c].to_numpy() for c in ("a", "b", "w"))
        codes, out = network.indices.to_numpy(), []
        for code, name in enumerate(network.dictionary.to_pylist()):
            at = codes == code
            out.append((name, int(at.sum()), a[at].tobytes(), b[at].tobytes(), _slim(w[at]).tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array(x, kind) for x, kind in zip(zip(*out), (pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
            names=["network", "n", "a", "b", "w"])

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


def _slices(cut: np.ndarray) -> Iterator[tuple[int, int, slice, np.ndarray]]:
    """Vertices ``lo:hi`` of about ``SLICE_ARCS`` arcs, the places of these and the vertex of each, from 0."""
    lo, n = 0, len(cut) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(cut, cut[lo] + SLICE_ARCS, "right")) - 1))
        yield lo, hi, slice(int(cut[lo]), int(cut[hi])), np.repeat(np.arange(hi - lo), np.diff(cut[lo:hi + 1]))
        lo = hi


class Graph:
    """A level: sorted ``ids``, weight ``k`` of each vertex and ``own`` inside it, arcs ``cut[v]:cut[v + 1]``."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, cut: np.ndarray, to: np.ndarray, w: np.ndarray):
        self.ids, self.own, self.cut, self.to, self.w = ids, own, cut, to, w
        self.k = own.copy()
        for lo, hi, at, row in _slices(cut):
            self.k[lo:hi] += np.bincount(row, self.w[at], hi - lo)

    def arcs_of(self, vertices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the arcs of some vertices, and the place of each one's vertex among these."""
        start, many = self.cut[vertices], self.cut[vertices + 1] - self.cut[vertices]
        row = np.repeat(np.arange(len(vertices)), many)
        return np.arange(len(row)) + np.repeat(start - np.cumsum(many) + many, many), row


def _packs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for a, b, w, n in zip(rows["a"], rows["b"], rows["w"], rows["n"].to_pylist()):
        w = w.as_buffer()
        yield (np.frombuffer(a.as_buffer(), np.int64), np.frombuffer(b.as_buffer(), np.int64),
               np.frombuffer(w, np.float32 if w.size == 4 * n else np.float64))


def read_graph(rows: pa.Table) -> Graph:
    """Packed edges of one network, each pair once; ``(v, v, w)`` is a loop and may have no weight."""
    ids = np.unique(np.concatenate([np.unique(np.concatenate(p[:2])) for p in _packs(rows)]))
    own, many = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
    placed, kind = [], np.float32
    for a, b, w in _packs(rows):
        a, b = np.searchsorted(ids, a).astype(np.int32), np.searchsorted(ids, b).astype(np.int32)
        loop = a == b
        np.add.at(own, a[loop], 2.0 * w[loop])
        placed.append((a[~loop], b[~loop], w[~loop]))
        many += np.bincount(a[~loop], minlength=len(ids)) + np.bincount(b[~loop], minlength=len(ids))
        kind = np.float64 if w.dtype == np.float64 else kind
    cut = np.concatenate([[0], np.cumsum(many)])
    to, weight, free = np.empty(cut[-1], np.int32), np.empty(cut[-1], kind), cut[:-1].copy()
    while placed:
        a, b, w = placed.pop()
        for src, dst in ((a, b), (b, a)):
            order = np.argsort(src, kind="stable")
            of = src[order]
            count = np.bincount(of, minlength=len(ids))
            place = np.repeat(free - np.cumsum(count) + count, count) + np.arange(len(of))
            to[place], weight[place] = dst[order], w[order]
            free += count
    for _, _, at, row in _slices(cut):
        order = np.argsort(row * len(ids) + to[at], kind="stable")
        to[at], weight[at] = to[at][order], weight[at][order]
    return Graph(ids, own, cut, to, weight)


# --- levels --------------------------------------------------------------------------

def _grouped(row: np.ndarray, label: np.ndarray, width: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, label, sum of w)`` of each pair that occurs, in order."""
    key, places = row * np.int64(width) + label, max(len(row) - 1, 1).bit_length()
    if not len(key):
        return key, key, np.zeros(0)
    if int(key[-1] // width + 1) * width < 1 << (62 - places):  # sorting numbers is faster than sorting their places
        key = np.sort(key << places | np.arange(len(key)))
        order, key = key & ((1 << places) - 1), key >> places
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key = key[start]
    row = key // width
    return row, key - row * width, np.add.reduceat(w[order].astype(np.float64, copy=False), start)


def _cut_by(many: np.ndarray, most: int) -> list[int]:
    """Ends of slices of about ``most`` arcs."""
    total = np.cumsum(many)
    steps = np.flatnonzero(np.diff((total - many) // most)) + 1
    return [*steps.tolist(), len(many)]


def _move_slices(graph: Graph, label: np.ndarray, tot: np.ndarray, m2: float, order: np.ndarray) -> None:
    """``move_vertices`` by slices; ``label`` and ``tot`` are changed in place."""
    n, width, k = len(graph.ids), len(tot), graph.k
    many = np.diff(graph.cut)
    waiting, place = many > 0, np.full(n, -1, np.int32)
    totals = array("d", tot.tobytes())
    tot_now = np.frombuffer(totals)
    while (todo := order[waiting[order]]).size:
        lo = 0
        for hi in _cut_by(many[todo], SLICE_ARCS):
            vs, lo = todo[lo:hi], hi
            waiting[vs] = False
            at, row = graph.arcs_of(vs)
            far = graph.to[at]
            r, c, s = _grouped(row, label[far], width, graph.w[at])
            here, kv = label[vs], k[vs]
            mine = c == here[r]
            stay = np.zeros(len(vs))
            stay[r[mine]] = s[mine]
            gain = np.where(mine, -np.inf, s - kv[r] * tot_now[c] / m2)
            first = np.searchsorted(r, np.arange(len(vs)))
            top = np.maximum.reduceat(gain, first)
            best = np.flatnonzero(gain == top[r])
            best = best[np.concatenate([[True], r[best[1:]] != r[best[:-1]]])]  # ties go to the smaller name
            going = top > stay - kv * (tot_now[here] - kv) / m2 + EPS * kv
            if not going.any():
                continue
            movers = np.flatnonzero(going)
            # Of two neighbours in a slice only the first goes now.
            place[vs[movers]] = movers
            near = place[far]
            late = np.zeros(len(vs), bool)
            late[row[(near >= 0) & (near < row) & going[row]]] = True
            place[vs[movers]] = -1
            waiting[vs[movers[late[movers]]]] = True
            movers = movers[~late[movers]]
            done = []
            for i, t, h, x, w_to, w_here in zip(
                    movers.tolist(), c[best[movers]].tolist(), here[movers].tolist(), kv[movers].tolist(),
                    s[best[movers]].tolist(), stay[movers].tolist()):
                if w_to - x * totals[t] / m2 > w_here - x * (totals[h] - x) / m2 + EPS * x:
                    totals[h] -= x
                    totals[t] += x
                    done.append(i)
                else:
                    waiting[vs[i]] = True
            if done:
                moved = np.zeros(len(vs), bool)
                moved[done] = True
                label[vs[moved]] = c[best[moved]]
                beside = moved[row]
                left, new = far[beside], label[vs[row[beside]]]
                waiting[left[label[left] != new]] = True
    tot[:] = tot_now


def _local(graph: Graph, c: np.ndarray, m2: float, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Communities at rest, as places among their names, the names, and modularity."""
    name, label = np.unique(c, return_inverse=True)
    tot = np.bincount(label, graph.k, len(name))
    if m2 > 0:
        order = turn_order(graph.ids, seed)
        if len(graph.to) <= FEW_ARCS:
            now, sums, cut = label.tolist(), tot.tolist(), graph.cut.tolist()
            to, w = graph.to, graph.w
            move_vertices(graph.k.tolist(), now, lambda v: [(u, -1, x) for u, x in zip(
                to[cut[v]:cut[v + 1]].tolist(), w[cut[v]:cut[v + 1]].tolist())], sums, name.tolist(), m2, order.tolist())
            label, tot = np.array(now, np.int64), np.array(sums)
        else:
            label = label.astype(np.int32)
            _move_slices(graph, label, tot, m2, order)
    inside = float(graph.own.sum())
    for lo, hi, at, row in _slices(graph.cut):
        inside += float(graph.w[at][label[graph.to[at]] == label[lo:hi][row]].sum(dtype=np.float64))
    tot = np.bincount(label, graph.k, len(name))
    return label, name, inside / m2 - float((tot * tot).sum()) / m2 ** 2 if m2 else 0.0


def _contract(graph: Graph, label: np.ndarray) -> tuple[Graph, np.ndarray]:
    """The graph between groups, each named by its smallest vertex, and the new place of each vertex."""
    _, first, group = np.unique(label, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    at = rank[group]
    ids = graph.ids[np.sort(first)]
    own, n = np.bincount(at, graph.own, len(ids)), len(ids)
    by_group, many = np.argsort(at, kind="stable"), np.diff(graph.cut)
    # Slices end between groups, so that every pair of groups is summed once.
    ends = np.cumsum(np.bincount(at, minlength=n))
    sizes, lo, to, w, count = np.bincount(at, many, n).astype(np.int64), 0, [], [], np.zeros(n, np.int64)
    for hi in _cut_by(sizes, SLICE_ARCS):
        vs = by_group[ends[lo - 1] if lo else 0:ends[hi - 1]]
        places, row = graph.arcs_of(vs)
        r, c, s = _grouped(at[vs][row] - lo, at[graph.to[places]], n, graph.w[places])
        loop = c == r + lo
        own[r[loop] + lo] += s[loop]
        to.append(c[~loop].astype(np.int32))
        w.append(_slim(s[~loop]))
        count[lo:hi] = np.bincount(r[~loop], minlength=hi - lo)
        lo = hi
    kind = np.result_type(*w)
    return Graph(ids, own, np.concatenate([[0], np.cumsum(count)]), np.concatenate(to), np.concatenate(w).astype(kind, copy=False)), at


def _refined(graph: Graph, label: np.ndarray, m2: float, seed: int) -> np.ndarray:
    """Well-connected parts of the communities, as one of their vertices each."""
    n = len(graph.ids)
    to, w, bound, many = [], [], np.zeros(n), np.zeros(n, np.int64)
    for lo, hi, at, row in _slices(graph.cut):
        same = label[graph.to[at]] == label[lo:hi][row]
        to.append(graph.to[at][same])
        w.append(graph.w[at][same])
        bound[lo:hi] = np.bincount(row[same], w[-1], hi - lo)
        many[lo:hi] = np.bincount(row[same], minlength=hi - lo)
    to, w, cut = np.concatenate(to), np.concatenate(w), np.concatenate([[0], np.cumsum(many)]).tolist()
    whole = np.bincount(label, graph.k)[label]
    return refine_parts(graph.ids, graph.k, bound, whole, label, lambda v: zip(
        to[cut[v]:cut[v + 1]].tolist(), w[cut[v]:cut[v + 1]].tolist()), m2, seed)


def _connected(rows: pa.Table, ids: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The smallest vertex of each vertex' connected part of its community."""
    ends = []
    for a, b, _ in _packs(rows):
        a, b = np.searchsorted(ids, a).astype(np.int32), np.searchsorted(ids, b).astype(np.int32)
        inside = (label[a] == label[b]) & (a != b)
        ends.append((a[inside], b[inside]))
    a, b = (np.concatenate([e[i] for e in ends]) for i in (0, 1))
    root = np.arange(len(ids))
    while len(a):
        # Links between trees hang the larger root under the smallest beside it.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(above := root[root], root):
            root = above
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def whole_network(seed: int, max_levels: int, min_gain: float, refine: bool):
    """All levels of a network: ``(network, id, label)``, a label being the smallest member of its community.

    With ``refine`` communities that are not connected are split.
    """
    def run(rows: pa.Table) -> pa.Table:
        graph = read_graph(rows)
        every, at = graph.ids, np.arange(len(graph.ids))
        m2, c, final, reached = float(graph.k.sum()), graph.ids, at, float("-inf")
        for level in range(max_levels):
            label, name, quality = _local(graph, c, m2, seed + 1000 * level)
            if not quality - reached >= min_gain:
                break
            reached, final = quality, label[at]
            if refine:
                part = _refined(graph, label, m2, seed + 1000 * level)
                held = name[label]
                graph, step = _contract(graph, part)
                c = np.empty(len(graph.ids), np.int64)
                c[step] = held
            else:
                graph, step = _contract(graph, label)
                c = graph.ids
            at = step[at]
        else:
            raise RuntimeError(f"communities did not end in {max_levels} levels")
        if refine:
            final = _connected(rows, every, final)
        _, first, group = np.unique(final, return_index=True, return_inverse=True)
        network = rows["network"][0].as_py()
        return pa.table({"network": pa.array([network], pa.string()).take(pa.array(np.zeros(len(every), np.int64))),
                         "id": every, "label": every[first][group]})
    return run
