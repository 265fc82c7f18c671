"""Exact top-k inner products by no-random-access aggregation (Fagin, Lotem, Naor, 2001).

Every component has a list of all rows sorted by it. For a query, a list is read from
the top where the query's component is positive and from the bottom where it is
negative, so contributions only fall. Lists are read slice by slice. A row's score lies
between two bounds: its contributions seen so far plus, for each list in which it has
not come up, the least that the list holds or the value at which reading stands. Rows
whose upper bound is below the k-th lower bound are out; a query stops when no more than
k rows are left or its lists are read to the end, and the rows left get their scores.

Bounds are doubles and leave room for rounding. Scores are integers: doubles where no sum
can reach 2^53, 64-bit integers below 2^63, Python's beyond; a score that 64 bits cannot
hold counts as the nearest one that they can. Rows and queries with components of
``HUGE`` or more have no useful bounds in doubles and are scored one by one.

Lists are kept per block of rows, and the queries of a cell read them in step. Each cell
returns k rows per query; the best k of those are the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citegrid.llm.vectors import in_cells, sides, usable

K = 10
SCALE = 1024
# Where slices of the lists end, as shares of their length.
DEPTHS = (0.0625, 0.125, 0.25, 0.5, 1.0)
# Components from here on could overflow a bound.
HUGE = 2.0 ** 400
LEAST_LONG, MOST_LONG = -2**63, 2**63 - 1


def scaled(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in doubles, exact unless infinite; ``scale`` is a power of two."""
    with np.errstate(over="ignore"):
        return np.floor(x * float(scale))


def _integer(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


def exact_scores(rows: np.ndarray, query: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of scaled vectors as 64-bit integers."""
    x, y = scaled(rows, scale), scaled(query, scale)
    with np.errstate(over="ignore", invalid="ignore"):
        most = len(query) * np.abs(x).max(initial=0.0) * np.abs(y).max(initial=0.0)
    if most < 2.0**52:
        return (x @ y).astype(np.int64)
    if most < 2.0**62:
        return x.astype(np.int64) @ y.astype(np.int64)
    q = [_integer(v, scale) for v in query.tolist()]
    sums = (sum(a * b for a, b in zip((_integer(v, scale) for v in row), q)) for row in rows.tolist())
    return np.array([min(max(s, LEAST_LONG), MOST_LONG) for s in sums], np.int64)


def _first(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    # Scores may be the least long, whose negative does not exist.
    return np.lexsort((ids, ~score))[:k]


def best_rows(rows: np.ndarray, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int,
              depths: tuple[float, ...] = DEPTHS, scale: int = SCALE):
    """(query index, row index, score) of the k best rows of each query, own id left out.

    ``rows`` and ``queries`` are the vectors as they were given.
    """
    x, y = scaled(rows, scale), scaled(queries, scale)
    wild = np.abs(x).max(axis=1) >= HUGE
    plain, always = np.flatnonzero(~wild), np.flatnonzero(wild)
    going = np.flatnonzero(np.abs(y).max(axis=1) < HUGE)
    found = []

    def settle(q: int, at: np.ndarray) -> None:
        at = np.concatenate([at, always])
        at = at[ids[at] != query_ids[q]]
        score = exact_scores(rows[at], queries[q], scale)
        first = _first(ids[at], score, k)
        found.extend((q, j, int(s)) for j, s in zip(at[first].tolist(), score[first].tolist()))

    for q in np.setdiff1d(np.arange(len(y)), going).tolist():
        settle(q, plain)
    x, n = x[plain], len(plain)
    if n == 0:
        for q in going.tolist():
            settle(q, plain)
        return found
    order = np.argsort(x, axis=0, kind="stable")
    place = np.empty(x.shape, np.int64)
    np.put_along_axis(place, order, np.arange(n)[:, None], axis=0)
    rising = np.take_along_axis(x, order, axis=0)
    least, most = rising[0], rising[-1]
    up, down = np.maximum(y[going], 0.0), np.minimum(y[going], 0.0)
    own = query_ids[going][:, None] == ids[plain][None, :]
    # All sums and products of a bound are rounded some 4 * dim times.
    room = 4e-16 * x.shape[1] * (np.abs(y[going]) @ np.abs(x).max(axis=0)) * 4
    base = (up @ least + down @ most)[:, None]
    for share in depths:
        t = min(n, max(1, int(np.ceil(share * n))))
        top, low = place >= n - t, place < t
        # What has been read counts in place of the least that its list holds; the rest is
        # at most where reading stands. Products of matrices do this for all lists at once.
        lower = base + up @ np.where(top, x - least, 0.0).T + down @ np.where(low, x - most, 0.0).T
        stand_up, stand_down = up * (rising[n - t] - least), down * (rising[t - 1] - most)
        upper = lower + stand_up @ (~top).astype(float).T + stand_down @ (~low).astype(float).T + room[:, None]
        kth = np.partition(np.where(own, -np.inf, lower), max(n - k, 0), axis=1)[:, max(n - k, 0)] - room
        # Beyond 64 bits scores are alike.
        left = (np.clip(upper, LEAST_LONG, MOST_LONG) >= np.clip(kth, LEAST_LONG, MOST_LONG)[:, None]) & ~own
        done = (left.sum(axis=1) <= k) | (t == n)
        for i in np.flatnonzero(done).tolist():
            settle(int(going[i]), plain[left[i]])
        going, up, down, own, room, base = (a[~done] for a in (going, up, down, own, room, base))
        if len(going) == 0:
            break
    return found


def _cell(k: int, scale: int):
    def run(table: pa.Table) -> pa.Table:
        (ids, rows), (query_ids, queries) = sides(table, "vector")
        found = best_rows(rows, ids, queries, query_ids, k, scale=scale) if len(ids) and len(query_ids) else []
        return pa.table({
            "query_id": pa.array([query_ids[q] for q, _, _ in found], pa.int64()),
            "vec_id": pa.array([ids[j] for _, j, _ in found], pa.int64()),
            "score": pa.array([s for _, _, s in found], pa.int64())})
    return run


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k first per query by score, ties to the smaller id."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def top_inner_products(table: DataFrame, k: int = K, every: int = 100, scale: int = SCALE, **cells) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; queries are rows whose id is divisible by ``every``.

    Components become floor(scale * x), ``scale`` being a power of two; a score beyond 64
    bits becomes the nearest 64-bit integer, and such ties go to the smaller id. A query's own id is no candidate; with fewer than
    ``k`` candidates all are returned. Vectors that are null, empty or hold null or
    non-finite components take no part; a vector meets those of its own length. Rows that
    repeat an id count once. An empty table gives an empty result; further columns are
    not read.
    """
    found = in_cells(usable(table), F.col("vec_id") % every == 0, _cell(k, scale), "query_id bigint, vec_id bigint, score bigint", **cells)
    return best_of(found, k)
