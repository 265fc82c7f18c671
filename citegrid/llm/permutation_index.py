"""Approximate nearest neighbours by a permutation index (Amato, Savino, 2008).

A vector is represented by its nearest pivots, in order of distance. Pivots are drawn
from the distinct vectors (the first ``pivots`` in hash order); every row is indexed. Blocks of rows keep an inverted file per pivot with the rows that have it among
their nearest and its position there. A query reads the files of its own nearest pivots
and ranks the rows it meets by Spearman's footrule between the two orders, a pivot that
one side lacks counting as just behind its last. Copies of one vector are ranked as one,
so that they take one place in a block however many they are. Each block is ranked again by
cosine, slice by slice in the order of footrules (of equal ones smaller ids first), until
several slices in a row bring nothing among the block's nearest; there is no other end
but that of the block. The best of all blocks are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.llm.topk_nra import best_of
from citegrid.llm.vectors import in_cells, matrix, sides, usable
from citegrid.session import Scratch

K = 5
PIVOTS = 256
PREFIX = 64
# Share of a block in a slice that is ranked again, at least so many rows, and how many
# slices in a row that bring nothing new end it.
SHARE, LEAST, PATIENCE = 0.05, 100, 3


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, scaled by their largest component first so that squares stay finite."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True) + 0.0  # no negative zeros


def _copies(rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First row of each distinct vector, ascending, and its first ``most`` rows (-1 where it has fewer)."""
    n = len(rows)
    octets = np.ascontiguousarray(rows).view(f"V{rows.itemsize * rows.shape[1]}").ravel()
    _, lead, group = np.unique(octets, return_index=True, return_inverse=True)
    place = np.empty(len(lead), np.int64)
    place[np.argsort(lead)] = np.arange(len(lead))
    group = place[group.ravel()]
    order = np.argsort(group, kind="stable")
    nth = np.arange(n) - np.searchsorted(group[order], group[order])
    few = nth < most
    members = np.full((len(lead), most), -1, np.int64)
    members[group[order][few], nth[few]] = order[few]
    return members[:, 0], members


def _represent(pivots: dict[int, np.ndarray], prefix: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            near: list = [None] * n
            vectors = batch.column(1)
            sizes = np.diff(vectors.offsets.to_numpy())
            for dim in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dim)
                x = _unit(matrix(pa.chunked_array([vectors.take(pa.array(at))]), len(at)))
                known = pivots[dim]
                order = np.argsort(-(x @ known.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)
                for i, o in zip(at.tolist(), order):
                    near[i] = o
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), vectors, pa.array(near, pa.list_(pa.int32()))], names=["vec_id", "vector", "near"])
    return run


def footrule_gain(files, order: np.ndarray, n: int, prefix: int) -> np.ndarray:
    """How much smaller than its maximum the footrule of each row is, read from inverted files.

    A pivot at position i of one order and j of the other saves 2 * min(l - i, l - j)
    against being absent from both, where l is the length of the orders.
    """
    gain = np.zeros(n, np.int32)
    for i, pivot in enumerate(order.tolist()):
        rows, left = files[pivot]
        gain[rows] += np.minimum(prefix - i, left)
    return 2 * gain


def _cell(k: int, share: float, least: int, patience: int):
    def run(table: pa.Table) -> pa.Table:
        (ids, rows, near), (query_ids, queries, asked) = sides(table, "vector", "near")
        out: list[list] = [[], [], []]
        if len(ids) and len(query_ids):
            rows, queries = _unit(rows), _unit(queries)
            # Of each vector only the smallest ids, besides the query's own, can be among the k first.
            lead, members = _copies(rows, k + 1)
            rows, near = rows[lead], near[lead]
            n, prefix = near.shape
            step = min(n, max(least, int(np.ceil(share * n))))
            # Postings of each pivot: rows, and prefix minus position.
            flat = near.ravel()
            order = np.argsort(flat, kind="stable")
            cut = np.searchsorted(flat[order], np.arange(max(flat.max(), asked.max()) + 2))
            files = [(order[a:b] // prefix, (prefix - order[a:b] % prefix).astype(np.int32))
                     for a, b in zip(cut[:-1], cut[1:])]
            for q in range(len(query_ids)):
                by_footrule = np.argsort(-footrule_gain(files, asked[q], n, prefix), kind="stable")
                at, score, idle = np.empty(0, np.int64), np.empty(0), 0
                for a in range(0, n, step):
                    part = by_footrule[a:a + step]
                    # Summed row by row: a matrix product may round copies differently.
                    fresh = (rows[part] * queries[q]).sum(axis=1)
                    # One more than k, as the query's own vector may be among them.
                    kth = np.partition(score, -k - 1)[-k - 1] if len(score) > k else -np.inf
                    idle = 0 if (fresh > kth).any() else idle + 1
                    at, score = np.concatenate([at, part]), np.concatenate([score, fresh])
                    if idle == patience:
                        break
                # Each vector but the query's own has a candidate.
                top = np.lexsort((at, -score))[:k + 1]
                found, score = members[at[top]].ravel(), np.repeat(score[top], k + 1)
                other = (found >= 0) & (ids[found] != query_ids[q])
                found, score = found[other], score[other]
                first = np.lexsort((ids[found], -score))[:k]
                out[0] += [query_ids[q]] * len(first)
                out[1] += ids[found[first]].tolist()
                out[2] += score[first].tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.float64())})
    return run


def nearest(table: DataFrame, k: int = K, every: int = 50, pivots: int = PIVOTS, prefix: int = PREFIX,
            share: float = SHARE, least: int = LEAST, patience: int = PATIENCE, scratch: Scratch | None = None, **cells) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; queries are rows whose id is divisible by ``every``.

    The score is the cosine in double precision. A query's own id is no candidate; with
    fewer than ``k`` candidates all are returned. Vectors that are null, empty, zero or
    hold null or non-finite components take no part; a vector meets those of its own
    length. Rows that repeat an id count once. Ties go to the smaller id. An empty table
    gives an empty result; further columns are not read.
    """
    scratch = scratch or Scratch(table.sparkSession, "permutation-index")
    rows = scratch.save(usable(table).where(F.exists("vector", lambda x: x != 0.0)), "rows")
    dims = [r["dim"] for r in rows.select(F.size("vector").alias("dim")).distinct().collect()]
    known = {}
    for dim in dims:  # one length in all ordinary tables
        # Hashes alone are made distinct, so that no vectors travel but those drawn.
        hashed = rows.where(F.size("vector") == dim).withColumn("h", F.xxhash64("vector"))
        first = [r["h"] for r in hashed.select("h").distinct().orderBy("h").limit(pivots).collect()]
        drawn = hashed.where(F.col("h").isin(first)).groupBy("h").agg(F.min("vector").alias("vector")).orderBy("h").collect()
        known[dim] = _unit(np.array([r["vector"] for r in drawn]))
    # Lengths with few rows have few pivots; orders of one length are equally long.
    indexed = rows.mapInArrow(_represent(known, prefix), "vec_id bigint, vector array<double>, near array<int>")
    found = in_cells(indexed, F.col("vec_id") % every == 0, _cell(k, share, least, patience),
                     "query_id bigint, vec_id bigint, score double", ("near",), **cells)
    return best_of(found, k)
