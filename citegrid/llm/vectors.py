"""Vectors for search: usable rows, and cells of bounded size in which queries meet rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Candidates and queries of one cell, at most in the mean.
CELL_ROWS = 4096
CELL_QUERIES = 1024
MOST_PARTITIONS = 20_000


def usable(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, vector)`` as double arrays, one row per id.

    Rows without id, without vector, with an empty vector or with a null or non-finite
    component drop out. Of rows that repeat an id the smallest vector counts.
    """
    v = F.col(vector).cast("array<double>")
    return (
        table.select(F.col(vec_id).cast("bigint").alias("vec_id"), v.alias("vector"))
        .where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & (F.size("vector") > 0))
        .where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
        .groupBy("vec_id").agg(F.min("vector").alias("vector")))


def in_cells(rows: DataFrame, is_query: Column, run: Callable[[pa.Table], pa.Table], schema: str, carry: tuple[str, ...] = (),
             cell_rows: int = CELL_ROWS, cell_queries: int = CELL_QUERIES) -> DataFrame:
    """Run ``run`` on every pair of a block of rows and a block of queries.

    Rows are dealt into blocks by a hash of their id, so that a cell holds about
    ``cell_rows`` rows and ``cell_queries`` queries whatever the size of the table;
    vectors of different lengths do not meet. ``run`` gets ``role`` 0 for rows, 1 for
    queries, and returns a few rows per query. The number of partitions follows the cells:
    their bytes say nothing about the work, so they must not be put together by size.
    """
    rows = rows.withColumn("dim", F.size("vector")).withColumn("asks", is_query)
    blocks = rows.groupBy("dim").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(cell_rows)).cast("int").alias("row_blocks"),
        F.ceil(F.sum(F.col("asks").cast("int")) / F.lit(cell_queries)).cast("int").alias("query_blocks"))
    cells = blocks.agg(F.sum(F.col("row_blocks").cast("bigint") * F.col("query_blocks"))).first()[0] or 0
    dealt = rows.join(blocks.where("query_blocks > 0"), "dim").withColumn("turn", F.xxhash64("vec_id"))
    keep = ["vec_id", "vector", *carry]
    met = dealt.select(
        "dim", F.pmod("turn", "row_blocks").cast("int").alias("r"),
        F.explode(F.expr("sequence(0, query_blocks - 1)")).alias("q"), F.lit(0).alias("role"), *keep)
    asked = dealt.where("asks").select(
        "dim", F.explode(F.expr("sequence(0, row_blocks - 1)")).alias("r"),
        F.pmod("turn", "query_blocks").cast("int").alias("q"), F.lit(1).alias("role"), *keep)
    return (met.unionByName(asked).repartition(min(max(2 * cells, 1), MOST_PARTITIONS), "dim", "r", "q")
            .groupBy("dim", "r", "q").applyInArrow(run, schema))


def matrix(column: pa.ChunkedArray, n: int) -> np.ndarray:
    """Lists of equal length as rows."""
    flat = column.combine_chunks()
    if isinstance(flat, pa.ChunkedArray):
        flat = pa.concat_arrays(flat.chunks)
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def sides(table: pa.Table, *columns: str):
    """(ids, matrices...) of the rows, then of the queries, both by ascending id."""
    out = []
    for role in (0, 1):
        part = table.filter(pa.compute.equal(table["role"], role)).sort_by("vec_id")
        out.append((part["vec_id"].to_numpy(), *[matrix(part[c], part.num_rows) if part.num_rows else None
                                                 for c in columns]))
    return out
