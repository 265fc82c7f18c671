"""Joins that stay balanced when a single key holds a large share of the rows.

Work in a join on one key grows with the product of both sides, so a key is
split by its row count and not by its bytes: its rows are dealt into blocks of
about ``block_rows`` and every pair of blocks becomes a join key of its own.
No row and no partner is dropped; keys below the limit form a single block, so a
cell makes about ``block_rows`` squared pairs at most. The counts of all keys also give
the number of pairs, and that the number of partitions: about ``TASK_PAIRS`` for a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from citegrid.session import Scratch

BLOCK_ROWS = 2_000
# A task sums its pairs in a hash table, some 300 bytes each.
TASK_PAIRS = 1_000_000
# Keys that the pairs of one item may come from before they are dealt to several tasks.
HEAVY_KEYS = 10_000
# Partitions that a shuffle may have; beyond it tasks make more pairs each.
MOST_TASKS = 50_000


def _blocks(n: Column, block_rows: int) -> Column:
    return F.ceil(n / F.lit(block_rows)).cast("int")


def _block_of(item: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(item), blocks).cast("int")


def tasks_for(spark: SparkSession, pairs: float) -> int:
    """Partitions for so many pairs, at least the session's number."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MOST_TASKS, int(pairs // TASK_PAIRS) + 1))


def _histogram(sizes: DataFrame, pairs: Column, hot: Column, *columns: Column) -> tuple[DataFrame, int]:
    """The ``columns`` of hot keys as a table of its own, and the partitions for the pairs of all keys.

    Both come from one pass over the sizes. A join against an aggregate on the same key cannot be split by the planner, so the
    rows of a hub would meet in one task before they are dealt into blocks. Against a
    stored table, mostly empty, the join is a broadcast or one that can be split.
    """
    spark, seen = sizes.sparkSession, Observation()
    counted = sizes.observe(seen, F.sum(pairs).alias("pairs"))
    table = Scratch(spark, "hot-keys").save(counted.where(hot).select(*columns), "hot")
    return table, tasks_for(spark, seen.get.get("pairs") or 0)


def _spread(side: DataFrame, tasks: int, *cell: str) -> DataFrame:
    """A fixed number of partitions ahead of an expanding join.

    Partition coalescing looks at the bytes going in, which say nothing about the
    pairs coming out; an explicit number is left alone.
    """
    return side.repartition(tasks, *cell)


def pairs_within(rows: DataFrame, key: str, item: str, carry: tuple[str, ...] = (),
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Unordered pairs of different ``item`` values that share a ``key``.

    Returns ``source < target`` plus, for each carried column ``c``, ``c_source``
    and ``c_target``. A key's blocks are paired once each (low, high), so every
    pair of items meets exactly once per pair of input rows.
    """
    n = F.col("n").cast("double")
    hot, tasks = _histogram(
        rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), n * (n - 1) / 2,
        F.col("n") > block_rows, F.col(key), _blocks(F.col("n"), block_rows).alias("blocks"))
    dealt = (
        rows.join(hot, key, "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", _block_of(F.col(item), F.col("blocks")))
    )
    low = dealt.select(
        key, F.col("block").alias("lo"),
        F.explode(F.sequence("block", F.col("blocks") - 1)).alias("hi"),
        F.col(item).alias("item_l"), *[F.col(c).alias(f"{c}_l") for c in carry],
    )
    high = dealt.select(
        key, F.explode(F.sequence(F.lit(0), F.col("block"))).alias("lo"),
        F.col("block").alias("hi"),
        F.col(item).alias("item_r"), *[F.col(c).alias(f"{c}_r") for c in carry],
    )
    met = _spread(low, tasks, key, "lo", "hi").join(_spread(high, tasks, key, "lo", "hi"), [key, "lo", "hi"]).where(
        ((F.col("lo") < F.col("hi")) & (F.col("item_l") != F.col("item_r")))
        | ((F.col("lo") == F.col("hi")) & (F.col("item_l") < F.col("item_r")))
    )
    swapped = F.col("item_l") > F.col("item_r")
    return met.select(
        F.least("item_l", "item_r").alias("source"),
        F.greatest("item_l", "item_r").alias("target"),
        *[F.when(swapped, F.col(f"{c}_r")).otherwise(F.col(f"{c}_l")).alias(f"{c}_source") for c in carry],
        *[F.when(swapped, F.col(f"{c}_l")).otherwise(F.col(f"{c}_r")).alias(f"{c}_target") for c in carry],
    )


def summed_pairs(rows: DataFrame, key: str, item: str, weight: Column, carry: tuple[str, ...] = (),
                 block_rows: int = BLOCK_ROWS, heavy_keys: int = HEAVY_KEYS) -> DataFrame:
    """``(source, target, weight)`` over all pairs of ``pairs_within``; ``weight`` aggregates the carried columns.

    The items of a key are kept as sorted lists of about ``block_rows``. What travels is a
    row per item and list, with all larger items of that list; the rows of a source meet in one
    partition, where its pairs are listed and summed. A source of more than ``heavy_keys`` keys is
    dealt into several by the hash of the target. The number of partitions follows the pairs.
    """
    scratch = Scratch(rows.sparkSession, "pairs")
    rows = scratch.save(rows.where(F.col(key).isNotNull() & F.col(item).isNotNull()).select(key, item, *carry), "rows")
    n = F.col("n").cast("double")
    hot, tasks = _histogram(
        rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")), n * (n - 1) / 2,
        F.col("n") > block_rows, F.col(key), _blocks(F.col("n"), block_rows).alias("blocks"))
    heavy = scratch.save(
        rows.groupBy(F.col(item).alias("source")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy_keys)
        .select("source", F.ceil(F.col("n") / heavy_keys).cast("int").alias("salts")), "heavy")
    entry = F.struct(F.col(item).alias("x"), *carry) if carry else F.col(item)
    at = (lambda e: e["x"]) if carry else (lambda e: e)
    listed = F.sort_array(F.collect_list(entry)).alias("own")
    larger = F.expr("slice(own, at + 2, size(own))").alias("others")
    if hot.isEmpty():
        rays = rows.groupBy(key).agg(listed).select("own", F.posexplode("own").alias("at", "one")).select("one", larger)
    else:
        dealt = rows.join(hot, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        lists = scratch.save(
            dealt.groupBy(key, "blocks", _block_of(F.col(item), F.col("blocks")).alias("block")).agg(listed), "lists")
        alone = lists.where("blocks = 1").select("own", F.posexplode("own").alias("at", "one")).select("one", larger)
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        grid = lists.where("blocks > 1")
        low = grid.select(key, F.col("block").alias("lo"), every.alias("hi"), "own")
        high = grid.select(key, every.alias("lo"), F.col("block").alias("hi"), F.col("own").alias("far"))
        cell = [key, "lo", "hi"]
        met = _spread(low, tasks, *cell).join(_spread(high, tasks, *cell), cell).select(F.explode("own").alias("one"), "far")
        rays = alone.unionByName(met.select("one", F.filter("far", lambda e: at(e) > at(F.col("one"))).alias("others")))
    rays = rays.where(F.size("others") > 0).withColumn("source", at(F.col("one")))
    place = ["source"]
    if not heavy.isEmpty():
        place = ["source", "salt"]
        rays = rays.join(heavy, "source", "left").withColumn("salts", F.coalesce("salts", F.lit(1))).withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
        mine = F.filter("others", lambda e: _block_of(at(e), F.col("salts")) == F.col("salt"))
        rays = rays.withColumn("others", F.when(F.col("salts") == 1, F.col("others")).otherwise(mine))
    pairs = _spread(rays, tasks, *place).select(
        *place, "one", F.explode("others").alias("other")).withColumn("target", at(F.col("other")))
    # Grouped by what they are partitioned by and more, so nothing is shuffled again.
    return pairs.where("source <> target").select(
        *place, "target", *[F.col(f"one.{c}").alias(f"{c}_source") for c in carry],
        *[F.col(f"other.{c}").alias(f"{c}_target") for c in carry],
    ).groupBy(*place, "target").agg(weight.alias("weight")).select("source", "target", "weight")


def grid_join(left: DataFrame, right: DataFrame, key: str, left_item: str, right_item: str,
              block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Inner join on ``key`` whose large keys are spread over a grid of blocks.

    Rows of a key are dealt by the hash of ``left_item`` and ``right_item``; a left
    row meets every right block once, so each match appears once. The item columns
    must not share a name with the other side.
    """
    n_left = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
    n_right = right.groupBy(key).agg(F.count(F.lit(1)).alias("n_right"))
    hot, tasks = _histogram(
        n_left.join(n_right, key), F.col("n_left").cast("double") * F.col("n_right"),
        (F.col("n_left") > block_rows) | (F.col("n_right") > block_rows),
        F.col(key), _blocks(F.col("n_left"), block_rows).alias("rows_l"),
        _blocks(F.col("n_right"), block_rows).alias("rows_r"))

    def dealt(side: DataFrame, item: str, own: str, other: str) -> DataFrame:
        return (
            side.join(hot, key, "left")
            .withColumn(own, F.coalesce(own, F.lit(1)))
            .withColumn(other, F.coalesce(other, F.lit(1)))
            .withColumn(f"{own}_block", _block_of(F.col(item), F.col(own)))
            .withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
            .drop("rows_l", "rows_r")
        )

    l = dealt(left, left_item, "rows_l", "rows_r")
    r = dealt(right, right_item, "rows_r", "rows_l")
    cell = [key, "rows_l_block", "rows_r_block"]
    return _spread(l, tasks, *cell).join(_spread(r, tasks, *cell), cell).drop("rows_l_block", "rows_r_block")
