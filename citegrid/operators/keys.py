"""Row numbers, surrogate ids and the works/citations tables built with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegrid.session import Scratch

# monotonically_increasing_id keeps the position within a partition in the low 33 bits.
_POSITION_BITS = 33


def dense_id(df: DataFrame, order: list[str], name: str = "id", start: int = 1,
             scratch: Scratch | None = None) -> DataFrame:
    """Consecutive numbers in the given order without a global sort task.

    Rows are range-partitioned and sorted within partitions; a partition's offset is
    the number of rows before it. The placed rows are written once, because range
    bounds are sampled and must not be drawn again between counting and numbering.
    ``order`` should be unique, or equal rows are numbered arbitrarily.
    """
    scratch = scratch or Scratch(df.sparkSession, "dense-id")
    placed = scratch.save(
        df.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id()),
        f"placed-{name}",
    )
    partition = F.shiftright("_mid", _POSITION_BITS)
    position = F.col("_mid").bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))
    # One row per partition, so this window over everything is tiny.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(partition.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    return (
        placed.withColumn("_part", partition).join(offsets, "_part")
        .withColumn(name, F.col("_offset") + position + F.lit(start).cast("bigint"))
        .drop("_part", "_mid", "_offset")
    )


def with_row_idx(df: DataFrame, start: int = 0) -> DataFrame:
    """Number the rows of a file scan in file order.

    Splits are not scheduled in file order, so the position comes from the file
    path, the split start and the position within the task.
    """
    located = df.select(
        "*", F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seen"),
    )
    return dense_id(located, ["_path", "_block", "_seen"], "row_idx", start).drop("_path", "_block", "_seen")


def reference_list(column: Column) -> Column:
    """A list literal such as ``['a', 'b']`` as an array."""
    return F.from_json(column, "array<string>")


def _usable(column: str) -> Column:
    return F.col(column).isNotNull() & (F.trim(column) != "")


def build_works(records: DataFrame, dedup: bool = True) -> DataFrame:
    """``(openalex_id, id)`` of all own ids and all cited ids of ``records(id, referenced_works)``.

    Own ids come first in row order, then cited ids in list order. ``dedup=False``
    numbers every occurrence.
    """
    base = records if "row_idx" in records.columns else records.withColumn("row_idx", F.xxhash64("id"))
    own = base.select(F.col("id").alias("openalex_id"), F.lit(0).alias("kind"), "row_idx", F.lit(0).alias("pos"))
    cited = base.select(
        "row_idx", F.posexplode(reference_list(F.col("referenced_works"))).alias("pos", "openalex_id")
    ).select("openalex_id", F.lit(1).alias("kind"), "row_idx", "pos")
    seen = own.unionByName(cited).where(_usable("openalex_id"))
    order = ["kind", "row_idx", "pos"]
    if dedup:
        place = F.min(F.struct(*order)).alias("place")
        seen = seen.groupBy("openalex_id").agg(place).select("openalex_id", "place.*")
    return dense_id(seen, order).select("openalex_id", "id")


def build_citations(records: DataFrame, works: DataFrame) -> DataFrame:
    """``(citing_id, cited_id)`` with integer ids; references outside ``works`` are dropped."""
    links = records.select(
        F.col("id").alias("citing"), F.explode_outer(reference_list(F.col("referenced_works"))).alias("cited"))
    return rekey(links, works, citing_how="left")


def rekey(links: DataFrame, works: DataFrame, citing_how: str = "inner") -> DataFrame:
    """Replace the text ids of ``links(citing, cited)`` by ``works(openalex_id, id)``."""
    ids = works.select("openalex_id", "id")
    by_cited = ids.select(F.col("openalex_id").alias("cited"), F.col("id").alias("cited_id"))
    by_citing = ids.select(F.col("openalex_id").alias("citing"), F.col("id").alias("citing_id"))
    return links.join(by_cited, "cited").join(by_citing, "citing", citing_how).select("citing_id", "cited_id")


def batches(df: DataFrame, size: int = 100, order: str = "row_idx") -> DataFrame:
    """Restartable groups of ``size`` consecutive rows."""
    return df.withColumn("batch_id", F.floor(F.col(order) / F.lit(size)).cast("bigint"))
