"""Sinks: delimited text, partitioned tables, small reports and JSON batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrid.operators.keys import batches
from citegrid.session import Scratch

# Quotes are doubled, as the readers expect them; blanks at the ends of a value stay.
_TEXT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
REPORT_ROWS = 100_000
# JSON files that a task writes; Spark numbers them with three digits.
TASK_FILES = 500


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with header; missing values are spelled ``NA``."""
    df.write.mode("overwrite").options(**_TEXT).option("sep", "\t").option("nullValue", "NA").csv(path)


def write_csv(df: DataFrame, path: str, **options: str) -> None:
    """Comma-separated with header; ``options`` such as ``sep`` or ``encoding`` name other forms."""
    df.write.mode("overwrite").options(**_TEXT).options(**options).csv(path)


def write_by_network(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder per network, written in parallel."""
    df.write.mode("overwrite").partitionBy("network").options(**_TEXT).format(fmt).save(path)


def write_report(df: DataFrame, path: str) -> None:
    """A grouped report as a single file if it has at most ``REPORT_ROWS`` rows.

    The report is computed by all tasks and stored first; only its rows are gathered.
    """
    scratch = Scratch(df.sparkSession, "report")
    try:
        stored, seen = scratch.measure(df, "report", F.count(F.lit(1)).alias("rows"))
        few = stored.coalesce(1) if seen["rows"] <= REPORT_ROWS else stored
        few.write.mode("overwrite").options(**_TEXT).csv(path)
    finally:
        scratch.clear()


def write_nested(df: DataFrame, path: str) -> None:
    """Parquet keeps structs, lists and maps as they are."""
    df.write.mode("overwrite").parquet(path)


def write_json_arrays(df: DataFrame, path: str, size: int = 100, order: str = "row_idx") -> None:
    """A file per ``size`` consecutive rows holding them as one JSON array, numbered in order.

    ``order`` numbers the rows from 0 without gaps. A file is one group of ``size`` rows, and a
    task writes ``TASK_FILES`` files one after the other, numbered by task and within it; the
    column ``order`` is not written, since the place of a row tells it.
    """
    row = F.struct(F.col(order).alias("_at"), F.struct(*[c for c in df.columns if c != order]).alias("_row"))
    chunks = df.groupBy(F.floor(F.col(order) / size).cast("int").alias("chunk")).agg(
        F.transform(F.array_sort(F.collect_list(row)), lambda r: r["_row"]).alias("rows"))
    n = chunks.agg(F.max("chunk")).first()[0]
    # A file holds one array; its name has the number of the task, then that within the task.
    (
        chunks.repartitionById((n or 0) // TASK_FILES + 1, F.floor(F.col("chunk") / TASK_FILES).cast("int"))
        .sortWithinPartitions("chunk").select(F.to_json("rows").alias("value"))
        .write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    )


def write_json_batches(df: DataFrame, path: str, size: int = 100, order: str = "row_idx") -> None:
    """JSON lines with a ``batch_id`` per ``size`` consecutive rows.

    Rows are range-partitioned, so a file holds whole neighbouring batches in order; the
    number of files follows the data and not the number of batches.
    """
    (
        batches(df, size, order).repartitionByRange("batch_id").sortWithinPartitions("batch_id", order)
        .write.mode("overwrite").json(path)
    )
