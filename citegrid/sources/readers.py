"""File readers with explicit schemas and the null spellings of the inputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from citegrid.operators.keys import dense_id, with_row_idx
from citegrid.sources import schemas

# Spellings that a table reader takes for a missing value.
NA_SPELLINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

_TEXT = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}

# Other names of the work link column, first found wins.
LINK_ALIASES = ("openalex_work_id", "openalex_work", "openalex")


def null_out(df: DataFrame, spellings: tuple[str, ...] = NA_SPELLINGS) -> DataFrame:
    """Nulls for all missing-value spellings in text columns."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and not f.name.startswith("_")]
    return df.withColumns({c: F.when(~F.col(c).isin(*spellings), F.col(c)) for c in texts})


def read_text_table(spark: SparkSession, path: str, schema: StructType, sep: str = ",",
                    encoding: str = "UTF-8", multi_line: bool = False, row_idx: bool = False) -> DataFrame:
    """Delimited text with a header, columns matched by position in ``schema``.

    A missing path or a record that does not fit fails at once. Files are split among
    tasks; ``multi_line`` allows line breaks in quotes, at the price of one task per file,
    so write such tables as many files.
    """
    df = (
        spark.read.schema(schema).option("header", True).option("sep", sep).option("encoding", encoding)
        .option("quote", '"').option("escape", '"').option("multiLine", multi_line)
        .option("enforceSchema", False).option("mode", "FAILFAST").csv(path)
    )
    return null_out(with_row_idx(df) if row_idx else df)


def read_csv(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    return read_text_table(spark, path, schema, ",", **options)


def read_tsv(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    return read_text_table(spark, path, schema, "\t", **options)


def read_piped(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    return read_text_table(spark, path, schema, "|", **options)


def read_latin1_tsv(spark: SparkSession, path: str, schema: StructType, **options) -> DataFrame:
    """Latin-1 decodes every byte, so nothing has to be skipped."""
    return read_text_table(spark, path, schema, "\t", encoding="ISO-8859-1", **options)


def read_json_records(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Files holding a JSON array of records; a glob reads many chunks as one set."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_json_chunks(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Chunks such as ``data_100_200.json`` as one table in chunk order: adds ``row_idx``.

    Chunks are ordered by the first number of their file name, as a number.
    """
    start = F.regexp_extract(F.col("_metadata.file_name"), r"([0-9]+)", 1)
    rows = read_json_records(spark, path, schema).select(
        "*", F.when(start != "", start.cast("bigint")).alias("_start"), F.col("_metadata.file_name").alias("_file"),
        F.monotonically_increasing_id().alias("_seen"))
    return dense_id(rows, ["_start", "_file", "_seen"], "row_idx", 0).drop("_start", "_file", "_seen")


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_networks(spark: SparkSession, folder: str, prefix: str = "net_",
                  schema: StructType = schemas.EDGES) -> DataFrame:
    """All ``<prefix><name>.csv`` files of a folder as one table with their ``network``.

    Columns are taken by name, whatever their order in a file, and one that a file lacks
    is null; files (or folders of files) with the same header are read together. A cell
    that does not fit its type fails.
    """
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}*.csv")
    found = fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(fs_path) or []
    groups: dict[tuple[str, ...], list[str]] = {}
    for status in found:  # one per network
        path = status.getPath().toString()
        groups.setdefault(tuple(_header(spark, path)), []).append(path)
    if not groups:
        raise FileNotFoundError(f"no {prefix}*.csv in {folder}")
    name = F.regexp_extract(F.col("_metadata.file_path"), f"/{prefix}([^/]*)\\.csv(/[^/]*)?$", 1)
    parts = []
    for header, paths in groups.items():
        text = (
            spark.read.schema(schemas.table(**{c: schemas.STRING for c in header})).options(**_TEXT)
            .option("enforceSchema", False).option("mode", "FAILFAST").csv(paths))
        parts.append(text.select(*[
            (F.col(f.name).cast(f.dataType) if f.name in header else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields], name.alias("network")))
    return reduce(DataFrame.unionByName, parts)


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.options(**_TEXT).csv(path).columns


def normalize_link(df: DataFrame) -> DataFrame:
    """Call the work link column ``openalex_id``."""
    if "openalex_id" in df.columns:
        return df
    for alias in LINK_ALIASES:
        if alias in df.columns:
            return df.withColumnRenamed(alias, "openalex_id")
    raise ValueError(f"no work link column among {df.columns}")


def _read_any(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".csv"):
        columns = _header(spark, path)
        return read_csv(spark, path, schemas.table(**{c: schemas.STRING for c in columns}))
    return spark.read.parquet(path)


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """``(openalex_id, id, …)`` from CSV or Parquet; a bad id is an error."""
    return normalize_link(_read_any(spark, path)).withColumn("id", F.col("id").cast("bigint"))


def read_citations(spark: SparkSession, path: str) -> DataFrame:
    return _read_any(spark, path).select(
        F.col("citing_id").cast("bigint").alias("citing_id"), F.col("cited_id").cast("bigint").alias("cited_id"))
