"""Binary files in the shared folder, written and read inside tasks."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from citegrid.session import scratch_root


# Rows of whole texts that travel to Python at a time; Spark's own default is ten times as many.
BATCH_ROWS = 1_000


def short_batches(spark: SparkSession) -> None:
    """Keep the batches of this session's Python stages small, since texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def folder(spark: SparkSession, label: str) -> str:
    """A new folder under the shared scratch root, as a URI."""
    root = scratch_root(spark).rstrip("/")
    if root.startswith("file:") and not root.startswith("file://"):
        root = "file://" + root[len("file:"):]
    elif "://" not in root:
        root = "file://" + root
    return f"{root}/{label}-{uuid.uuid4().hex}"


def create(uri: str):
    """A stream to a new file; missing folders are made."""
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path, compression=None)


def open_file(uri: str):
    """A random-access file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def new_name(prefix: str, suffix: str) -> str:
    """A file name of this attempt alone; a manifest names the files that count."""
    return f"{prefix}-{uuid.uuid4().hex}{suffix}"
