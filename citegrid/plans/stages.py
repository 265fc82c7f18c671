"""Finished tables of a long run, so that a run that was ended goes on behind them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _files(spark: SparkSession, path: str):
    """Hadoop's path and file system of an address."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def fingerprint(spark: SparkSession, path: str) -> list:
    """Address, bytes, files and time of a table, from the file system alone."""
    at, files = _files(spark, path)
    if not files.exists(at):
        raise FileNotFoundError(path)
    size = files.getContentSummary(at)
    return [path, size.getLength(), size.getFileCount(), files.getFileStatus(at).getModificationTime()]


class Stages:
    """Tables under ``<folder>/<digest of the inputs>/<name>``.

    A table is finished once the commit of its write has left its mark, so that one that
    was cut off is made again; other inputs or parameters name another folder, so that
    nothing made from them is taken. File systems without times of folders tell changed
    inputs by bytes and files only.
    """

    def __init__(self, spark: SparkSession, folder: str, **inputs):
        self.spark, self.folder = spark, folder
        self.base = f"{folder}/{hashlib.sha256(json.dumps(inputs, sort_keys=True).encode()).hexdigest()[:24]}"

    def finished(self, name: str) -> bool:
        mark, files = _files(self.spark, f"{self.base}/{name}/_SUCCESS")
        return files.exists(mark)

    def table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of that name, made and written unless it is finished."""
        path = f"{self.base}/{name}"
        if not self.finished(name):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def clear(self) -> None:
        """Remove the tables of all inputs."""
        at, files = _files(self.spark, self.folder)
        files.delete(at, True)
