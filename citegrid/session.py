"""Session settings and the scratch area that iterative jobs write to."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
import weakref

from pyspark.sql import Column, DataFrame, Observation, SparkSession

# Settings the jobs rely on. AQE re-plans joins from measured sizes (a side is
# only broadcast when its measured size is below the threshold) and splits
# oversized join partitions.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("citegrid")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    A checkpoint folder set on the context or named in ``spark.checkpoint.dir``
    is used as it is. Only a local session without either gets a temporary
    folder; on a cluster a machine-local folder would be lost with its node.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="citegrid-")
    context.setCheckpointDir(root)
    return context.getCheckpointDir()


# Scratch areas that are not cleared yet. A lazy result still reads its tables, so what a
# job does not clear itself goes when the program ends.
_OPEN: set[str] = set()
_SESSIONS: weakref.WeakValueDictionary[str, SparkSession] = weakref.WeakValueDictionary()


@atexit.register
def clear_scratch() -> None:
    """Remove the tables of all jobs of this program whose session still runs."""
    for base in list(_OPEN):
        spark = _SESSIONS.get(base)
        if spark is not None and spark.sparkContext._jsc is not None:
            path = spark._jvm.org.apache.hadoop.fs.Path(base)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        _OPEN.discard(base)


class Scratch:
    """Intermediate tables of one job, written to shared storage.

    ``save`` cuts the lineage: what it returns is a scan of committed files, so
    a lost executor costs a re-read and not a recomputation of earlier rounds.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self._paths: dict[str, str] = {}
        self._step = 0
        _OPEN.add(self.base)
        _SESSIONS[self.base] = spark

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back; the previous table of that name is dropped."""
        self._step += 1
        path = f"{self.base}/{name}-{self._step}"
        df.write.mode("overwrite").parquet(path)
        stale = self._paths.get(name)
        self._paths[name] = path
        if stale:
            self._drop(stale)
        return self.spark.read.schema(df.schema).parquet(path)

    def measure(self, df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
        """``save`` that also returns aggregates of the written rows, without a second job."""
        seen = Observation()
        table = self.save(df.observe(seen, *metrics), name)
        return table, seen.get

    def release(self) -> None:
        """Have the shuffle files of finished jobs deleted, which stay until the driver collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            path = self._paths.pop(name, None)
            if path:
                self._drop(path)

    def clear(self) -> None:
        """Remove all tables of the job, once its results are stored elsewhere."""
        self._paths.clear()
        self._drop(self.base)
        _OPEN.discard(self.base)

    def _drop(self, path: str) -> None:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
