"""Work tables in the shared folder of the cluster."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: How many bytes of rows Python tasks get at a time.
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20

#: Work tables are written once and read a few times, so bytes count for more than the speed of a codec.
COMPRESSION = "zstd"

#: The driver's heap is collected at most this often to free shuffle files.
RECLAIM_SECONDS = 3.0


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tillstone-"))
    return spark.sparkContext.getCheckpointDir()


@contextmanager
def smaller_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """Rows go to Python tasks and back in batches of at most ``size`` bytes, unless the session asks for smaller ones.

    Each task holds several batches outside the heap, where the default of 64 MB is a good part of an executor's memory.
    """
    before = spark.conf.get(BATCHES, None)
    if before is None or not before.rstrip("b").isdigit() or 0 < int(before.rstrip("b")) <= size:
        yield  # unknown to this version, or small enough
        return
    spark.conf.set(BATCHES, str(size))
    try:
        yield
    finally:
        spark.conf.set(BATCHES, before)


class WorkTables:
    """Parquet tables written once and read back, so that later jobs do not depend on lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/tillstone-{uuid.uuid4().hex}"
        self._paths: dict[str, list[str]] = {}
        self._reclaimed = time.monotonic()

    def save(self, table: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex[:8]}"
        with smaller_batches(self.spark):
            table.write.option("compression", COMPRESSION).parquet(path)
        self._paths.setdefault(name, []).append(path)
        return self.spark.read.schema(table.schema).parquet(path)

    def replace(self, table: DataFrame, name: str) -> DataFrame:
        """Save a table and delete those saved under its name before; ``table`` may have been made of them."""
        before = self._paths.pop(name, [])
        saved = self.save(table, name)
        self._delete(before)
        return saved

    def discard(self, *names: str) -> None:
        """Delete all tables saved under these names; DataFrames over them can no longer be read."""
        self._delete([path for name in names for path in self._paths.pop(name, [])])

    def drop(self) -> None:
        """Delete the tables written here; DataFrames over them can no longer be read."""
        self._paths.clear()
        self._delete([self.folder])

    def _delete(self, paths: list[str]) -> None:
        for path in map(self.spark._jvm.org.apache.hadoop.fs.Path, paths):
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        if paths and time.monotonic() - self._reclaimed > RECLAIM_SECONDS:
            self.reclaim()

    def reclaim(self) -> None:
        """Free the shuffle files of jobs that are over.

        Spark does so when the driver's heap is collected, which a large heap puts off for long.
        """
        gc.collect()  # DataFrames in cycles keep their plans, and those their shuffles
        self.spark._jvm.System.gc()
        self._reclaimed = time.monotonic()
