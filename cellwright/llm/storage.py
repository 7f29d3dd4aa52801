"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Folders of the scopes that are open, innermost last.
_open: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a fresh local folder only where that is unset and all tasks run in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="cellwright-"))
    return found.rstrip("/")


#: Bytes of an Arrow batch between the JVM and a worker, where the session sets none: both sides hold a few of them at once.
BATCH_BYTES, _BATCH_KEY = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, unless the application was started with a bound of its own."""
    if spark.sparkContext.getConf().get(_BATCH_KEY) is None:
        spark.conf.set(_BATCH_KEY, str(BATCH_BYTES))


class Scratch:
    """Names written tables and drops those that later steps no longer need."""

    def __init__(self, spark: SparkSession, name: str):
        small_batches(spark)
        self.spark = spark
        self.root = f"{_open[-1] if _open else shared_dir(spark) + '/cellwright'}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def put(self, df: DataFrame, tag: str) -> DataFrame:
        """Write ``df`` once and read it back: survives lost executors, and is computed once."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{tag}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing lazy reads any more."""
        for table in tables:
            self._remove(table._scratch_path)

    def close(self) -> None:
        """Remove all tables, once their last reader has run."""
        self._remove(self.root)

    @contextmanager
    def scope(self, name: str) -> Iterator[None]:
        """Tables of every ``Scratch`` that is made inside are removed at the end."""
        root = f"{self.root}/{name}-{uuid.uuid4().hex}"
        _open.append(root)
        try:
            yield
        finally:
            _open.remove(root)
            self._remove(root)

    def _remove(self, folder: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
