"""Tables that an operator writes and reads again, in the folder that all executors share.

A written table cuts the lineage, outlives any executor and has a known size, so
that Spark's own broadcast threshold decides how it is joined.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder of our own if all executors run on this machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own.setdefault("root", tempfile.mkdtemp(prefix="ledgerloom-"))
    return root.rstrip("/")


_own: dict[str, str] = {}


class Scratch:
    """One folder of tables for one run of an operator; deleted when the process ends."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/ledgerloom/{what}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.drop)

    def new(self, name: str) -> str:
        self._n += 1
        self.last = f"{self.path}/{self._n}-{name}"
        return self.last

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet and returns what was written."""
        path = self.new(name)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str | None = None) -> None:
        """Deletes one table, or all of them. Harmless if the session has ended."""
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path or self.path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001  the session is gone, and a leftover folder does no harm
            pass
