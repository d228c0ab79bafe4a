"""An extension: a catalog that follows listings as they arrive, in any order, some more than once.

The state holds what was seen last of each (source, key), in stretches of time: an aggregate of
Spark's own, so no Python runs for a key. A row that is newer replaces it and goes on as a
change; one that is older by ``late`` at most, or repeated, ends there. A stretch's state goes
once the watermark has passed it, and what still comes for it is dropped as late. Each
micro-batch writes its changes to a folder named by its number, so a batch that is done again after
a failure replaces its own changes. The catalog is the base and the changes behind it, the last of
each key, so a change too many changes nothing; ``compact`` makes a new base, and the changes that
it holds go.

Ties of one key and time go to the greater hash, then the greater size; null is the least. Rows
without source, key or time are no objects and are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators.catalog import upsert

KEYS = ["source", "key"]
SEEN = T.StructType([T.StructField("source", T.StringType()), T.StructField("key", T.StringType()), T.StructField("seen_at", T.TimestampType()), T.StructField("content_hash", T.StringType()), T.StructField("size_bytes", T.LongType())])


def changes(listings: DataFrame, late: str = "1 day", days: int = 5) -> DataFrame:
    """The rows of a stream (SEEN, in update mode) that are newer than all of their key before them. Of rows further apart than ``late``, an older one may go on too.

    A stretch is ``days`` long and also holds the rows of the next one's first ``late``, so a row lies in
    ``1 + late / days`` of them in the mean. It closes when the newest time less ``late`` has reached its end,
    ``days`` and ``late`` after its start, so no row within ``late`` of the newest time is dropped.
    """
    arrived = -F.unix_micros(F.current_timestamp())  # one time for a whole batch; of equal rows the first to arrive stays
    rows = listings.select(*SEEN.names, arrived.alias("arrived")).where("source IS NOT NULL AND key IS NOT NULL AND seen_at IS NOT NULL").withWatermark("seen_at", late)
    best = F.max(F.struct("seen_at", "content_hash", "size_bytes", "arrived")).alias("best")
    held = rows.groupBy(*KEYS, F.window("seen_at", f"{late} {days} days", f"{days} days")).agg(best)
    own = F.unix_micros("best.seen_at") - F.unix_micros("window.start") < days * 86_400_000_000  # else the next stretch has it too
    return held.where((F.col("best.arrived") == arrived) & own).select(*KEYS, "best.seen_at", "best.content_hash", "best.size_bytes")


def follow(listings: DataFrame, folder: str, late: str = "1 day") -> StreamingQuery:
    """Takes all listings that are there, each once, into the catalog below ``folder``, and ends."""

    def merge(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")

    return changes(listings, late).writeStream.outputMode("update").foreachBatch(merge).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _settled(spark: SparkSession, folder: str) -> None:
    """A base whose replacement was cut short takes its place, or goes if it isn't whole."""
    fs, base = _fs(spark, f"{folder}/base")
    _, new = _fs(spark, f"{folder}/base.new")
    _, whole = _fs(spark, f"{folder}/base.new/_SUCCESS")
    if not fs.exists(base) and fs.exists(whole):
        fs.rename(new, base)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, at = _fs(spark, f"{folder}/changes")
    return sorted(int(x.getPath().getName()[len("batch=") :]) for x in fs.listStatus(at) if x.getPath().getName().startswith("batch=")) if fs.exists(at) else []


def current(spark: SparkSession, folder: str) -> DataFrame:
    """The catalog as it is (SEEN): the last row of each key of base and changes."""
    _settled(spark, folder)
    fs, base = _fs(spark, f"{folder}/base")
    rows = spark.read.schema(SEEN).parquet(f"{folder}/base") if fs.exists(base) else spark.createDataFrame([], SEEN)
    if _numbers(spark, folder):
        rows = rows.unionByName(spark.read.schema(SEEN).parquet(f"{folder}/changes/*"))
    return upsert(rows.withColumn("__order", F.struct("seen_at", "content_hash", "size_bytes")), KEYS, "__order").select(*SEEN.names)


def compact(spark: SparkSession, folder: str) -> None:
    """The catalog becomes the new base, and the changes in it go. Cut short anywhere, it loses nothing: a change that is in the base too changes nothing."""
    done = _numbers(spark, folder)
    current(spark, folder).write.mode("overwrite").parquet(f"{folder}/base.new")
    fs, base = _fs(spark, f"{folder}/base")
    fs.delete(base, True)
    _settled(spark, folder)
    for number in done:
        fs.delete(_fs(spark, f"{folder}/changes/batch={number}")[1], True)
