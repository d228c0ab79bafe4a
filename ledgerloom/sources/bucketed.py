"""The catalog on disk: Parquet in buckets of (source, key), sorted by them.

What a run joins with the catalog (the listing, for cached hashes, missing objects, and new
and removed ones) is dealt out to the buckets; the catalog itself is read where it lies, without a shuffle or a sort.
A file beside the data says how many buckets there are, so a folder can be renamed or copied
and stays readable; plain Parquet readers see an ordinary folder.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

KEYS = ("source", "key")
ROWS, NOTE = 1_000_000, "_BUCKETS"


def _table(path: str) -> str:
    return f"ledgerloom_{hashlib.sha256(path.encode()).hexdigest()[:24]}"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_bucketed(df: DataFrame, path: str, rows: int) -> None:
    """``df`` to ``path``, about ``ROWS`` rows in a bucket and a file; ``rows``: how many there will be, or about so."""
    spark = df.sparkSession
    n = max(1, spark.sparkContext.defaultParallelism, -(-rows // ROWS))
    table = f"ledgerloom_w{uuid.uuid4().hex}"
    try:
        df.repartition(n, *KEYS).write.mode("overwrite").format("parquet").bucketBy(n, *KEYS).sortBy(*KEYS).option("path", path).saveAsTable(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # its files stay: they lie in a folder of their own
    fs, at = _fs(spark, f"{path}/{NOTE}")
    out = fs.create(at, True)
    out.writeBytes(str(n))
    out.close()


def read_bucketed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """What ``write_bucketed`` wrote; a folder without its note is read as plain Parquet."""
    fs, at = _fs(spark, f"{path}/{NOTE}")
    if not fs.exists(at):
        return spark.read.schema(schema).parquet(path)
    read = fs.open(at)
    n = int(bytes(read.readAllBytes()).decode())
    read.close()
    table, where = _table(path), path.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY ({', '.join(KEYS)}) SORTED BY ({', '.join(KEYS)}) INTO {n} BUCKETS LOCATION '{where}'")
    return spark.table(table)
