"""Catalogs made of the driver's tables, in Spark; ``oracle.py`` has the same views in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {"s3-prod": "s3", "gcs-archive": "gcs", "s3-cold": "s3", "drive-folder": "google_drive"}
REPLICATED = ["s3-prod", "gcs-archive", "s3-cold"]
PRIORITY = ["gcs-archive", "s3-prod"]
NOW = "2024-02-10T12:00:00Z"
FOUR = [f"src{i}" for i in range(4)]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _day(days) -> F.Column:
    return F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd'T'00:00:00'Z'")


def catalog20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty sources; keys that several sources share."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    null = F.lit(None).cast("string")
    return d.select(
        "doc_id",
        "source",
        F.concat(F.col("lang"), F.lit("/"), F.floor(i / 20).cast("string")).alias("key"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        _day((i * 37) % 30).alias("last_seen_at"),
        _day((i * 11) % 28).alias("last_modified"),
        F.when(i % 5 == 0, "image/jpeg").when(i % 5 == 1, "video/mp4").when(i % 5 == 2, "application/vnd.google-apps.document").when(i % 5 == 3, "text/plain").alias("content_type"),
        F.when(i % 11 == 0, _day(i % 31)).otherwise(null).alias("quarantined_at"),
        F.when((i % 13 == 0) & (i % 11 != 0), _day(i % 29)).otherwise(null).alias("tombstoned_at"),
        F.when(i % 7 == 0, "s3-prod").when(i % 7 == 1, "gcs-archive").when(i % 7 == 2, "").otherwise(null).alias("origin"),
    )


def catalog4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows folded to four stores of three kinds; the key carries the first source."""
    n = F.col("doc_id") % 20 % 4
    names = list(KINDS)
    c = catalog20(spark, sf_dir).withColumn("key", F.concat("key", F.lit("/"), "source"))
    return c.withColumn("source", F.when(n == 0, names[0]).when(n == 1, names[1]).when(n == 2, names[2]).otherwise(names[3]))


def sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KINDS.items()), "source string, kind string")


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ledger rows: errors are replication errors of an invented hash."""
    e = read(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(
        F.when(failed, "replication-error").otherwise(F.col("event_type")).alias("action"),
        F.when(failed, "error").otherwise("success").alias("result"),
        F.when(failed, F.sha2(F.encode((F.col("user_id") % 50).cast("string"), "UTF-8"), 256)).alias("content_hash"),
    )
