"""Files of a read-only store to copy into a replicated one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import import_key, live, year_month


def import_class(content_type: Column) -> Column:
    mime = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(mime.startswith("application/vnd.google-apps."), "native-doc").when(mime.startswith("image/") | mime.startswith("video/"), "candidate").otherwise("unsupported")


def import_plan(files: DataFrame, catalog: DataFrame, replicated: list[str], *, dedupe_within_batch: bool = False) -> DataFrame:
    """``files`` (a listing with content_hash) with class, action and destination key.

    Hashes that a live row of a replicated source holds are skipped; they are fixed at the
    start, so equal new files all come in unless ``dedupe_within_batch``.
    """
    held = catalog.where(live() & F.col("source").isin(*replicated)).select("content_hash").distinct().withColumn("held", F.lit(True))
    meta = lambda k: F.try_element_at("user_metadata", F.lit(k))
    rows = files.withColumn("class", import_class(F.col("content_type"))).join(held, "content_hash", "left")
    rows = rows.withColumn("destination_key", import_key(F.col("key"), meta("drive_file_id"), meta("drive_path"), meta("createdTime")))
    rows = rows.withColumn("time_warning", year_month(meta("createdTime"))[0] == "unknown-year")
    action = (
        F.when(F.col("class") == "native-doc", "drive-skip-native-doc").when(F.col("class") == "unsupported", "drive-skip-unsupported").when(F.col("held"), "drive-skip-existing")
    )
    if dedupe_within_batch:
        again = F.row_number().over(W.partitionBy("content_hash", "class").orderBy("key")) > 1
        action = action.when(again, "drive-skip-existing")
    return rows.withColumn("action", action.otherwise("drive-import-success")).drop("held")


def would_import(files: DataFrame, catalog: DataFrame, replicated: list[str]) -> DataFrame:
    """One row: files that an import would bring in. Equal files count each; a file whose hash is unknown doesn't count."""
    held = catalog.where(live() & F.col("source").isin(*replicated)).select("content_hash").distinct()
    rows = files.where((import_class(F.col("content_type")) == "candidate") & F.col("content_hash").isNotNull())
    return rows.join(held, "content_hash", "left_anti").agg(F.count("*").alias("files"))


def import_stats(plan: DataFrame) -> DataFrame:
    """One row of counters."""
    n = lambda a: F.count_if(F.col("action") == a)
    return plan.agg(
        F.count("*").alias("discovered"), n("drive-import-success").alias("imported"), n("drive-skip-existing").alias("skip_existing"),
        n("drive-skip-native-doc").alias("skip_native_doc"), n("drive-skip-unsupported").alias("skip_unsupported"), n("drive-download-error").alias("download_error"),
        F.count_if(F.col("time_warning") & F.col("action").isin("drive-import-success")).alias("time_warning"),
    )
