"""Paths of a folder tree, from its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import new_folder


def folder_paths(spark: SparkSession, folders: DataFrame, root: str) -> DataFrame:
    """id and path of the folders (id, parent, name) below ``root``, which has no path of its own.

    Every round, each folder takes the path of the one that its own path begins below, so
    paths double in length and a tree of any depth takes as many rounds as its depth has binary digits. A
    round is one join of the folders with themselves and is written down. Folders that lead elsewhere, or around in a circle, aren't below the root.
    """
    at, n = new_folder(spark, "tree"), 0

    def kept(df: DataFrame) -> DataFrame:
        nonlocal n
        n += 1
        df.write.parquet(f"{at}/{n}")
        return spark.read.schema(df.schema).parquet(f"{at}/{n}")

    here = kept(folders.select("id", F.col("parent").alias("up"), F.coalesce("name", F.lit("")).alias("path"), F.lit(True).alias("moved")))
    for _ in range(here.count().bit_length() + 1):
        above = here.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("path").alias("head"))
        here = here.drop("moved").join(above.where(F.col("up") != root), "up", "left")
        found = F.col("next").isNotNull()
        here = kept(here.select("id", F.coalesce("next", "up").alias("up"), F.when(found, F.concat_ws("/", "head", "path")).otherwise(F.col("path")).alias("path"), found.alias("moved")))
        if here.where("moved").isEmpty():
            break
    return here.where(F.col("up") == root).select("id", "path")


def tree_paths(spark: SparkSession, entries: DataFrame, root: str) -> DataFrame:
    """key and path of the files below ``root``, from rows (id, parent, name, is_folder). A file of several folders has several paths; one without a name keeps its place."""
    folders = folder_paths(spark, entries.where("is_folder").select("id", "parent", "name"), root)
    files = entries.where("NOT is_folder").select(F.col("id").alias("key"), F.col("parent").alias("id"), F.coalesce("name", F.lit("")).alias("name"))
    inside = files.join(folders, "id").select("key", F.concat_ws("/", "path", "name").alias("path"))
    return inside.unionByName(files.where(F.col("id") == root).select("key", F.col("name").alias("path")))
