"""Counts of a first look at all stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import compact_hash
from ..schema import SOURCE_KINDS
from .duplicates import split_valid


def per_source_counts(catalog: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """source, objects, bytes, distinct_hashes; ``sources`` (source) adds those without rows."""
    size = F.coalesce(F.sum(F.when(F.col("size_bytes") >= 0, F.col("size_bytes"))), F.lit(0))
    out = catalog.groupBy("source").agg(F.count("*").alias("objects"), size.alias("bytes"), F.count_distinct(compact_hash(F.col("content_hash"))).alias("distinct_hashes"))
    return out if sources is None else sources.select("source").join(out, "source", "left").na.fill(0)


def cross_kind_partition(catalog: DataFrame, sources: DataFrame) -> DataFrame:
    """One row: hashes held by one kind of store only, by two, by three. ``sources``: source, kind."""
    rows = catalog.join(sources.select("source", "kind"), "source")
    bit = {k: 1 << i for i, k in enumerate(SOURCE_KINDS)}
    held = F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {b}" for k, b in bit.items()) + " END")
    by = rows.where(F.col("kind").isin(*bit)).groupBy(compact_hash(F.col("content_hash")).alias("hash")).agg(F.bit_or(held).alias("held"))
    n = F.bit_count("held")
    only = lambda k: F.count_if(F.col("held") == bit[k])
    return by.agg(only("s3").alias("s3_only"), only("gcs").alias("gcs_only"), only("google_drive").alias("drive_only"), F.count_if(n == 2).alias("exactly_two"), F.count_if(n == 3).alias("all_three"))


def _groups(catalog: DataFrame) -> DataFrame:
    """Duplicate groups by the smallest and largest source alone; no group's members are gathered."""
    rows, _ = split_valid(catalog)
    return rows.groupBy("content_hash", "size_bytes").agg(F.count("*").alias("copies"), F.min("source").alias("lo"), F.max("source").alias("hi")).where("copies >= 2")


def duplicate_groups_per_source(catalog: DataFrame) -> DataFrame:
    """source, groups: duplicate groups inside one source; sources without any don't show."""
    return _groups(catalog).where("NOT lo < hi").groupBy(F.col("lo").alias("source")).agg(F.count("*").alias("groups"))


def cross_source_groups(catalog: DataFrame) -> DataFrame:
    """One row: how many duplicate groups span several sources."""
    return _groups(catalog).agg(F.count_if(F.col("lo") < F.col("hi")).alias("groups"))


def bytes_where(rows: DataFrame, which: Column) -> DataFrame:
    return rows.agg(F.coalesce(F.sum(F.when(which & (F.col("size_bytes") >= 0), F.col("size_bytes"))), F.lit(0)).alias("bytes"))


def batch_size(removals: DataFrame) -> DataFrame:
    """One row, objects and bytes, of what a confirmation is asked for."""
    return removals.agg(F.count("*").alias("objects"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("bytes"))


def run_summary(discovered: DataFrame, *, cold_start: bool, dry_run: bool, apply: bool, confirmed: bool, divergent: DataFrame) -> DataFrame:
    """One row of string counters."""
    flags = {"cold_start": cold_start, "dry_run": dry_run, "apply": apply, "first_pass_confirmed": confirmed}
    one = discovered.agg(F.count("*").cast("string").alias("discovered")).join(divergent.agg(F.count("*").cast("string").alias("divergent_hashes_count")), how="cross")
    return one.select("discovered", *(F.lit(str(v).lower()).alias(k) for k, v in flags.items()), "divergent_hashes_count")


def render(title: str, df: DataFrame, order: list[str]) -> str:
    """A few rows as deterministic text."""
    rows = df.orderBy(*order).collect()
    return "\n".join([title, *(f"  {' '.join(f'{c}={r[c]}' for c in df.columns)}" for r in rows)]) + "\n"
