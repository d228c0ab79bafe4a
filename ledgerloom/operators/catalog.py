"""Keeping the catalog: latest versions, removals, cached and resolved hashes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import valid_hash


def upsert(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last version of each key by ``seq``; ``max_by`` combines before the shuffle."""
    if seq not in rows.columns:
        raise ValueError(f"upsert needs an order: no column {seq!r}")
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("x")).select(*keys, "x.*")


def remove(catalog: DataFrame, gone: DataFrame) -> DataFrame:
    return catalog.join(gone.select("source", "key"), ["source", "key"], "left_anti")


def cached_hash(listing: DataFrame, catalog: DataFrame) -> DataFrame:
    """``listing`` with cached_hash: the catalog's, where size and modification time still agree."""
    old = catalog.select("source", "key", F.col("content_hash").alias("c_hash"), F.col("size_bytes").alias("c_size"), F.col("last_modified").alias("c_time"))
    same = (F.col("size_bytes") == F.col("c_size")) & (F.col("last_modified") == F.col("c_time"))
    return listing.join(old, ["source", "key"], "left").withColumn("cached_hash", F.when(same, F.col("c_hash"))).drop("c_hash", "c_size", "c_time")


def resolve_hashes(listing: DataFrame, catalog: DataFrame, contents: DataFrame | Callable[[DataFrame], DataFrame], tag: str = "content-sha256") -> DataFrame:
    """``listing`` with content_hash, hash_from (tag, cache or content) and hash_error.

    ``contents`` is a table (source, key, content), or a function that adds content_hash and
    hash_error to the rows it is given. Only rows that neither tag nor cache resolves get
    there, so a function reads no byte of the others. A row whose content can't be had stays,
    with a null hash and the error.
    """
    told = F.try_element_at("user_metadata", F.lit(tag))
    rows = cached_hash(listing, catalog).withColumn("tag_hash", F.when(valid_hash(told), told))
    known = F.coalesce("tag_hash", "cached_hash")
    none = F.lit(None).cast("string")
    done = rows.where(known.isNotNull()).withColumn("content_hash", known).withColumn("hash_from", F.when(F.col("tag_hash").isNotNull(), "tag").otherwise("cache")).withColumn("hash_error", none)
    rest = rows.where(known.isNull()).drop("tag_hash", "cached_hash")
    if callable(contents):
        rest = contents(rest)
    else:
        rest = rest.join(contents.select("source", "key", F.sha2("content", 256).alias("content_hash")), ["source", "key"], "left")
        rest = rest.withColumn("hash_error", F.when(F.col("content_hash").isNull(), "no content"))
    rest = rest.withColumn("hash_from", F.when(F.col("content_hash").isNotNull(), "content"))
    return done.drop("tag_hash", "cached_hash").unionByName(rest)


def export_order(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy("content_hash", "source", "key")
