"""Objects that vanished, and what becomes of their copies elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import live
from .running import running_before


def missing_records(catalog: DataFrame, listing: DataFrame, reachable: Sequence[str]) -> DataFrame:
    """Catalog rows of reachable sources whose (source, key) the listing hasn't."""
    return catalog.where(F.col("source").isin(*reachable)).join(listing.select("source", "key"), ["source", "key"], "left_anti")


def tombstone_decisions(catalog: DataFrame, listing: DataFrame, names: Sequence[str], writable: Sequence[str], *, count_missing_as_live: bool = True) -> DataFrame:
    """One row per decision on a live copy (peer) of a missing object, with the triggering object.

    Peers are settled in the order of missing and peer (source, key); each one that is
    tombstoned uses up a live copy, and the last one is kept. A tombstoned peer shows once,
    a kept one for every missing object. The snapshot's live copies include the missing
    rows themselves; ``count_missing_as_live=False`` is the safer count.

    No pairs are made to find out: a peer meets the hash's first missing object, or, if that lies in the
    peer's own store, the first one of the next store; so its turn among the peers
    that may be tombstoned is one running sum. Only kept peers are then paired, with the objects
    their rows name.
    """
    gone = missing_records(catalog, listing, names)
    m = gone.select("content_hash", F.col("source").alias("m_source"), F.col("key").alias("m_key"))
    # The first missing object of the first two stores; stores are configuration, so the array is short.
    firsts = m.groupBy("content_hash", "m_source").agg(F.min("m_key").alias("m_key")).groupBy("content_hash").agg(F.array_sort(F.collect_list(F.struct("m_source", "m_key"))).alias("f"))
    firsts = firsts.select("content_hash", F.get("f", F.lit(0)).alias("one"), F.get("f", F.lit(1)).alias("two"))
    p = catalog.where(live() & F.col("source").isin(*names)).select("content_hash", "source", "key", "size_bytes").join(firsts, "content_hash")
    late = F.col("source") == F.col("one.m_source")
    p = p.withColumn("late", late.cast("int")).withColumn("first", F.when(late, F.col("two")).otherwise(F.col("one"))).where(F.col("first").isNotNull())
    counted = catalog.where(F.col("source").isin(*names))
    if not count_missing_as_live:
        counted = counted.join(gone.select("source", "key"), ["source", "key"], "left_anti")
    alive = counted.groupBy("content_hash").agg(F.count_if(live()).alias("live"))
    p = p.withColumn("eligible", F.col("source").isin(*writable) if writable else F.lit(False))
    # How many peers have been tombstoned after the first store's first object, and after the second's.
    ends = p.groupBy("content_hash").agg(F.count_if(F.col("eligible") & (F.col("late") == 0)).alias("h_one"), F.count_if("eligible").alias("h_two"))
    p = p.join(ends, "content_hash").join(alive, "content_hash", "left").withColumn("budget", F.coalesce("live", F.lit(0)) - 1)
    p = running_before(p, ("content_hash",), ("late", "source", "key"), F.col("eligible").cast("int"), "turn", catalog.count())
    p = p.withColumn("done", F.col("eligible") & (F.col("turn") < F.col("budget")))
    done = p.where("done").select("source", "key", "content_hash", F.col("first.m_source").alias("triggering_source"), F.col("first.m_key").alias("triggering_key"), F.lit("tombstone").alias("action"), F.lit("success").alias("result"))
    kept = p.where(~F.col("done")).join(m, "content_hash").where(F.col("m_source") != F.col("source"))
    now = F.struct("m_source", "m_key")
    before = (
        F.when((now == F.col("one")) | ((F.col("late") == 1) & (now == F.col("two"))), F.col("turn"))
        .when(F.col("m_source") == F.col("one.m_source"), F.col("h_one"))
        .when((now == F.col("two")) & (F.col("source") < F.col("one.m_source")), F.col("h_one"))
        .otherwise(F.col("h_two"))
    )
    room = before < F.col("budget")
    kept = kept.select(
        "source", "key", "content_hash", F.col("m_source").alias("triggering_source"), F.col("m_key").alias("triggering_key"),
        F.when(room, "tombstone").otherwise("last-copy-protection").alias("action"), F.when(room, "error").otherwise("skipped").alias("result"),
    )
    return done.unionByName(kept)
