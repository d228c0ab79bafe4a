"""Where stores differ."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import compact_hash, full_hash


def new_and_removed(before: DataFrame, now: DataFrame) -> DataFrame:
    """source, new, removed: keys that only one of the two tables has. Both sides are (source, key)."""
    a = before.select("source", "key").distinct().withColumn("b", F.lit(True))
    b = now.select("source", "key").distinct().withColumn("n", F.lit(True))
    both = a.join(b, ["source", "key"], "full_outer")
    return both.groupBy("source").agg(F.count_if(F.col("b").isNull()).alias("new"), F.count_if(F.col("n").isNull()).alias("removed"))


def drift_events(divergent: DataFrame, changes: DataFrame) -> DataFrame:
    """level, event, content_hash, present_in, absent_from, canonical_key and detail (a map): one INFO row of counters,
    and a WARN row for each divergent hash. ``changes``: source, new, removed; it has one row per configured source."""
    text = lambda c: F.col(c).cast("string")
    entry = lambda c: F.struct(F.concat(F.lit(f"{c}:"), F.col("source")).alias("k"), text(c).alias("v"))
    counts = changes.select(F.explode(F.array(entry("new"), entry("removed"))).alias("e")).unionByName(
        divergent.agg(F.struct(F.lit("divergent_hashes_count").alias("k"), F.count("*").cast("string").alias("v")).alias("e"))
    )
    none = F.lit(None)
    info = counts.agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("detail")).select(
        F.lit("INFO").alias("level"), F.lit("inconsistency-summary").alias("event"), none.cast("string").alias("content_hash"), none.cast("array<string>").alias("present_in"),
        none.cast("array<string>").alias("absent_from"), none.cast("string").alias("canonical_key"), "detail",
    )
    warn = divergent.select(
        F.lit("WARN").alias("level"), F.lit("inconsistency-divergent-hash").alias("event"), "content_hash", "present_in", "absent_from",
        F.col("canonical.key").alias("canonical_key"), none.cast("map<string,string>").alias("detail"),
    )
    return info.unionByName(warn)


WORD = 63  # sources that one long of bits tells of


def presence(catalog: DataFrame, names: Sequence[str]) -> DataFrame:
    """hash (compact), bits (array of longs: who of the sorted ``names`` holds it) and first (place of the source, key: the smallest).

    Bits are or-ed in each task before the one shuffle, in which a hash takes 33 bytes and its holders eight, however many copies there are.
    """
    names = sorted(set(names))
    place = F.array_position(F.array(*map(F.lit, names)), F.col("source")).cast("int") - 1
    rows = catalog.where(F.col("source").isin(*names)).select(compact_hash(F.col("content_hash")).alias("hash"), place.alias("p"), "key")
    bit = F.expr(f"shiftleft(1L, p % {WORD})")
    words = [F.bit_or(F.when(F.floor(F.col("p") / WORD) == w, bit).otherwise(F.lit(0).cast("long"))) for w in range((len(names) + WORD - 1) // WORD)]
    return rows.groupBy("hash").agg(F.array(*words).alias("bits"), F.min(F.struct("p", "key")).alias("first"))


def divergent_hashes(observed: DataFrame, names: Sequence[str], errors: DataFrame | None = None) -> DataFrame:
    """content_hash, present_in, absent_from (sorted arrays) and the smallest (source, key), for hashes that some of
    the named sources hold and some don't. A source without rows is absent. ``errors`` (content_hash) are left out."""
    every = sorted(set(names))
    if not every:
        return observed.limit(0).select("content_hash", F.array().cast("array<string>").alias("present_in"), F.struct("source", "key").alias("canonical"), F.array().cast("array<string>").alias("absent_from"))
    by, all_names = presence(observed, every), F.array(*map(F.lit, every))
    holds = lambda i: F.get("bits", F.floor(i / WORD).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i % WORD)) != 0
    full = [(1 << min(WORD, len(every) - w)) - 1 for w in range(0, len(every), WORD)]
    by = by.where(F.col("bits") != F.array(*(F.lit(x).cast("long") for x in full)))
    by = by.select(
        full_hash(F.col("hash")).alias("content_hash"), F.filter(all_names, lambda _, i: holds(i)).alias("present_in"),
        F.struct(F.get(all_names, F.col("first.p")).alias("source"), F.col("first.key").alias("key")).alias("canonical"), F.filter(all_names, lambda _, i: ~holds(i)).alias("absent_from"),
    )
    return by if errors is None else by.join(errors.select("content_hash").distinct(), "content_hash", "left_anti")
