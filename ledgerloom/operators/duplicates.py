"""Duplicate groups, canonical copies and quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import expired, live, parse_iso, source_rank, to_millis, valid_hash, valid_size
from .running import running_before


def split_valid(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a sound hash and size, the others)."""
    good = valid_hash(F.col("content_hash")) & valid_size(F.col("size_bytes"))
    return catalog.where(good), catalog.where(~good)


def group_facts(catalog: DataFrame) -> DataFrame:
    """content_hash, size_bytes, copies, label, total_bytes: duplicate groups by aggregates alone, however many members they have."""
    rows, _ = split_valid(catalog)
    out = rows.groupBy("content_hash", "size_bytes").agg(F.count("*").alias("copies"), F.when(F.min("source") < F.max("source"), "cross-source").otherwise("same-source").alias("label"))
    return out.where("copies >= 2").withColumn("total_bytes", F.col("size_bytes") * F.col("copies"))


def duplicate_groups(catalog: DataFrame) -> DataFrame:
    """``group_facts`` with members, an array: for groups whose members are wanted in one row. ``duplicate_members`` has them as rows."""
    rows, _ = split_valid(catalog)
    out = rows.groupBy("content_hash", "size_bytes").agg(
        F.count("*").alias("copies"),
        F.when(F.min("source") < F.max("source"), "cross-source").otherwise("same-source").alias("label"),
        F.array_sort(F.collect_list(F.struct("source", "key"))).alias("members"),
    )
    return out.where("copies >= 2").withColumn("total_bytes", F.col("size_bytes") * F.col("copies"))


_PLACE = ("__rank", "__seen", "__key", "__source")


def _placed(rows: DataFrame, priority: Sequence[str], millis: bool = True) -> DataFrame:
    """Columns whose ascending order is that of canonical choice: place in the priority list, time last seen, key, source; what is missing comes last."""
    ts = parse_iso(F.col("last_seen_at"))
    ts = F.unix_micros(to_millis(ts) if millis else ts)
    last = F.lit(2**63 - 1)
    values = (F.coalesce(source_rank(F.col("source"), priority).cast("long"), last), F.coalesce(ts, last), F.col("key"), F.col("source"))
    return rows.withColumns(dict(zip(_PLACE, values, strict=True)))


def duplicate_members(catalog: DataFrame, priority: Sequence[str] = ()) -> DataFrame:
    """Members of duplicate groups with copies, canonical and priority_warning.

    Canonical is the first listed source's, then the earliest seen to the millisecond, then
    the smallest key; rows are told apart by (source, key). A group's facts are aggregates,
    which combine before they are shuffled, and join back, so no task sorts a group.
    """
    rows, _ = split_valid(catalog)
    rows = _placed(rows, priority)
    facts = rows.groupBy("content_hash", "size_bytes").agg(F.count("*").alias("copies"), F.min(F.struct(*_PLACE)).alias("__first"), F.max(source_rank(F.col("source"), priority)).isNull().alias("priority_warning"))
    rows = rows.join(facts.where("copies >= 2"), ["content_hash", "size_bytes"])
    return rows.withColumn("canonical", F.struct(*_PLACE) == F.col("__first")).drop("__first")


def canonical_members(catalog: DataFrame, priority: Sequence[str] = ()) -> DataFrame:
    """``duplicate_members`` with rn, the place in the group (1: canonical)."""
    rows = running_before(duplicate_members(catalog, priority), ("content_hash", "size_bytes"), _PLACE, F.lit(1), "rn", catalog.count())
    return rows.withColumn("rn", (F.col("rn") + 1).cast("int")).drop(*_PLACE)


def removal_plan(catalog: DataFrame, priority: Sequence[str] = ()) -> DataFrame:
    """Members that aren't canonical."""
    return duplicate_members(catalog, priority).where(~F.col("canonical")).drop(*_PLACE)


def live_copies(catalog: DataFrame, scope: DataFrame | None = None) -> DataFrame:
    """content_hash, live: live copies over all sources, or over those in ``scope`` (source)."""
    rows = catalog if scope is None else catalog.join(scope.select("source"), "source", "left_semi")
    return rows.groupBy("content_hash").agg(F.count_if(live()).alias("live"))


def quarantine_decisions(catalog: DataFrame, priority: Sequence[str] = (), writable: Sequence[str] = (), dry_run: bool = False) -> DataFrame:
    """source, key, content_hash, size_bytes, action, result for every removable row.

    A hash keeps one live copy: eligible rows before a row, in the order of size, source and
    key, use up the live copies but one. In a dry run every row is planned.
    """
    rows = removal_plan(catalog, priority).select("source", "key", "content_hash", "size_bytes")
    if dry_run:
        return rows.withColumns({"action": F.lit("quarantine"), "result": F.lit("planned")})
    eligible = F.col("source").isin(*writable) if writable else F.lit(False)
    rows = rows.join(live_copies(catalog), "content_hash").withColumn("eligible", eligible)
    rows = running_before(rows, ("content_hash",), ("size_bytes", "source", "key"), F.col("eligible").cast("int"), "used", catalog.count())
    guarded = F.col("used") >= F.greatest(F.col("live") - 1, F.lit(0))
    return rows.select(
        "source", "key", "content_hash", "size_bytes",
        F.when(guarded, "last-copy-protection").otherwise("quarantine").alias("action"),
        F.when(guarded, "skipped").when(F.col("eligible"), "quarantined").otherwise("error").alias("result"),
    )


def _expired_deletes(catalog: DataFrame, marker: str, other: str, now: str, retention_days: int) -> DataFrame:
    due = catalog.where(F.col(marker).isNotNull() & F.col(other).isNull() & expired(F.col(marker), now, retention_days))
    alive = live_copies(catalog).where("live >= 1")
    rows = due.join(alive, "content_hash", "left")
    return rows.select(
        "source", "key", "content_hash", "size_bytes",
        F.when(F.col("live").isNull(), "last-copy-protection").otherwise("physical-delete").alias("action"),
        F.when(F.col("live").isNull(), "skipped").otherwise("deleted").alias("result"),
    )


def expired_quarantine_deletes(catalog: DataFrame, now: str, retention_days: int = 30) -> DataFrame:
    """Deletes of rows quarantined for as long as the retention; a hash without a live copy is kept."""
    return _expired_deletes(catalog, "quarantined_at", "tombstoned_at", now, retention_days)


def tombstone_deletes(catalog: DataFrame, now: str, retention_days: int = 30) -> DataFrame:
    """The same for tombstoned rows that aren't quarantined."""
    return _expired_deletes(catalog, "tombstoned_at", "quarantined_at", now, retention_days)
