"""Ledger rows from decisions, and questions to the ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.redaction import redact_map, redact_text


def payload(**values: Column) -> Column:
    """A map of those values that aren't null."""
    entries = F.array(*(F.struct(F.lit(k).alias("k"), v.cast("string").alias("v")) for k, v in values.items()))
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def protected(decisions: DataFrame, intended: str) -> DataFrame:
    """Decisions about removals with their payload: a kept last copy names what was meant for it, a tombstone the object it follows."""
    have = set(decisions.columns)
    trigger = lambda c: F.when((F.col("action") == "tombstone") & (F.col("result") == "success"), F.col(c)) if c in have else F.lit(None)
    extra = payload(intended_action=F.when(F.col("action") == "last-copy-protection", intended), triggering_source=trigger("triggering_source"), triggering_key=trigger("triggering_key"))
    return decisions.withColumn("extra", extra)


def with_store(decisions: DataFrame, sources: DataFrame) -> DataFrame:
    """``decisions`` with error: those that name a source or a target outside the configured ``sources`` (source) have failed."""
    known = sources.select(F.col("source").alias("__name")).distinct().withColumn("__there", F.lit(True))

    def looked_up(rows: DataFrame, column: str) -> DataFrame:
        rows = rows.join(F.broadcast(known), F.col(column) == F.col("__name"), "left")  # of configuration, few
        lacking = F.col(column).isNotNull() & F.col("__there").isNull()
        return rows.withColumn("__no", F.coalesce("__no", F.when(lacking, F.concat(F.lit("no store "), F.col(column))))).drop("__name", "__there")

    rows = decisions.withColumn("__no", F.lit(None).cast("string"))
    rows = looked_up(rows, "source")
    rows = looked_up(rows, "target") if "target" in decisions.columns else rows
    had = F.col("error") if "error" in decisions.columns else F.lit(None).cast("string")
    return rows.withColumns({"result": F.when(F.col("__no").isNotNull(), "error").otherwise(F.col("result")), "error": F.coalesce("__no", had)}).drop("__no")


def import_decisions(plan: DataFrame, source: str, destination: str) -> DataFrame:
    """All that the ledger says of an import plan: skipped and imported files, and a warning for each one that comes in without a sound time of creation."""
    meta = lambda k: F.try_element_at("user_metadata", F.lit(k))
    action = F.col("action")
    unread = action.isin("drive-skip-native-doc", "drive-skip-unsupported")
    coming = action == "drive-import-success"
    told = {"drive_file_id": F.coalesce(F.nullif(meta("drive_file_id"), F.lit("")), F.col("key")), "drive_path": meta("drive_path")}
    size = F.col("size_bytes") if "size_bytes" in plan.columns else F.lit(None).cast("bigint")
    rows = plan.select(
        "action", F.when(coming, "success").otherwise("skipped").alias("result"), F.lit(source).alias("source"), F.when(coming, destination).alias("target"), "key",
        F.when(~unread, F.col("content_hash")).alias("content_hash"), size.alias("size_bytes"), F.when(coming, F.col("destination_key")).alias("done_key"),
        payload(**told, mime_type=F.when(unread, F.coalesce("content_type", F.lit("")))).alias("extra"),
    )
    warned = plan.where(coming & F.col("time_warning")).select(
        F.lit("drive-warning-missing-created-time").alias("action"), F.lit("skipped").alias("result"), F.lit(source).alias("source"), F.lit(None).cast("string").alias("target"), "key",
        "content_hash", size.alias("size_bytes"), F.lit(None).cast("string").alias("done_key"), payload(**told, createdTime=F.coalesce(meta("createdTime"), F.lit(""))).alias("extra"),
    )
    return rows.unionByName(warned)


def rehashed(hashed: DataFrame, before: DataFrame) -> DataFrame:
    """``hash-recomputed`` rows: objects read again whose hash isn't what the last catalog says."""
    old = before.select("source", "key", F.col("content_hash").alias("old"))
    rows = hashed.where("hash_from = 'content'").join(old, ["source", "key"]).where(F.col("content_hash") != F.col("old"))
    return rows.select(F.lit("hash-recomputed").alias("action"), F.lit("success").alias("result"), "source", "key", "content_hash", "size_bytes", payload(previous_content_hash=F.col("old")).alias("extra"))


def ledger_rows(decisions: DataFrame, *, run_id: str, timestamp: str, extra: Column | None = None, redact: bool = True) -> DataFrame:
    """Decisions as ledger rows; columns that they lack are null. ``extra``: a map of strings."""
    have = set(decisions.columns)
    text = lambda c: (F.col(c) if c in have else F.lit(None)).cast("string")
    error = text("error")
    more = extra if extra is not None else F.col("extra") if "extra" in have else F.create_map().cast("map<string,string>")
    more = F.coalesce(more, F.create_map().cast("map<string,string>"))
    more = F.map_filter(more, lambda k, v: v.isNotNull())
    size = (F.col("size_bytes") if "size_bytes" in have else F.lit(None)).cast("bigint")
    return decisions.select(
        F.lit(timestamp).alias("timestamp"), F.lit(run_id).alias("run_id"), text("action").alias("action"), text("result").alias("result"), text("source").alias("source"),
        text("target").alias("target"), text("key").alias("key"), text("content_hash").alias("content_hash"), size.alias("size_bytes"),
        (redact_text(error) if redact else error).alias("error"), (redact_map(more) if redact else more).alias("extra"),
    )


def action_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("action", "result").agg(F.count("*").alias("n"))


# The counters of a replication with the action and the result that each counts.
COUNTERS = {
    "replicate": ("replicate", "success"), "replicate_skip_existing": ("replicate-skip-existing", "skipped"), "loop_skip": ("loop-skip", "skipped"),
    "key_conflict": ("key-conflict", "skipped"), "overwrite": ("overwrite", "success"), "rename": ("rename", "success"), "replication_error": ("replication-error", "error"),
    "source_tagged": ("source-tagged", "success"), "tombstone": ("tombstone", "success"), "physical_delete": ("physical-delete", "deleted"), "last_copy_guard": ("last-copy-protection", "skipped"),
}


def replication_counters(ledger: DataFrame) -> DataFrame:
    """One row of eleven counters over the rows of replication and of deletion propagation."""
    return ledger.agg(*(F.count_if((F.col("action") == a) & (F.col("result") == r)).alias(name) for name, (a, r) in COUNTERS.items()))


def replication_error_hashes(ledger: DataFrame) -> DataFrame:
    return ledger.where((F.col("action") == "replication-error") & F.col("content_hash").isNotNull()).select("content_hash").distinct()
