"""A full run: list and hash, deduplicate, replicate, import, propagate deletions, look for drift.

A dry run plans everything and touches nothing; a first run that hasn't been confirmed
neither overwrites nor quarantines nor deletes. The catalog is written only by confirmed
runs that apply. Decisions of a phase are written before they are carried out, so that
carrying them out again after a failure does the same.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import valid_hash
from ..operators import deletion, drift, importing, replication, report
from ..operators import duplicates as D
from ..operators.catalog import resolve_hashes
from ..operators.ledger import COUNTERS, import_decisions, ledger_rows, payload, protected, rehashed, with_store
from ..operators.running import dealt_by_weight
from ..schema import CATALOG
from ..sources.bucketed import read_bucketed, write_bucketed
from ..sources.listing import store_listing
from ..sources.stores import FolderStore, Store, streamed_sha256
from . import effects, journal
from .control import Exit, RetrySettings, Settings, new_run_id, retried, run_file, write_whole, writer_lock
from .observed import written
from .shared import check_shared


@dataclass
class Outcome:
    code: Exit
    run_id: str
    ledger: DataFrame
    catalog: DataFrame
    divergent: DataFrame
    report: str
    events: DataFrame
    counters: dict[str, int] = field(default_factory=dict)  # of the ledger, by COUNTERS


def catalog_rows(listing: DataFrame, now: str) -> DataFrame:
    """A listing with content_hash as CATALOG's rows; markers and origin are read out of its metadata."""
    meta = lambda k: F.try_element_at("user_metadata", F.lit(k))
    return listing.select(
        "source", "key", "content_hash", "size_bytes", F.lit(now).alias("last_seen_at"), "last_modified", "content_type",
        meta(effects.QUARANTINED).alias("quarantined_at"), meta(effects.TOMBSTONED).alias("tombstoned_at"), meta(effects.ORIGIN).alias("origin"),
    )


def run(
    spark: SparkSession,
    settings: Settings,
    *,
    now: str,
    apply: bool = False,
    confirmed: bool = False,
    run_id: str | None = None,
    stores: Callable[[], dict[str, Store]] | None = None,
    confirm: Callable[[int, int], bool] | None = None,
) -> Outcome:
    """``stores`` makes the stores by name, in tasks too (clients are made where they are used); by default each
    source's root is a folder. ``confirm`` is asked with count and bytes before anything goes to quarantine; without a
    yes, that phase is planned only."""
    run_id = run_id or new_run_id()
    folder = settings.runtime.folder
    check_shared(spark, folder)
    with writer_lock(f"{folder}/lock", run_id):
        return _run(spark, settings, now, apply, confirmed, run_id, folder, stores, confirm)


def _paths(spark: SparkSession, pointer: str):
    new, now, old = (spark._jvm.org.apache.hadoop.fs.Path(pointer + end) for end in (".new", "", ".old"))
    return now.getFileSystem(spark._jsc.hadoopConfiguration()), new, now, old


def replace_catalog(spark: SparkSession, pointer: str) -> None:
    """The catalog written beside takes the place of the one before; at every moment one of them is whole."""
    fs, new, now, old = _paths(spark, pointer)
    fs.delete(old, True)
    if fs.exists(now):
        fs.rename(now, old)
    fs.rename(new, now)
    fs.delete(old, True)


def settled_catalog(spark: SparkSession, pointer: str) -> bool:
    """Whether there is a catalog; a replacement that was cut short is ended, or undone where the new one isn't whole."""
    fs, new, now, old = _paths(spark, pointer)
    whole = spark._jvm.org.apache.hadoop.fs.Path(new, "_SUCCESS")
    if not fs.exists(now) and fs.exists(old):
        fs.rename(new if fs.exists(whole) else old, now)
    return fs.exists(now)


def _run(spark: SparkSession, settings: Settings, now: str, apply: bool, confirmed: bool, run_id: str, folder: str, stores: Callable | None, confirm: Callable | None) -> Outcome:
    named = {s.name: s for s in reversed(settings.sources)}  # of a repeated name the first one counts
    roots, kinds = {n: s.root for n, s in named.items()}, {n: s.kind for n, s in named.items()}
    writable = settings.replicated
    if stores:
        stores()  # a store that is out of reach as such ends the run before anything happens
    factory = stores or (lambda: {n: FolderStore(r, kinds[n] != "google_drive") for n, r in roots.items()})
    step = iter(range(100))

    counts: dict[str, dict[str, int]] = {}  # counters of the tables, by name, taken in passing

    def kept(df: DataFrame, name: str, **counters: Column) -> DataFrame:
        out, counts[name] = written(df, f"{folder}/runs/{run_id}/{next(step)}-{name}", counters)
        return out

    runs, told = f"{folder}/runs", f"{folder}/ledger"
    journal.recover(spark, runs, told)  # of runs that ended early
    pointer = f"{folder}/catalog"
    there = settled_catalog(spark, pointer)
    # Read where it lies: nothing replaces it before the run's last step.
    before = read_bucketed(spark, os.path.abspath(pointer), CATALOG) if there else spark.createDataFrame([], CATALOG)
    cold = before.isEmpty()
    destructive = apply and (confirmed or not cold)

    found = kept(store_listing(spark, [*roots], factory, known=None if cold else before), "listing")
    failed_lists = found.where("list_error IS NOT NULL").select("source", "list_error")
    unlisted = [r.source for r in failed_lists.select("source").distinct().collect()]  # of the settings' few sources
    listing_errors = failed_lists.select(F.lit("list-error").alias("action"), F.lit("error").alias("result"), "source", F.col("list_error").alias("error"))
    if unlisted and cold:
        rows = kept(ledger_rows(listing_errors, run_id=run_id, timestamp=now), "ledger")
        none = spark.createDataFrame([], CATALOG)
        nothing = drift.divergent_hashes(none, settings.replicated)
        return Outcome(Exit.COLD_START_LISTING_FAILED, run_id, rows, none, nothing, "", drift.drift_events(nothing, sources_of(spark, settings).selectExpr("source", "0L AS new", "0L AS removed")))
    # A store that couldn't be listed to its end is as the last run knew it, not empty.
    listed = found.where("list_error IS NULL").drop("list_error").where(~F.col("source").isin(*unlisted))
    tried = kept(resolve_hashes(listed, before, _store_hashes(factory, settings.retries, kept)), "hashed")
    hashed = tried.where("content_hash IS NOT NULL")
    # An object that couldn't be read is as the last run knew it, not gone.
    unread = tried.where("content_hash IS NULL").select("source", "key", "hash_error")
    known = before.join(unread.select("source", "key"), ["source", "key"], "left_semi").select(*CATALOG.names)
    known = known.union(before.where(F.col("source").isin(*unlisted)).select(*CATALOG.names))
    # Only copies that this run has seen protect others, or are removed.
    seen_now = kept(catalog_rows(hashed, now), "seen")
    catalog = kept(seen_now.unionByName(known), "catalog")
    sources = sources_of(spark, settings)
    streamed = ~F.coalesce(F.col("hash_from").isin("tag", "cache"), F.lit(False))
    sections = [
        ("objects", report.per_source_counts(catalog, sources), "source"),
        ("hashes by kind", report.cross_kind_partition(catalog, sources), "s3_only"),
        ("duplicate groups by source", report.duplicate_groups_per_source(catalog), "source"),
        ("duplicate groups across sources", report.cross_source_groups(catalog), "groups"),
        ("bytes to hash", report.bytes_where(tried, streamed), "bytes"),
    ]
    if settings.imports.source:
        pulled = hashed.where(F.col("source") == settings.imports.source)
        sections.append(("files to import", importing.would_import(pulled, catalog, settings.replicated), "files"))
    text = "".join(report.render(title, df, [order]) for title, df, order in sections)
    write_whole(f"{folder}/{run_file('reconciliation', now, run_id)}", text)

    reading = unread.select(F.lit("hash-error").alias("action"), F.lit("error").alias("result"), "source", "key", F.col("hash_error").alias("error"))
    ledger = [ledger_rows(x, run_id=run_id, timestamp=now) for x in (reading, listing_errors, rehashed(hashed, before))]

    def settle(decisions: DataFrame, name: str, act: bool, refused: bool = False) -> DataFrame:
        decisions = kept(with_store(decisions, sources), f"{name}-planned", effects=F.count_if(effects.touches()))
        if act and counts[f"{name}-planned"]["effects"]:
            notes = {"run_id": run_id, "timestamp": now}
            done = effects.carry_out(decisions, factory, now, settings.retries, settings.runtime.max_concurrent_transfers, journal=f"{os.path.abspath(folder)}/runs/{run_id}/journal/{name}", told=notes)
            decisions = kept(done, name)
        elif not act and (refused or not apply or not destructive):
            decisions = decisions.withColumn("result", F.when(F.col("result").isin("success", "quarantined", "deleted"), "planned").otherwise(F.col("result")))
        ledger.append(ledger_rows(decisions, run_id=run_id, timestamp=now))
        return decisions

    policy, names = settings.replication, settings.replicated
    # Duplicates in a store that nobody may write to are none of this run's business.
    quarantine = D.quarantine_decisions(seen_now, settings.duplicates.canonical_source_priority, writable)
    chosen = F.col("result") == "quarantined"
    quarantine = kept(quarantine.where(F.col("source").isin(*writable)), "quarantine-decided", objects=F.count_if(chosen), bytes=F.sum(F.when(chosen, F.col("size_bytes"))))
    go = destructive
    if destructive and confirm:
        batch = counts["quarantine-decided"]
        go = not batch["objects"] or confirm(batch["objects"], batch["bytes"])
    settle(protected(quarantine, "quarantine"), "quarantine", destructive and go, destructive and not go)
    settle(protected(D.expired_quarantine_deletes(seen_now, now, settings.duplicates.quarantine_retention_days), "physical-delete"), "expired", destructive)
    plan = replication.replication_plan(catalog, names, policy.pairs or None)
    decided = replication.replication_decisions(plan, catalog, policy.on_key_conflict, allow_destructive=destructive)
    copied = settle(decided, "replicate", apply)
    if settings.imports.source:
        files = hashed.where(F.col("source") == settings.imports.source)
        imports = importing.import_plan(files, catalog, names)
        settle(import_decisions(imports, settings.imports.source, settings.imports.destination), "import", apply)
    if policy.delete_propagation != "none":
        settle(protected(deletion.tombstone_decisions(before, catalog, names, writable), "tombstone"), "tombstones", destructive)
        if policy.delete_propagation == "hard":
            settle(protected(D.tombstone_deletes(seen_now, now, policy.tombstone_retention_days), "physical-delete"), "tombstone-deletes", destructive)

    found = kept(store_listing(spark, [*roots], factory, known=catalog), "after")
    unlisted = [r.source for r in found.where("list_error IS NOT NULL").select("source").distinct().collect()]
    after = found.where("list_error IS NULL").drop("list_error").where(~F.col("source").isin(*unlisted))
    seen = after.withColumn("content_hash", F.try_element_at("user_metadata", F.lit(effects.HASH))).where(valid_hash(F.col("content_hash"))).select("source", "key", "content_hash")
    seen = seen.union(catalog.where(F.col("source").isin(*unlisted)).select("source", "key", "content_hash"))
    errors = copied.where("action = 'replication-error' AND content_hash IS NOT NULL").select("content_hash")
    divergent = kept(drift.divergent_hashes(seen, names, errors), "divergent")
    changes = sources.select("source").join(drift.new_and_removed(before, catalog), "source", "left").na.fill(0)
    events = kept(drift.drift_events(divergent, changes), "events")
    flags = {"cold_start": cold, "dry_run": not apply, "apply": apply, "first_pass_confirmed": confirmed}
    summary = {"discovered": counts["catalog"]["rows"], "divergent_hashes_count": counts["divergent"]["rows"]} | {k: str(v).lower() for k, v in flags.items()}
    summary = spark.range(1).select(F.lit("summary").alias("action"), F.lit("success").alias("result"), payload(**{k: F.lit(v) for k, v in summary.items()}).alias("extra"))
    ledger.append(ledger_rows(summary, run_id=run_id, timestamp=now))
    rows = ledger[0]
    for more in ledger[1:]:
        rows = rows.unionByName(more)
    counted = {n: F.count_if((F.col("action") == a) & (F.col("result") == r)) for n, (a, r) in COUNTERS.items()}
    rows = kept(rows, "ledger", failed=F.count_if(F.col("result") == "error"), conflicts=F.count_if(F.col("action") == "key-conflict"), **counted)
    journal.close(spark, runs, run_id, rows, told, settings.runtime.keep_runs)
    if destructive:
        left = kept(resolve_hashes(after, catalog, _store_hashes(factory, settings.retries, kept)), "hashed-after")
        known = before.join(left.where("content_hash IS NULL"), ["source", "key"], "left_semi").select(*CATALOG.names)
        known = known.union(catalog.where(F.col("source").isin(*unlisted)).select(*CATALOG.names))
        write_bucketed(catalog_rows(left.where("content_hash IS NOT NULL"), now).unionByName(known), f"{os.path.abspath(pointer)}.new", counts["after"]["rows"])
        replace_catalog(spark, pointer)
    failed = counts["ledger"]["failed"] > 0
    conflict = policy.fail_on_conflict and counts["ledger"]["conflicts"] > 0
    drifted = policy.fail_on_inconsistency and counts["divergent"]["rows"] > 0
    code = Exit.FIRST_PASS_REVIEW_REQUIRED if apply and not destructive else Exit.INCONSISTENCY_DETECTED if drifted else Exit.CONFLICT_FAILURE if conflict else Exit.RUN_HAD_ERRORS if failed else Exit.OK
    return Outcome(code, run_id, rows, catalog, divergent, text, events, {n: counts["ledger"][n] for n in COUNTERS})


def sources_of(spark: SparkSession, settings: Settings) -> DataFrame:
    """source, kind: of a repeated name the first one counts."""
    return spark.createDataFrame([*{s.name: s.kind for s in reversed(settings.sources)}.items()], "source string, kind string")


#: What opening an object costs, in bytes that could be read meanwhile; and bytes that a task reads, more or less.
OPENING, TASK_BYTES = 1 << 18, 1 << 30


def _store_hashes(factory: Callable[[], dict[str, Store]], retries: RetrySettings, kept: Callable[[DataFrame, str], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """Adds content_hash and hash_error to rows, streaming each object in chunks; contents never leave the reader.

    Objects are dealt to tasks by their bytes, not by their rows: a large one alone, small ones together.
    """

    def hashes(rows: DataFrame) -> DataFrame:
        rows = kept(rows, "to-hash") if kept else rows  # read more than once
        spark = rows.sparkSession
        load = F.greatest(F.coalesce("size_bytes", F.lit(0)), F.lit(0)) + OPENING if "size_bytes" in rows.columns else F.lit(OPENING)
        total = rows.agg(F.sum(load)).first()[0] or 0
        tasks = min(max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES)), 50_000)
        names = rows.columns
        schema = T.StructType([*rows.schema, T.StructField("content_hash", T.StringType()), T.StructField("hash_error", T.StringType())])

        def one(stores: dict[str, Store], source: str, key: str) -> tuple[str | None, str | None]:
            try:
                return retried(lambda: streamed_sha256(stores[source].read(key)), retries), None
            except Exception as e:  # noqa: BLE001  any failure is a row of the ledger
                return None, f"{type(e).__name__}: {e}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stores = factory()
            for batch in batches:
                at = {n: batch.column(i) for i, n in enumerate(names)}
                found = [one(stores, s, k) for s, k in zip(at["source"].to_pylist(), at["key"].to_pylist(), strict=True)]
                told = [pa.array([x[i] for x in found], pa.string()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *told], names=[*names, "content_hash", "hash_error"])

        return dealt_by_weight(rows, load, ["source", "key"], tasks).mapInArrow(run, schema)

    return hashes
