"""Registered queries of the catalog engine over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.redaction import redact_map, redact_text
from ..operators import catalog as K
from ..operators import deletion, drift, importing, replication, report
from ..operators import duplicates as D
from ..operators import ledger as L
from ..operators.running import numbered
from ..schema import CATALOG, LEDGER
from ..sources import jsonl, trees
from ..streaming import catalog as stream
from . import views as V
from .effects import HASH, ORIGIN, QUARANTINED, TOMBSTONED
from .run import catalog_rows
from .shared import new_folder

Query = Callable[[SparkSession, str], DataFrame]
_all: dict[str, Query] = {}


def _query(f: Query) -> Query:
    _all[f.__name__] = f
    return f


def _flat(groups: DataFrame) -> DataFrame:
    return groups.select("content_hash", "size_bytes", "copies", "label", "total_bytes", F.array_join(F.transform("members", lambda m: F.concat_ws("|", m["source"], m["key"])), ",").alias("members"))


@_query
def dup_groups(s, d):
    return _flat(D.duplicate_groups(V.catalog4(s, d)))


@_query
def dup_groups_skipped(s, d):
    bad = F.when(F.col("doc_id") % 17 == 0, F.upper("content_hash")).otherwise(F.col("content_hash"))
    size = F.when(F.col("doc_id") % 19 == 0, -F.col("size_bytes")).otherwise(F.col("size_bytes"))
    return D.split_valid(V.catalog4(s, d).withColumn("content_hash", bad).withColumn("size_bytes", size))[1].select("source", "key")


@_query
def canonical_pick(s, d):
    return D.canonical_members(V.catalog4(s, d), V.PRIORITY).select("source", "key", "content_hash", "rn", (F.col("rn") == 1).alias("is_canonical"))


@_query
def priority_warning(s, d):
    rows = D.canonical_members(V.catalog4(s, d), V.PRIORITY)
    return rows.where("rn = 1").select("content_hash", "size_bytes", "priority_warning")


@_query
def removal_plan(s, d):
    return D.removal_plan(V.catalog4(s, d), V.PRIORITY).select("source", "key", "content_hash", "size_bytes")


@_query
def quarantine_decisions(s, d):
    return D.quarantine_decisions(V.catalog4(s, d), V.PRIORITY, V.REPLICATED)


@_query
def quarantine_dry_run(s, d):
    return D.quarantine_decisions(V.catalog4(s, d), V.PRIORITY, dry_run=True)


@_query
def expired_quarantine_deletes(s, d):
    return D.expired_quarantine_deletes(V.catalog4(s, d), V.NOW, 30)


@_query
def tombstone_deletes(s, d):
    return D.tombstone_deletes(V.catalog4(s, d), V.NOW, 30)


@_query
def live_copy_counts(s, d):
    return D.live_copies(V.catalog4(s, d))


@_query
def live_copy_counts_replicated(s, d):
    names = s.createDataFrame([(n,) for n in V.REPLICATED], "source string")
    return D.live_copies(V.catalog4(s, d), names)


@_query
def quarantine_batch(s, d):
    return report.batch_size(D.removal_plan(V.catalog4(s, d), V.PRIORITY))


@_query
def replication_plan(s, d):
    return replication.replication_plan(V.catalog4(s, d), V.REPLICATED).select("src", "dst", "content_hash", "key", "size_bytes")


@_query
def loop_guard(s, d):
    return replication.loop_guard(replication.replication_plan(V.catalog4(s, d), V.REPLICATED)).where("guard = 'loop-skip'").select("src", "dst", "content_hash", "key")


@_query
def source_tagging(s, d):
    return replication.loop_guard(replication.replication_plan(V.catalog4(s, d), V.REPLICATED)).where("guard = 'source-tagged'").select("src", "dst", "content_hash", "key")


def _conflicts(policy: str) -> None:
    def run(s: SparkSession, d: str) -> DataFrame:
        c = V.catalog20(s, d)
        out = replication.resolve_conflicts(replication.replication_plan(c, V.FOUR), c, policy)
        return out.select("src", "dst", "key", "content_hash", "action", "previous_content_hash", "renamed_key")

    _all[f"conflict_{policy}"] = run


for _policy in ("skip", "rename", "overwrite"):
    _conflicts(_policy)


def _before_and_now(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = V.catalog4(s, d)
    return c.where("doc_id % 10 <> 3"), c.where("doc_id % 10 <> 7")


@_query
def missing_records(s, d):
    before, now = _before_and_now(s, d)
    return deletion.missing_records(before, now, V.REPLICATED).select("source", "key", "content_hash")


@_query
def tombstone_propagation(s, d):
    before, now = map(_four_alike, _before_and_now(s, d))
    return deletion.tombstone_decisions(before, now, V.REPLICATED, ["s3-prod", "gcs-archive"])


@_query
def per_source_counts(s, d):
    return report.per_source_counts(V.catalog4(s, d))


@_query
def cross_kind_partition(s, d):
    return report.cross_kind_partition(V.catalog4(s, d), V.sources(s))


@_query
def dup_groups_per_source(s, d):
    return report.duplicate_groups_per_source(V.catalog4(s, d))


@_query
def cross_source_groups(s, d):
    return report.cross_source_groups(V.catalog20(s, d))


@_query
def bytes_to_hash(s, d):
    return report.bytes_where(V.catalog4(s, d), F.col("doc_id") % 3 == 0)


@_query
def new_removed_counts(s, d):
    return drift.new_and_removed(*_before_and_now(s, d))


@_query
def divergent_hashes(s, d):
    out = drift.divergent_hashes(V.catalog4(s, d), V.REPLICATED)
    return out.select("content_hash", F.array_join("present_in", ",").alias("present_in"), F.array_join("absent_from", ",").alias("absent_from"), F.col("canonical.source").alias("source"), F.col("canonical.key").alias("key"))


@_query
def drift_events(s, d):
    out = drift.drift_events(drift.divergent_hashes(V.catalog4(s, d), V.REPLICATED), drift.new_and_removed(*_before_and_now(s, d)))
    detail = F.array_join(F.transform(F.map_entries("detail"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.withColumns({"present_in": F.array_join("present_in", ","), "absent_from": F.array_join("absent_from", ","), "detail": detail})


def _listing(s: SparkSession, d: str) -> DataFrame:
    c = V.catalog4(s, d)
    told = F.when(F.col("doc_id") % 4 == 0, F.create_map(F.lit("content-sha256"), F.col("content_hash"))).when(F.col("doc_id") % 4 == 1, F.create_map(F.lit("content-sha256"), F.lit("nonsense")))
    size = F.when(F.col("doc_id") % 6 == 0, F.col("size_bytes") + 1).otherwise(F.col("size_bytes"))
    return c.select("source", "key", size.alias("size_bytes"), "last_modified", told.alias("user_metadata"))


@_query
def hash_cache_lookup(s, d):
    return K.cached_hash(_listing(s, d), V.catalog4(s, d)).select("source", "key", "cached_hash")


@_query
def hash_resolution(s, d):
    texts = V.read(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    contents = V.catalog4(s, d).select("doc_id", "source", "key").join(texts, "doc_id")
    return K.resolve_hashes(_listing(s, d), V.catalog4(s, d), contents).select("source", "key", "content_hash", "hash_from")


@_query
def import_classification(s, d):
    return V.catalog20(s, d).select("doc_id", importing.import_class(F.col("content_type")).alias("class"))


def _files(s: SparkSession, d: str) -> DataFrame:
    c = V.catalog4(s, d).where("source = 'drive-folder'")
    created = F.when(F.col("doc_id") % 9 == 0, "not-a-date").otherwise(F.col("last_modified"))
    meta = F.create_map(F.lit("drive_path"), F.col("key"), F.lit("createdTime"), created)
    return c.select("doc_id", "key", "content_type", "content_hash", meta.alias("user_metadata"))


@_query
def import_plan(s, d):
    return importing.import_plan(_files(s, d), V.catalog4(s, d), V.REPLICATED).select("key", "action", "destination_key", "time_warning")


@_query
def import_stats(s, d):
    return importing.import_stats(importing.import_plan(_files(s, d), V.catalog4(s, d), V.REPLICATED))


@_query
def would_import(s, d):
    return importing.would_import(_files(s, d), V.catalog4(s, d), V.REPLICATED)


@_query
def destination_keys(s, d):
    p = V.read(s, d, "pages")
    created = F.when(F.col("page_id") % 5 == 0, "2024-13-40T99:99:99Z").otherwise(F.concat(F.lit("20"), F.lpad((F.col("page_id") % 30).cast("string"), 2, "0"), F.lit("-06-30T08:15:30Z")))
    return p.select("page_id", C.import_key(F.concat(F.lit("k"), F.col("page_id").cast("string")), F.lit(""), F.col("url"), created).alias("destination_key"))


@_query
def sanitise_names(s, d):
    return V.read(s, d, "pages").select("page_id", C.sanitised(C.basename(F.col("url"))).alias("name"))


@_query
def upsert_latest(s, d):
    return K.upsert(V.read(s, d, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn", "text")


@_query
def catalog_remove(s, d):
    before, now = _before_and_now(s, d)
    return K.remove(before, now).select("source", "key", "content_hash")


def _secret(text):
    return F.concat(text, F.lit(" Bearer abc.def-1 and X-Amz-Signature=0aF9 or 1//tok_en, ya29.x-y aws_secret_access_key=" + "A" * 40 + " end"))


@_query
def redact_strings(s, d):
    return V.read(s, d, "documents").select("doc_id", redact_text(_secret(F.col("text"))).alias("text"))


@_query
def redact_maps(s, d):
    docs = V.read(s, d, "documents")
    m = redact_map(F.create_map(F.lit("Authorization"), F.col("lang"), F.lit("note"), _secret(F.col("source"))))
    return docs.select("doc_id", F.try_element_at(m, F.lit("Authorization")).alias("authorization"), F.try_element_at(m, F.lit("note")).alias("note"))


@_query
def http_classification(s, d):
    status = (F.col("event_id") % 500 + 100).cast("int")
    return V.read(s, d, "events").select("event_id", C.http_class(status).alias("plain"), C.http_class(status, True).alias("probe"))


@_query
def etag_singlepart(s, d):
    i = F.col("doc_id")
    md5 = F.md5(F.encode("text", "UTF-8"))
    tag = F.when(i % 4 == 0, F.concat(F.lit('"'), md5, F.lit('"'))).when(i % 4 == 1, F.concat(md5, F.lit("-3"))).when(i % 4 == 2, F.upper(md5)).otherwise(md5)
    return V.read(s, d, "documents").select("doc_id", C.single_part_etag(tag).alias("single_part"))


@_query
def retry_waits(s, d):
    e = V.read(s, d, "events")
    after = C.retry_after(F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 40).cast("string")).when(F.col("event_id") % 3 == 1, "soon"))
    return e.select("event_id", C.retry_wait_ms(F.col("event_id") % 8, (after * 1000).cast("long")).alias("wait_ms"))


@_query
def content_types(s, d):
    ext = F.when(F.col("page_id") % 4 == 0, ".JPG").when(F.col("page_id") % 4 == 1, ".mov").when(F.col("page_id") % 4 == 2, ".xyz").otherwise("")
    return V.read(s, d, "pages").select("page_id", C.guess_content_type(F.concat(F.lit("a"), F.col("page_id").cast("string"), ext)).alias("content_type"))


@_query
def timestamps(s, d):
    ts = F.col("ts")
    return V.read(s, d, "events").select("event_id", C.format_seconds(ts).alias("seconds"), C.format_millis(ts).alias("millis"), C.format_compact(ts).alias("compact"))


@_query
def ledger_action_counts(s, d):
    return L.action_counts(V.ledger(s, d))


@_query
def replication_counters(s, d):
    """All decisions about copies and deletions of one catalog, as the ledger would hold them."""
    c20, c4 = V.catalog20(s, d), V.catalog4(s, d)
    done = F.when(F.col("action").isin("replicate", "rename", "overwrite"), "success").otherwise("skipped")
    copies = replication.resolve_conflicts(replication.replication_plan(c20, V.FOUR), c20, "rename").select("action", done.alias("result"))
    guard = replication.loop_guard(replication.replication_plan(c4, V.REPLICATED)).where("guard IS NOT NULL")
    guard = guard.select(F.col("guard").alias("action"), F.when(F.col("guard") == "loop-skip", "skipped").otherwise("success").alias("result"))
    rows = copies.unionByName(guard).unionByName(D.tombstone_deletes(c4, V.NOW, 30).select("action", "result")).unionByName(V.ledger(s, d).select("action", "result"))
    return L.replication_counters(rows)


def _four_alike(df: DataFrame) -> DataFrame:
    """Four neighbours share a hash, so that vanished objects have copies elsewhere."""
    return df.withColumn("content_hash", F.sha2(F.encode(F.floor(F.col("doc_id") / 4).cast("string"), "UTF-8"), 256))


@_query
def ledger_payloads(s, d):
    """The ledger of one catalog's decisions of all kinds, with what each action tells besides."""
    c20, c4 = V.catalog20(s, d), V.catalog4(s, d)
    before, now = map(_four_alike, _before_and_now(s, d))
    decisions = [
        L.protected(D.quarantine_decisions(c4, V.PRIORITY, V.REPLICATED), "quarantine"),
        L.protected(D.tombstone_deletes(c4, V.NOW, 30), "physical-delete"),
        L.protected(deletion.tombstone_decisions(before, now, V.REPLICATED, ["s3-prod", "gcs-archive"]), "tombstone"),
        L.import_decisions(importing.import_plan(_files(s, d), c4, V.REPLICATED), "drive-folder", "s3-prod"),
        *(replication.replication_decisions(replication.replication_plan(c20, V.FOUR), c20, policy) for policy in ("rename", "overwrite")),
    ]
    rows = [L.ledger_rows(x, run_id="r", timestamp=V.NOW) for x in decisions]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    extra = F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return out.select("action", "result", "source", "target", "key", "content_hash", "size_bytes", extra.alias("extra"))


@_query
def replication_error_hashes(s, d):
    return L.replication_error_hashes(V.ledger(s, d))


@_query
def catalog_export_order(s, d):
    return K.export_order(V.catalog4(s, d)).select("content_hash", "source", "key")


@_query
def run_summary(s, d):
    c = V.catalog4(s, d)
    return report.run_summary(c, cold_start=True, dry_run=False, apply=True, confirmed=True, divergent=drift.divergent_hashes(c, V.REPLICATED))


@_query
def lineitem_dup_bench(s, d):
    """Groups of equal lines, the largest catalog here."""
    out = V.read(s, d, "lineitem").groupBy("l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("l_quantity"))
    return out.agg(F.count("*").alias("copies"), F.min("l_orderkey").alias("first_order"), F.count_distinct("l_shipdate").alias("dates")).where("copies >= 2")


@_query
def catalog_round_trip(s, d):
    """The catalog out to one ordered file of lines, and back through the strict reader."""
    c = V.catalog4(s, d).withColumn("content_type", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('q"\\é\n'), F.substring_index("key", "/", 1)))).select(*CATALOG.names)
    path = f"{new_folder(s, 'export')}/catalog.jsonl"
    jsonl.write_catalog(c, path)
    return jsonl.read_catalog(s, path)


@_query
def ledger_line_errors(s, d):
    """Lines of a ledger of which some are broken, by what is wrong with them; sound ones count under 'none'."""
    key = F.concat_ws("/", "event_type", F.col("user_id").cast("string"))
    told = V.read(s, d, "events").select(F.lit("replicate").alias("action"), F.lit("success").alias("result"), F.lit("a").alias("source"), key.alias("key"), F.col("event_id").alias("size_bytes"), L.payload(more=F.col("props")).alias("extra"))
    lines = jsonl.to_lines(L.ledger_rows(told, run_id="r", timestamp=V.NOW), LEDGER)
    kind, even = F.regexp_extract("value", '"key":"([a-z]+)', 1), F.regexp_extract("value", '"key":"[a-z]+/([0-9]+)', 1).cast("long") % 2 == 0
    broken = (
        F.when((kind == "view") & even, F.expr("substr(value, 1, length(value) - 1)")).when((kind == "signup") & even, F.regexp_replace("value", r"^\{", '{"more":1,')).when((kind == "click") & even, F.replace("value", F.lit('"error":null,'), F.lit("")))
        .when((kind == "purchase") & even, F.replace("value", F.lit('"action":"replicate"'), F.lit('"action":"dance"'))).when((kind == "error") & even, F.replace("value", F.lit('"source":"a"'), F.lit('"source":5')))
    )
    path = new_folder(s, "ledger")
    lines.select(F.coalesce(broken, "value").alias("value")).write.text(path)
    good, bad = jsonl.read_ledger(s, path)
    rows = good.select(F.lit("none").alias("category"), F.substring_index("key", "/", 1).alias("message")).unionByName(bad.select("category", "message"))
    return rows.withColumn("message", F.when(F.col("category") == "json_syntax", "").otherwise(F.col("message"))).groupBy("category", "message").agg(F.count("*").alias("n"))


@_query
def merged_metadata(s, d):
    """An object's metadata and tags as one map, as stores where tags win and where metadata wins tell it."""
    docs = V.read(s, d, "documents")
    metadata = F.when(F.col("doc_id") % 7 != 0, F.create_map(F.lit("lang"), F.col("lang"), F.lit("name"), F.col("source")))
    tags = F.when(F.col("doc_id") % 5 != 0, F.create_map(F.lit("name"), F.upper("source"), F.lit("size"), F.col("n_chars").cast("string")))
    text = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return docs.select("doc_id", text(C.merged_metadata(metadata, tags)).alias("tags_win"), text(C.merged_metadata(metadata, tags, False)).alias("metadata_wins"))


@_query
def tree_paths(s, d):
    """Paths of the files of a folder tree: regions hold nations, nations hold customers."""
    part = lambda t, key, parent, name, folder: V.read(s, d, t).select(key.alias("id"), parent.alias("parent"), F.col(name).alias("name"), F.lit(folder).alias("is_folder"))
    at = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    entries = part("region", at("r", "r_regionkey"), F.lit("root"), "r_name", True).union(part("nation", at("n", "n_nationkey"), at("r", "n_regionkey"), "n_name", True)).union(part("customer", at("c", "c_custkey"), at("n", "c_nationkey"), "c_name", False))
    return trees.tree_paths(s, entries, "root")


@_query
def decisions_without_store(s, d):
    """Decisions of a catalog whose sources are only partly configured: those about other stores are errors."""
    decisions = L.protected(D.quarantine_decisions(V.catalog4(s, d), V.PRIORITY, V.REPLICATED), "quarantine")
    plan = replication.replication_decisions(replication.replication_plan(V.catalog4(s, d), V.REPLICATED), V.catalog4(s, d))
    known = s.createDataFrame([("s3-prod",), ("gcs-archive",)], "source string")
    columns = ("action", "result", "source", "target", "key", "content_hash")
    both = decisions.withColumn("target", F.lit(None).cast("string")).select(*columns).unionByName(plan.select(*columns))
    return L.with_store(both, known)


@_query
def divergent_without_errors(s, d):
    """Hashes that some stores lack, without those whose copying failed."""
    c = V.catalog4(s, d)
    failed = L.ledger_rows(c.where("size_bytes % 3 = 0").select(F.lit("replication-error").alias("action"), F.lit("error").alias("result"), "content_hash"), run_id="r", timestamp=V.NOW)
    out = drift.divergent_hashes(c, V.REPLICATED, L.replication_error_hashes(failed))
    return out.select("content_hash", F.array_join("present_in", ",").alias("present_in"))


@_query
def listing_projection(s, d):
    """Listed objects whose announced hash is sound, as catalog rows: markers and origin come out of the metadata."""
    c = V.catalog4(s, d)
    told = F.when(F.col("doc_id") % 6 == 0, F.upper("content_hash")).when(F.col("doc_id") % 6 == 1, F.concat("content_hash", F.lit("\n"))).otherwise(F.col("content_hash"))
    meta = L.payload(**{HASH: told, QUARANTINED: F.col("quarantined_at"), TOMBSTONED: F.col("tombstoned_at"), ORIGIN: F.col("origin")})
    listed = c.select("source", "key", "size_bytes", "last_modified", "content_type", meta.alias("user_metadata")).withColumn("content_hash", F.try_element_at("user_metadata", F.lit(HASH)))
    return catalog_rows(listed.where(C.valid_hash(F.col("content_hash"))), V.NOW)


@_query
def streamed_bytes(s, d):
    """Bytes of the objects that neither a tag nor the last catalog resolves, by what resolved them."""
    texts = V.read(s, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    contents = V.catalog4(s, d).select("doc_id", "source", "key").join(texts, "doc_id")
    rows = K.resolve_hashes(_listing(s, d), V.catalog4(s, d), contents)
    return rows.groupBy("hash_from").agg(F.count("*").alias("objects"), F.sum("size_bytes").alias("bytes"))


@_query
def plan_in_order(s, d):
    """The replication plan with each row's place in it."""
    c = V.catalog4(s, d)
    return numbered(replication.replication_plan(c, V.REPLICATED), ("src", "dst", "content_hash"), "place", 3 * c.count()).select("place", "src", "dst", "content_hash", "key")


@_query
def groups_in_order(s, d):
    """Duplicate groups with their place in the order of hash and size."""
    c = V.catalog4(s, d)
    return numbered(D.group_facts(c), ("content_hash", "size_bytes"), "place", c.count()).select("place", "content_hash", "size_bytes", "copies", "label")


@_query
def divergence_in_order(s, d):
    """Divergent hashes with their place in the order of hashes."""
    c = V.catalog4(s, d)
    return numbered(drift.divergent_hashes(c, V.REPLICATED), ("content_hash",), "place", c.count()).select("place", "content_hash")


@_query
def streaming_catalog(s, d):
    """The catalog that a stream of listings leads to: documents as they are read, versions of a few keys in any order."""
    docs = s.readStream.schema(V.read(s, d, "documents").schema).parquet(f"{d}/documents.parquet*")
    seen = docs.select(
        "source", F.concat(F.col("lang"), F.lit("-"), F.floor(F.col("doc_id") / 100).cast("string")).alias("key"), F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("doc_id") * 37) % 1000).alias("seen_at"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("content_hash"), F.octet_length("text").cast("long").alias("size_bytes"),
    )
    folder = new_folder(s, "stream")
    stream.follow(seen, folder).awaitTermination()
    return stream.current(s, folder).withColumn("seen_at", F.unix_seconds("seen_at"))


def queries() -> dict[str, Query]:
    return dict(_all)
