"""Column helpers that operators share. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH = r"\A[0-9a-f]{64}\z"
_ISO = r"\A\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.]\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?\z"


def valid_hash(c: Column) -> Column:
    """64 lower-case hexadecimal digits; null is false."""
    return F.coalesce(c.rlike(HASH), F.lit(False))


def compact_hash(c: Column) -> Column:
    """The string in about half the bytes, for shuffles: one byte of kind, then a sound hash's 32 bytes or any other text's UTF-8. One to one."""
    return F.when(valid_hash(c), F.concat(F.lit(b"\x01"), F.unhex(c))).otherwise(F.concat(F.lit(b"\x00"), F.encode(c, "UTF-8")))


def full_hash(c: Column) -> Column:
    """What ``compact_hash`` was made of."""
    rest = F.substring(c, 2, 2**31 - 1)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8"))


def valid_size(c: Column) -> Column:
    return F.coalesce(c >= 0, F.lit(False))


def live() -> Column:
    """Neither quarantined nor tombstoned. An empty marker is a marker."""
    return F.col("quarantined_at").isNull() & F.col("tombstoned_at").isNull()


def parse_iso(c: Column) -> Column:
    """Timestamp of an ISO-8601 string, taken as UTC without an offset; null if it is none."""
    t = F.btrim(c)
    return F.when(t.rlike(_ISO), F.try_to_timestamp(t))


def to_millis(ts: Column) -> Column:
    return F.date_trunc("MILLISECOND", ts)


def format_seconds(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def format_millis(ts: Column) -> Column:
    """Truncated, not rounded."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def format_compact(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd'T'HHmmss'Z'")


def expired(marker: Column, now: str, retention_days: int) -> Column:
    """Whether the marker is as old as the retention; one that doesn't parse never is."""
    age = F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(parse_iso(marker))
    return F.coalesce(age >= retention_days * 86_400_000_000, F.lit(False))


def source_rank(source: Column, priority: Sequence[str]) -> Column:
    """Place in the priority list, the first one of a repeated name; null if it isn't listed."""
    if not priority:
        return F.lit(None).cast("int")
    return F.nullif(F.array_position(F.array(*map(F.lit, priority)), source), F.lit(0)).cast("int")


def single_part_etag(etag: Column) -> Column:
    """An ETag that is the object's MD5: 32 lower-case hexadecimal digits once quotes are gone."""
    bare = F.regexp_replace(F.btrim(etag), r'\A"+|"+\z', "")
    return F.coalesce(bare.rlike(r"\A[0-9a-f]{32}\z"), F.lit(False))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def sanitised(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9._-]", "_")


def year_month(created: Column) -> tuple[Column, Column]:
    ts = parse_iso(created)
    return F.coalesce(F.date_format(ts, "yyyy"), F.lit("unknown-year")), F.coalesce(F.date_format(ts, "MM"), F.lit("unknown-month"))


def import_key(key: Column, file_id: Column, path: Column, created: Column, root: str = "google-drive") -> Column:
    """root/year/month/id__name; an empty id or path falls back to the key."""
    year, month = year_month(created)
    full = lambda c: F.coalesce(F.nullif(c, F.lit("")), key)
    return F.concat(F.concat_ws("/", F.lit(root), year, month, full(file_id)), F.lit("__"), sanitised(basename(full(path))))


def renamed_key(key: Column, content_hash: Column) -> Column:
    return F.concat(key, F.lit("."), F.substring(content_hash, 1, 8))


#: HTTP codes worth another try.
TRANSIENT_HTTP = (408, 429, 500, 502, 503, 504)


def http_class(status: Column, absent_ok: bool = False) -> Column:
    out = F.when(status.isin(*TRANSIENT_HTTP), "transient")
    if absent_ok:
        out = out.when(status == 404, "absent")
    return out.when((status >= 200) & (status < 300), "ok").otherwise("non_transient")


def retry_after(value: Column) -> Column:
    """Seconds of a Retry-After header; null unless it is a number from zero up."""
    n = F.btrim(value).try_cast("double")
    return F.when((n >= 0) & ~F.isnan(n), n)


def retry_wait_ms(attempt: Column, retry_after_ms: Column, initial_ms: int = 500, cap_ms: int = 30_000) -> Column:
    """Wait before retry ``attempt`` (from 0): doubled each time, at least what the server asks, capped."""
    backoff = F.least(F.lit(initial_ms) * F.pow(F.lit(2), attempt), F.lit(cap_ms)).cast("long")
    return F.least(F.greatest(backoff, F.coalesce(retry_after_ms, F.lit(0))), F.lit(cap_ms)).cast("long")


# Content types by file extension.
CONTENT_TYPES = {
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".gif": "image/gif", ".heic": "image/heic", ".webp": "image/webp",
    ".mp4": "video/mp4", ".mov": "video/quicktime", ".m4v": "video/x-m4v", ".txt": "text/plain", ".bin": "application/octet-stream",
}


def guess_content_type(key: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    ext = F.when(F.instr(key, ".") > 0, F.concat(F.lit("."), F.substring_index(F.lower(key), ".", -1)))
    return F.coalesce(F.try_element_at(table, F.coalesce(ext, F.lit(""))), F.lit("application/octet-stream"))


def merged_metadata(metadata: Column, tags: Column, tags_win: bool = True) -> Column:
    """One map of both; on equal names the winner's value, whatever the session's map policy."""
    a, b = (metadata, tags) if tags_win else (tags, metadata)
    empty = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(a, empty), F.coalesce(b, empty)
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
