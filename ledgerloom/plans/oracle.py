"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

from ..functions.redaction import AFTER, MASK, WHOLE

_DAY = "strftime(DATE '2024-01-01' + CAST({} AS INTEGER), '%Y-%m-%dT00:00:00Z')"
_CATALOG = f"""
cat20 AS (
  SELECT doc_id, source, lang || '/' || CAST(doc_id // 20 AS VARCHAR) AS key, sha256(text) AS content_hash, CAST(strlen(text) AS BIGINT) AS size_bytes,
    {_DAY.format("((doc_id * 37) % 30)")} AS last_seen_at, {_DAY.format("((doc_id * 11) % 28)")} AS last_modified,
    CASE doc_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'video/mp4' WHEN 2 THEN 'application/vnd.google-apps.document' WHEN 3 THEN 'text/plain' END AS content_type,
    CASE WHEN doc_id % 11 = 0 THEN {_DAY.format("(doc_id % 31)")} END AS quarantined_at,
    CASE WHEN doc_id % 13 = 0 AND doc_id % 11 <> 0 THEN {_DAY.format("(doc_id % 29)")} END AS tombstoned_at,
    CASE doc_id % 7 WHEN 0 THEN 's3-prod' WHEN 1 THEN 'gcs-archive' WHEN 2 THEN '' END AS origin
  FROM documents
), cat4 AS (
  SELECT * REPLACE (CASE doc_id % 20 % 4 WHEN 0 THEN 's3-prod' WHEN 1 THEN 'gcs-archive' WHEN 2 THEN 's3-cold' ELSE 'drive-folder' END AS source, key || '/' || source AS key) FROM cat20
), kinds(source, kind) AS (VALUES ('s3-prod', 's3'), ('gcs-archive', 'gcs'), ('s3-cold', 's3'), ('drive-folder', 'google_drive'))
"""
_W = f"WITH {_CATALOG}"
_LIVE = "quarantined_at IS NULL AND tombstoned_at IS NULL"
_REP = "('s3-prod', 'gcs-archive', 's3-cold')"
_RANK = "CASE source WHEN 'gcs-archive' THEN 1 WHEN 's3-prod' THEN 2 END"
_MEMBERS = f"""{_W}, members AS (
  SELECT *, count(*) OVER g AS copies, row_number() OVER (PARTITION BY content_hash, size_bytes ORDER BY {_RANK} NULLS LAST, last_seen_at, key, source) AS rn,
    max({_RANK}) OVER g IS NULL AS priority_warning
  FROM cat4 WINDOW g AS (PARTITION BY content_hash, size_bytes) QUALIFY copies >= 2
)"""


def _deletes(marker: str, other: str) -> str:
    return f"""{_W}, alive AS (SELECT content_hash FROM cat4 WHERE {_LIVE} GROUP BY content_hash)
SELECT source, key, content_hash, size_bytes, CASE WHEN a.content_hash IS NULL THEN 'last-copy-protection' ELSE 'physical-delete' END AS action,
  CASE WHEN a.content_hash IS NULL THEN 'skipped' ELSE 'deleted' END AS result
FROM cat4 LEFT JOIN alive a USING (content_hash)
WHERE {marker} IS NOT NULL AND {other} IS NULL AND TIMESTAMP '2024-02-10 12:00:00' - CAST(replace(replace({marker}, 'T', ' '), 'Z', '') AS TIMESTAMP) >= INTERVAL 30 DAY"""


def _plan(catalog: str, names: str) -> str:
    return f"""best AS (
  SELECT * FROM {catalog} WHERE {_LIVE} AND source IN {names} QUALIFY row_number() OVER (PARTITION BY source, content_hash ORDER BY last_seen_at, key) = 1
), plan AS (
  SELECT b.source AS src, d.source AS dst, b.content_hash, b.key, b.size_bytes, b.origin
  FROM best b JOIN (SELECT DISTINCT source FROM best) d ON b.source <> d.source
  WHERE NOT EXISTS (SELECT 1 FROM best h WHERE h.source = d.source AND h.content_hash = b.content_hash)
)"""


_PLAN4 = f"{_W}, {_plan('cat4', _REP)}"
_ROWS = f"""{_W}, {_plan("cat20", "('src0', 'src1', 'src2', 'src3')")}, rows_ AS (
  SELECT p.*, o.key IS NOT NULL AS dst_exists, o.content_hash AS dst_hash FROM plan p LEFT JOIN cat20 o ON o.source = p.dst AND o.key = p.key
  WHERE coalesce(nullif(p.origin, ''), '-') <> p.dst
)"""


def _kept(rows: str, key: str, first: str) -> str:
    return f"""SELECT *, CASE WHEN row_number() OVER w = 1 AND NOT dst_exists THEN '{first}'
    WHEN coalesce(content_hash = CASE WHEN dst_exists THEN dst_hash ELSE first_value(content_hash) OVER w END, false) THEN 'replicate-skip-existing' ELSE 'key-conflict' END AS action
  FROM {rows} WINDOW w AS (PARTITION BY dst, {key} ORDER BY src, content_hash)"""


_NULLS = "CAST(NULL AS VARCHAR)"
_LISTING = """listing AS (
  SELECT doc_id, source, key, CASE WHEN doc_id % 6 = 0 THEN size_bytes + 1 ELSE size_bytes END AS size_bytes, last_modified, content_hash AS true_hash FROM cat4
)"""
_BEFORE = "before AS (SELECT * FROM cat4 WHERE doc_id % 10 <> 3), now_ AS (SELECT * FROM cat4 WHERE doc_id % 10 <> 7)"
_FILES = """files AS (
  SELECT doc_id, key, content_hash, content_type, CASE WHEN doc_id % 9 = 0 THEN NULL ELSE last_modified END AS created FROM cat4 WHERE source = 'drive-folder'
)"""
_IMPORT = f"""{_W}, {_FILES}, held AS (SELECT DISTINCT content_hash FROM cat4 WHERE {_LIVE} AND source IN {_REP}), plan AS (
  SELECT key, CASE WHEN content_type LIKE 'application/vnd.google-apps.%' THEN 'drive-skip-native-doc' WHEN content_type LIKE 'image/%' OR content_type LIKE 'video/%' THEN
      CASE WHEN h.content_hash IS NOT NULL THEN 'drive-skip-existing' ELSE 'drive-import-success' END ELSE 'drive-skip-unsupported' END AS action,
    'google-drive/' || coalesce(substr(created, 1, 4), 'unknown-year') || '/' || coalesce(substr(created, 6, 2), 'unknown-month') || '/' || key || '__' || regexp_replace(regexp_replace(key, '.*/', ''), '[^A-Za-z0-9._-]', '_', 'g') AS destination_key,
    created IS NULL AS time_warning
  FROM files LEFT JOIN held h USING (content_hash)
)"""
_SECRET = "' Bearer abc.def-1 and X-Amz-Signature=0aF9 or 1//tok_en, ya29.x-y aws_secret_access_key=" + "A" * 40 + " end'"


def _redacted(text: str) -> str:
    """SQL that replaces the shapes of secrets in SQL ``text``, whole shapes first."""
    for p in WHOLE:
        text = f"regexp_replace({text}, '{p}', '{MASK}', 'g')"
    for p in AFTER:
        text = f"regexp_replace({text}, '{p}', '\\1{MASK}', 'g')"
    return text


_LEDGER = "SELECT CASE WHEN event_type = 'error' THEN 'replication-error' ELSE event_type END AS action, CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS result, CASE WHEN event_type = 'error' THEN sha256(CAST(user_id % 50 AS VARCHAR)) END AS content_hash FROM events"
_ABSENT = "WHEN s = 404 THEN 'absent'"
_STATUS = "CASE WHEN s IN (408, 429, 500, 502, 503, 504) THEN 'transient' {} WHEN s >= 200 AND s < 300 THEN 'ok' ELSE 'non_transient' END"
_DIVERGENT = f"""present AS (
  SELECT content_hash, string_agg(DISTINCT source, ',' ORDER BY source) AS present_in, count(DISTINCT source) AS n, min(source || chr(1) || key) AS first_ FROM cat4 WHERE source IN {_REP} GROUP BY content_hash HAVING count(DISTINCT source) < 3
)"""

SQL: dict[str, str] = {
    "dup_groups": f"""{_W} SELECT content_hash, size_bytes, count(*) AS copies, CASE WHEN count(DISTINCT source) >= 2 THEN 'cross-source' ELSE 'same-source' END AS label,
        size_bytes * count(*) AS total_bytes, string_agg(source || '|' || key, ',' ORDER BY source, key) AS members FROM cat4 GROUP BY content_hash, size_bytes HAVING count(*) >= 2""",
    "dup_groups_skipped": f"{_W} SELECT source, key FROM cat4 WHERE (doc_id % 17 = 0 AND upper(content_hash) <> content_hash) OR (doc_id % 19 = 0 AND size_bytes > 0)",
    "canonical_pick": f"{_MEMBERS} SELECT source, key, content_hash, CAST(rn AS INTEGER) AS rn, rn = 1 AS is_canonical FROM members",
    "priority_warning": f"{_MEMBERS} SELECT content_hash, size_bytes, priority_warning FROM members WHERE rn = 1",
    "removal_plan": f"{_MEMBERS} SELECT source, key, content_hash, size_bytes FROM members WHERE rn > 1",
    "quarantine_decisions": f"""{_MEMBERS}, alive AS (SELECT content_hash, count(*) FILTER ({_LIVE}) AS live FROM cat4 GROUP BY content_hash), used AS (
        SELECT m.*, live, source IN {_REP} AS eligible, coalesce(sum(CASE WHEN source IN {_REP} THEN 1 ELSE 0 END) OVER (PARTITION BY content_hash ORDER BY size_bytes, source, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
        FROM members m JOIN alive USING (content_hash) WHERE rn > 1)
        SELECT source, key, content_hash, size_bytes, CASE WHEN used >= greatest(live - 1, 0) THEN 'last-copy-protection' ELSE 'quarantine' END AS action,
          CASE WHEN used >= greatest(live - 1, 0) THEN 'skipped' WHEN eligible THEN 'quarantined' ELSE 'error' END AS result FROM used""",
    "quarantine_dry_run": f"{_MEMBERS} SELECT source, key, content_hash, size_bytes, 'quarantine' AS action, 'planned' AS result FROM members WHERE rn > 1",
    "expired_quarantine_deletes": _deletes("quarantined_at", "tombstoned_at"),
    "tombstone_deletes": _deletes("tombstoned_at", "quarantined_at"),
    "live_copy_counts": f"{_W} SELECT content_hash, count(*) FILTER ({_LIVE}) AS live FROM cat4 GROUP BY content_hash",
    "replication_plan": f"{_PLAN4} SELECT src, dst, content_hash, key, size_bytes FROM plan",
    "loop_guard": f"{_PLAN4} SELECT src, dst, content_hash, key FROM plan WHERE origin <> '' AND origin = dst",
    "source_tagging": f"{_PLAN4} SELECT src, dst, content_hash, key FROM plan WHERE coalesce(origin, '') = ''",
    "conflict_skip": f"{_ROWS}, done AS ({_kept('rows_', 'key', 'replicate')}) SELECT src, dst, key, content_hash, action, {_NULLS} AS previous_content_hash, {_NULLS} AS renamed_key FROM done",
    "conflict_overwrite": f"""{_ROWS}, step AS (
        SELECT *, row_number() OVER w = 1 AS first_, CASE WHEN row_number() OVER w = 1 THEN dst_hash ELSE lag(content_hash) OVER w END AS before FROM rows_ WINDOW w AS (PARTITION BY dst, key ORDER BY src, content_hash)
        ), done AS (SELECT *, CASE WHEN first_ AND NOT dst_exists THEN 'replicate' WHEN coalesce(content_hash = before, false) THEN 'replicate-skip-existing' ELSE 'overwrite' END AS action FROM step)
        SELECT src, dst, key, content_hash, action, CASE WHEN action = 'overwrite' THEN before END AS previous_content_hash, {_NULLS} AS renamed_key FROM done""",
    "conflict_rename": f"""{_ROWS}, done AS ({_kept("rows_", "key", "replicate")}), taken AS (
        SELECT source AS dst, key AS renamed_key, content_hash FROM cat20 UNION ALL SELECT dst, key, content_hash FROM done WHERE action = 'replicate'
        ), again AS (
        SELECT d.src, d.dst, d.key, d.content_hash, d.key || '.' || substr(d.content_hash, 1, 8) AS renamed_key FROM done d WHERE action = 'key-conflict'
        ), rows2 AS (SELECT a.*, t.renamed_key IS NOT NULL AS dst_exists, t.content_hash AS dst_hash FROM again a LEFT JOIN taken t USING (dst, renamed_key)), done2 AS ({_kept("rows2", "renamed_key", "rename")})
        SELECT src, dst, key, content_hash, action, {_NULLS} AS previous_content_hash, {_NULLS} AS renamed_key FROM done WHERE action <> 'key-conflict'
        UNION ALL SELECT src, dst, key, content_hash, action, {_NULLS}, renamed_key FROM done2""",
    "missing_records": f"{_W}, {_BEFORE} SELECT source, key, content_hash FROM before b WHERE source IN {_REP} AND NOT EXISTS (SELECT 1 FROM now_ n WHERE n.source = b.source AND n.key = b.key)",
    "tombstone_propagation": f"""{_W}, {_BEFORE.replace("SELECT *", "SELECT * REPLACE (sha256(CAST(doc_id // 4 AS VARCHAR)) AS content_hash)")}, gone AS (SELECT * FROM before b WHERE source IN {_REP} AND NOT EXISTS (SELECT 1 FROM now_ n WHERE n.source = b.source AND n.key = b.key)),
        alive AS (SELECT content_hash, count(*) FILTER ({_LIVE}) AS live FROM before WHERE source IN {_REP} GROUP BY content_hash), pairs AS (
        SELECT p.source, p.key, p.content_hash, m.source AS ms, m.key AS mk, live, p.source IN ('s3-prod', 'gcs-archive') AND row_number() OVER (PARTITION BY p.content_hash, p.source, p.key ORDER BY m.source, m.key) = 1 AS hit
        FROM gone m JOIN (SELECT * FROM before WHERE {_LIVE} AND source IN {_REP}) p ON p.content_hash = m.content_hash AND p.source <> m.source JOIN alive ON alive.content_hash = m.content_hash
        ), counted AS (SELECT *, coalesce(sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY content_hash ORDER BY ms, mk, source, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM pairs
        ), marked AS (SELECT *, hit AND before_ < live - 1 AS done FROM counted), peers AS (SELECT *, bool_or(done) OVER (PARTITION BY content_hash, source, key) AS peer_done FROM marked)
        SELECT source, key, content_hash, ms AS triggering_source, mk AS triggering_key, CASE WHEN before_ < live - 1 THEN 'tombstone' ELSE 'last-copy-protection' END AS action,
          CASE WHEN done THEN 'success' WHEN before_ < live - 1 THEN 'error' ELSE 'skipped' END AS result FROM peers WHERE NOT peer_done OR done""",
    "per_source_counts": f"{_W} SELECT source, count(*) AS objects, CAST(coalesce(sum(size_bytes) FILTER (size_bytes >= 0), 0) AS BIGINT) AS bytes, count(DISTINCT content_hash) AS distinct_hashes FROM cat4 GROUP BY source",
    "cross_kind_partition": f"""{_W}, by_hash AS (SELECT content_hash, count(DISTINCT kind) AS n, min(kind) AS one FROM cat4 JOIN kinds USING (source) GROUP BY content_hash)
        SELECT count(*) FILTER (n = 1 AND one = 's3') AS s3_only, count(*) FILTER (n = 1 AND one = 'gcs') AS gcs_only, count(*) FILTER (n = 1 AND one = 'google_drive') AS drive_only,
          count(*) FILTER (n = 2) AS exactly_two, count(*) FILTER (n = 3) AS all_three FROM by_hash""",
    "dup_groups_per_source": f"""{_W}, groups AS (SELECT min(source) AS source FROM cat4 GROUP BY content_hash, size_bytes HAVING count(*) >= 2 AND count(DISTINCT source) = 1)
        SELECT source, count(*) AS groups FROM groups GROUP BY source""",
    "cross_source_groups": f"{_W} SELECT count(*) AS groups FROM (SELECT 1 FROM cat20 GROUP BY content_hash, size_bytes HAVING count(*) >= 2 AND count(DISTINCT source) > 1)",
    "bytes_to_hash": f"{_W} SELECT CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM cat4 WHERE doc_id % 3 = 0",
    "new_removed_counts": f"""{_W}, {_BEFORE} SELECT coalesce(b.source, n.source) AS source, count(*) FILTER (b.key IS NULL) AS new, count(*) FILTER (n.key IS NULL) AS removed
        FROM before b FULL JOIN now_ n ON b.source = n.source AND b.key = n.key GROUP BY 1""",
    "divergent_hashes": f"""{_W}, {_DIVERGENT} SELECT content_hash, present_in,
        (SELECT string_agg(s, ',' ORDER BY s) FROM (VALUES ('s3-prod'), ('gcs-archive'), ('s3-cold')) v(s) WHERE NOT contains(',' || present_in || ',', ',' || s || ',')) AS absent_from,
        split_part(first_, chr(1), 1) AS source, split_part(first_, chr(1), 2) AS key FROM present""",
    "hash_cache_lookup": f"{_W}, {_LISTING} SELECT source, key, CASE WHEN l.size_bytes = c.size_bytes AND l.last_modified = c.last_modified THEN content_hash END AS cached_hash FROM listing l JOIN cat4 c USING (source, key)",
    "hash_resolution": f"""{_W}, {_LISTING} SELECT source, key, true_hash AS content_hash, CASE WHEN l.doc_id % 4 = 0 THEN 'tag' WHEN l.size_bytes = c.size_bytes THEN 'cache' ELSE 'content' END AS hash_from
        FROM listing l JOIN cat4 c USING (source, key)""",
    "import_classification": f"{_W} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'candidate' WHEN 1 THEN 'candidate' WHEN 2 THEN 'native-doc' ELSE 'unsupported' END AS class FROM cat20",
    "import_plan": f"{_IMPORT} SELECT key, action, destination_key, time_warning FROM plan",
    "import_stats": f"""{_IMPORT} SELECT count(*) AS discovered, count(*) FILTER (action = 'drive-import-success') AS imported, count(*) FILTER (action = 'drive-skip-existing') AS skip_existing,
        count(*) FILTER (action = 'drive-skip-native-doc') AS skip_native_doc, count(*) FILTER (action = 'drive-skip-unsupported') AS skip_unsupported, CAST(0 AS BIGINT) AS download_error,
        count(*) FILTER (time_warning AND action = 'drive-import-success') AS time_warning FROM plan""",
    "destination_keys": """SELECT page_id, 'google-drive/' || CASE WHEN page_id % 5 = 0 THEN 'unknown-year/unknown-month' ELSE '20' || lpad(CAST(page_id % 30 AS VARCHAR), 2, '0') || '/06' END || '/k' || CAST(page_id AS VARCHAR) || '__' ||
        regexp_replace(CASE WHEN coalesce(url, '') = '' THEN 'k' || CAST(page_id AS VARCHAR) ELSE regexp_replace(url, '.*/', '') END, '[^A-Za-z0-9._-]', '_', 'g') AS destination_key FROM pages""",
    "sanitise_names": "SELECT page_id, regexp_replace(regexp_replace(url, '.*/', ''), '[^A-Za-z0-9._-]', '_', 'g') AS name FROM pages",
    "upsert_latest": "SELECT conv_id, role, turn, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) = 1",
    "catalog_remove": f"{_W}, {_BEFORE} SELECT source, key, content_hash FROM before b WHERE NOT EXISTS (SELECT 1 FROM now_ n WHERE n.source = b.source AND n.key = b.key)",
    "redact_strings": f"SELECT doc_id, {_redacted(f'text || {_SECRET}')} AS text FROM documents",
    "redact_maps": f"SELECT doc_id, '[REDACTED]' AS authorization, {_redacted(f'source || {_SECRET}')} AS note FROM documents",
    "http_classification": f"SELECT event_id, {_STATUS.format('')} AS plain, {_STATUS.format(_ABSENT)} AS probe FROM (SELECT event_id, event_id % 500 + 100 AS s FROM events)",
    "etag_singlepart": "SELECT doc_id, doc_id % 4 IN (0, 3) AS single_part FROM documents",
    "retry_waits": """SELECT event_id, CAST(least(greatest(least(500 * CAST(pow(2, event_id % 8) AS BIGINT), 30000), CASE WHEN event_id % 3 = 0 THEN (event_id % 40) * 1000 ELSE 0 END), 30000) AS BIGINT) AS wait_ms FROM events""",
    "content_types": "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'video/quicktime' ELSE 'application/octet-stream' END AS content_type FROM pages",
    "timestamps": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || substr(strftime(ts, '%f'), 1, 3) || 'Z' AS millis, strftime(ts, '%Y%m%dT%H%M%SZ') AS compact FROM events",
    "ledger_action_counts": f"SELECT action, result, count(*) AS n FROM ({_LEDGER}) GROUP BY action, result",
    "replication_error_hashes": f"SELECT DISTINCT content_hash FROM ({_LEDGER}) WHERE action = 'replication-error' AND content_hash IS NOT NULL",
    "catalog_export_order": f"{_W} SELECT content_hash, source, key FROM cat4 ORDER BY content_hash, source, key",
    "run_summary": f"""{_W}, {_DIVERGENT} SELECT CAST((SELECT count(*) FROM cat4) AS VARCHAR) AS discovered, 'true' AS cold_start, 'false' AS dry_run, 'true' AS apply, 'true' AS first_pass_confirmed,
        CAST((SELECT count(*) FROM present) AS VARCHAR) AS divergent_hashes_count""",
    "lineitem_dup_bench": """SELECT l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS l_quantity, count(*) AS copies, min(l_orderkey) AS first_order, count(DISTINCT l_shipdate) AS dates
        FROM lineitem GROUP BY l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) HAVING count(*) >= 2""",
}

_COUNT = lambda action: f"count(*) FILTER (action = '{action}')"
SQL |= {
    "live_copy_counts_replicated": f"{_W} SELECT content_hash, count(*) FILTER ({_LIVE}) AS live FROM cat4 WHERE source IN {_REP} GROUP BY content_hash",
    "quarantine_batch": f"{_MEMBERS} SELECT count(*) AS objects, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM members WHERE rn > 1",
    "would_import": f"""{_W}, {_FILES} SELECT count(*) AS files FROM files WHERE (content_type LIKE 'image/%' OR content_type LIKE 'video/%')
        AND NOT EXISTS (SELECT 1 FROM cat4 c WHERE c.content_hash = files.content_hash AND c.quarantined_at IS NULL AND c.tombstoned_at IS NULL AND c.source IN {_REP})""",
    "drift_events": f"""{SQL["divergent_hashes"].split(" SELECT content_hash, present_in")[0]}, {_BEFORE}, changes AS (
          SELECT coalesce(b.source, n.source) AS source, count(*) FILTER (b.key IS NULL) AS new, count(*) FILTER (n.key IS NULL) AS removed FROM before b FULL JOIN now_ n ON b.source = n.source AND b.key = n.key GROUP BY 1
        ), counts AS (
          SELECT 'new:' || source AS k, new AS v FROM changes UNION ALL SELECT 'removed:' || source, removed FROM changes UNION ALL SELECT 'divergent_hashes_count', (SELECT count(*) FROM present)
        )
        SELECT 'INFO' AS level, 'inconsistency-summary' AS event, {_NULLS} AS content_hash, {_NULLS} AS present_in, {_NULLS} AS absent_from, {_NULLS} AS canonical_key, string_agg(k || '=' || v, ',' ORDER BY k) AS detail FROM counts
        UNION ALL SELECT 'WARN', 'inconsistency-divergent-hash', content_hash, present_in, absent_from, key, {_NULLS} FROM ({SQL["divergent_hashes"]})""",
    "replication_counters": f"""WITH decided AS (
          SELECT action FROM ({SQL["conflict_rename"]}) UNION ALL SELECT 'loop-skip' FROM ({SQL["loop_guard"]}) UNION ALL SELECT 'source-tagged' FROM ({SQL["source_tagging"]})
          UNION ALL SELECT action FROM ({SQL["tombstone_deletes"]}) UNION ALL SELECT action FROM ({_LEDGER})
        ) SELECT {_COUNT("replicate")} AS replicate, {_COUNT("replicate-skip-existing")} AS replicate_skip_existing, {_COUNT("loop-skip")} AS loop_skip, {_COUNT("key-conflict")} AS key_conflict,
          {_COUNT("overwrite")} AS overwrite, {_COUNT("rename")} AS rename, {_COUNT("replication-error")} AS replication_error, {_COUNT("source-tagged")} AS source_tagged, {_COUNT("tombstone")} AS tombstone,
          {_COUNT("physical-delete")} AS physical_delete, {_COUNT("last-copy-protection")} AS last_copy_guard FROM decided""",
}


_ROWS_OF = "SELECT action, result, source, target, key, content_hash, size_bytes, extra FROM"
_KEPT_LAST = "CASE WHEN action = 'last-copy-protection' THEN 'intended_action={}' ELSE '' END AS extra"
_GUARDED = f"""SELECT CASE WHEN coalesce(origin, '') = '' THEN 'source-tagged' ELSE 'loop-skip' END AS action, CASE WHEN coalesce(origin, '') = '' THEN 'success' ELSE 'skipped' END AS result,
      src AS source, dst AS target, key, content_hash, size_bytes, CASE WHEN coalesce(origin, '') = '' THEN 'origin=' || src ELSE '' END AS extra FROM ({_ROWS.split(", rows_ AS")[0]} SELECT * FROM plan) WHERE coalesce(origin, '') IN ('', dst)"""


def _copies(policy: str, observed: str, extra: str) -> str:
    """Decisions about copies with what is there at the place in question (``seen``: dst, key, hash of objects and of what was written before)."""
    return f"""SELECT d.action, CASE WHEN d.action IN ('replicate', 'rename', 'overwrite') THEN 'success' ELSE 'skipped' END AS result, d.src AS source, d.dst AS target, d.key, d.content_hash,
      s.size_bytes, {extra} AS extra FROM ({SQL[f"conflict_{policy}"]}) d JOIN ({_W} SELECT DISTINCT content_hash, size_bytes FROM cat20) s USING (content_hash) {observed}"""


# Where a new name is taken, the conflict names the hash under it: an object's, or that of the first row to come there.
_HELD = f"""LEFT JOIN ({_W} SELECT source AS dst, key AS place, content_hash AS held FROM cat20) o ON o.dst = d.dst AND o.place = coalesce(d.renamed_key, d.key)
      LEFT JOIN (SELECT dst, coalesce(renamed_key, key) AS place, min(struct_pack(s := src, h := content_hash)).h AS came FROM ({SQL["conflict_rename"]}) WHERE action IN ('replicate', 'rename') GROUP BY ALL) f
        ON f.dst = d.dst AND f.place = coalesce(d.renamed_key, d.key)"""
_RENAME_EXTRA = """CASE d.action WHEN 'rename' THEN 'original_key=' || d.key || ',renamed_key=' || d.renamed_key WHEN 'replicate-skip-existing' THEN coalesce('renamed_key=' || d.renamed_key, '')
      WHEN 'key-conflict' THEN 'expected_content_hash=' || d.content_hash || ',observed_content_hash=' || coalesce(held, came, '') || coalesce(',renamed_key=' || d.renamed_key, '') ELSE '' END"""
_PATH = "'drive_file_id=' || f.key || ',drive_path=' || f.key"
SQL["ledger_payloads"] = f"""
{_ROWS_OF} (SELECT *, NULL AS target, {_KEPT_LAST.format("quarantine")} FROM ({SQL["quarantine_decisions"]}))
UNION ALL {_ROWS_OF} (SELECT *, NULL AS target, {_KEPT_LAST.format("physical-delete")} FROM ({SQL["tombstone_deletes"]}))
UNION ALL {_ROWS_OF} (SELECT *, NULL AS target, NULL AS size_bytes, CASE WHEN action = 'last-copy-protection' THEN 'intended_action=tombstone'
      WHEN result = 'success' THEN 'triggering_key=' || triggering_key || ',triggering_source=' || triggering_source ELSE '' END AS extra FROM ({SQL["tombstone_propagation"]}))
UNION ALL {_ROWS_OF} (SELECT action, CASE WHEN action = 'drive-import-success' THEN 'success' ELSE 'skipped' END AS result, 'drive-folder' AS source, CASE WHEN action = 'drive-import-success' THEN 's3-prod' END AS target,
      f.key, CASE WHEN action IN ('drive-import-success', 'drive-skip-existing') THEN f.content_hash END AS content_hash, NULL AS size_bytes,
      {_PATH} || CASE WHEN action IN ('drive-skip-native-doc', 'drive-skip-unsupported') THEN ',mime_type=' || coalesce(f.content_type, '') ELSE '' END AS extra
      FROM ({SQL["import_plan"]}) p JOIN ({_W} SELECT * FROM cat4 WHERE source = 'drive-folder') f USING (key))
UNION ALL {_ROWS_OF} (SELECT 'drive-warning-missing-created-time' AS action, 'skipped' AS result, 'drive-folder' AS source, NULL AS target, f.key, f.content_hash, NULL AS size_bytes,
      'createdTime=not-a-date,' || {_PATH} AS extra FROM ({SQL["import_plan"]}) p JOIN ({_W} SELECT * FROM cat4 WHERE source = 'drive-folder') f USING (key) WHERE action = 'drive-import-success' AND time_warning)
UNION ALL {_ROWS_OF} ({_copies("rename", _HELD, _RENAME_EXTRA)})
UNION ALL {_ROWS_OF} ({_copies("overwrite", "", "CASE WHEN d.action = 'overwrite' THEN coalesce('previous_content_hash=' || d.previous_content_hash, '') ELSE '' END")})
UNION ALL {_ROWS_OF} ({_GUARDED}) UNION ALL {_ROWS_OF} ({_GUARDED})
"""


_BROKEN = "CASE event_type WHEN 'view' THEN 'json_syntax' WHEN 'signup' THEN 'unknown_key' WHEN 'click' THEN 'missing_field' WHEN 'purchase' THEN 'unknown_enum' WHEN 'error' THEN 'invalid_value' ELSE 'none' END"
_WHAT = "CASE event_type WHEN 'view' THEN '' WHEN 'signup' THEN 'more' WHEN 'click' THEN 'error' WHEN 'purchase' THEN 'action: dance' WHEN 'error' THEN 'source' ELSE event_type END"
_TEXT = "array_to_string(list_filter([{}], lambda x: x IS NOT NULL), ',')"
SQL |= {
    "catalog_round_trip": f"""{_W} SELECT source, key, content_hash, size_bytes, last_seen_at, last_modified, CASE WHEN doc_id % 3 = 0 THEN 'q"' || chr(92) || 'é' || chr(10) || lang END AS content_type,
        quarantined_at, tombstoned_at, origin FROM cat4 JOIN (SELECT doc_id, lang FROM documents) USING (doc_id)""",
    "ledger_line_errors": f"""SELECT CASE WHEN user_id % 2 = 0 THEN {_BROKEN} ELSE 'none' END AS category, CASE WHEN user_id % 2 = 0 THEN {_WHAT} ELSE event_type END AS message, count(*) AS n FROM events GROUP BY ALL""",
    "merged_metadata": f"""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN lang END AS l, CASE WHEN doc_id % 7 <> 0 THEN source END AS a, CASE WHEN doc_id % 5 <> 0 THEN upper(source) END AS b, CASE WHEN doc_id % 5 <> 0 THEN n_chars END AS n FROM documents)
        SELECT doc_id, {_TEXT.format("'lang=' || l, 'name=' || coalesce(b, a), 'size=' || n")} AS tags_win, {_TEXT.format("'lang=' || l, 'name=' || coalesce(a, b), 'size=' || n")} AS metadata_wins FROM m""",
    "tree_paths": "SELECT 'c' || c_custkey AS key, r_name || '/' || n_name || '/' || c_name AS path FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey",
    "decisions_without_store": f"""SELECT action, CASE WHEN lost IS NOT NULL THEN 'error' ELSE result END AS result, source, target, key, content_hash, lost AS error FROM (
        SELECT *, CASE WHEN source NOT IN ('s3-prod', 'gcs-archive') THEN 'no store ' || source WHEN target NOT IN ('s3-prod', 'gcs-archive') THEN 'no store ' || target END AS lost FROM (
          SELECT action, result, source, NULL AS target, key, content_hash FROM ({SQL["quarantine_decisions"]})
          UNION ALL SELECT CASE WHEN coalesce(origin, '') = '' THEN 'source-tagged' ELSE 'loop-skip' END, CASE WHEN coalesce(origin, '') = '' THEN 'success' ELSE 'skipped' END, src, dst, key, content_hash FROM ({_PLAN4} SELECT * FROM plan) WHERE coalesce(origin, '') IN ('', dst)
          UNION ALL SELECT 'replicate', 'success', src, dst, key, content_hash FROM ({_PLAN4} SELECT * FROM plan) WHERE coalesce(origin, '') <> dst))""",
    "divergent_without_errors": f"SELECT content_hash, present_in FROM ({SQL['divergent_hashes']}) WHERE content_hash NOT IN (SELECT content_hash FROM ({_W} SELECT content_hash FROM cat4 WHERE size_bytes % 3 = 0))",
    "listing_projection": f"{_W} SELECT source, key, content_hash, size_bytes, '2024-02-10T12:00:00Z' AS last_seen_at, last_modified, content_type, quarantined_at, tombstoned_at, origin FROM cat4 WHERE doc_id % 6 > 1",
    "streamed_bytes": f"""SELECT hash_from, count(*) AS objects, CAST(sum(CASE WHEN doc_id % 6 = 0 THEN size_bytes + 1 ELSE size_bytes END) AS BIGINT) AS bytes
        FROM ({SQL["hash_resolution"]}) r JOIN ({_W} SELECT doc_id, source, key, size_bytes FROM cat4) c USING (source, key) GROUP BY hash_from""",
    "plan_in_order": f"{_PLAN4} SELECT row_number() OVER (ORDER BY src, dst, content_hash) AS place, src, dst, content_hash, key FROM plan",
    "groups_in_order": f"SELECT row_number() OVER (ORDER BY content_hash, size_bytes) AS place, content_hash, size_bytes, copies, label FROM ({SQL['dup_groups']})",
    "divergence_in_order": f"SELECT row_number() OVER (ORDER BY content_hash) AS place, content_hash FROM ({SQL['divergent_hashes']})",
    "streaming_catalog": """SELECT source, lang || '-' || (doc_id // 100) AS key, max(1700000000 + (doc_id * 37) % 1000) AS seen_at,
        arg_max(sha256(text), struct_pack(t := (doc_id * 37) % 1000, h := sha256(text))) AS content_hash, arg_max(CAST(strlen(text) AS BIGINT), struct_pack(t := (doc_id * 37) % 1000, h := sha256(text))) AS size_bytes
        FROM documents GROUP BY 1, 2""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
