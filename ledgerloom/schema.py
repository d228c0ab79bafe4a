"""Schemas and vocabularies of the object catalog and of the action ledger."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "map": T.MapType(T.StringType(), T.StringType())}


def _struct(spec: str) -> T.StructType:
    """Columns "name type"; an exclamation mark after the type forbids nulls."""
    return T.StructType([T.StructField(n, _TYPES[k.rstrip("!")], not k.endswith("!")) for n, k in (c.split() for c in spec.split(", "))])


CATALOG = _struct(
    "source string!, key string!, content_hash string!, size_bytes bigint!, last_seen_at string!, last_modified string!, content_type string, quarantined_at string, tombstoned_at string, origin string"
)
LISTING = _struct("source string, key string, size_bytes bigint, last_modified string, content_type string, user_metadata map, etag string, provider_hash string")
LEDGER = _struct("timestamp string, run_id string, action string, result string, source string, target string, key string, content_hash string, size_bytes bigint, error string, extra map")
#: A decision and what came of it; done_key: the key that the effect is about.
OUTCOME = _struct("action string, result string, source string, target string, key string, content_hash string, size_bytes bigint, error string, done_key string, extra map")

# Actions and results of ledger rows.
ACTIONS = (
    "discovered", "replicate", "replicate-skip-existing", "loop-skip", "source-tagged", "hash-recomputed", "key-conflict", "overwrite", "rename", "quarantine", "physical-delete",
    "last-copy-protection", "tombstone", "drive-skip-unsupported", "drive-skip-native-doc", "drive-skip-existing", "drive-import-success", "drive-download-error",
    "drive-warning-missing-created-time", "list-error", "hash-error", "retries-exhausted", "replication-error", "summary",
)
RESULTS = ("success", "skipped", "quarantined", "deleted", "planned", "error")

REPLICATED_KINDS = ("s3", "gcs")
SOURCE_KINDS = ("s3", "gcs", "google_drive")
