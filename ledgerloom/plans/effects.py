"""Decisions carried out on stores, in one thin layer.

Every effect is idempotent, and with a journal each one is written down as soon as it is
done, so a task that Spark runs again finds its work done and told. A copy is verified by size and
announced hash, and removed again if it differs. A failure makes an error row; it never
stops the run. Effects are dealt to as many tasks as may run side by side, by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from types import SimpleNamespace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.running import dealt_by_weight
from ..schema import OUTCOME
from ..sources.stores import Store
from .control import RetriesExhausted, RetrySettings, retried
from .journal import Journal

HASH, ORIGIN, QUARANTINED, TOMBSTONED, WHEN = "content-sha256", "origin", "quarantined-at", "tombstoned-at", "replicated-at"
_ARROW = [pa.map_(pa.string(), pa.string()) if isinstance(f.dataType, T.MapType) else pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() for f in OUTCOME]


class Differs(OSError):
    """A copy that isn't what was announced."""

    def __init__(self, key: str, observed: str | None):
        super().__init__(f"verification failed: {key}")
        self.observed = observed


def _copy(row, stores: dict[str, Store], now: str) -> None:
    src, dst, key = stores[row.source], stores[row.target], row.done_key
    head = src.head(row.key)
    if head is None:
        raise FileNotFoundError(row.key)
    there = dst.head(key)
    if there and there["user_metadata"].get(HASH) == row.content_hash and there["size_bytes"] == head["size_bytes"]:
        return
    notes = head["user_metadata"]
    dst.write(key, src.read(row.key), notes | {ORIGIN: notes.get(ORIGIN) or row.source, HASH: row.content_hash, WHEN: now})
    there = dst.head(key)
    if there is None or there["size_bytes"] != head["size_bytes"] or there["user_metadata"].get(HASH) != row.content_hash:
        dst.delete(key)
        raise Differs(key, there["user_metadata"].get(HASH) if there else None)


def _do(row, stores: dict[str, Store], now: str) -> None:
    if row.action in ("replicate", "rename", "overwrite", "drive-import-success"):
        _copy(row, stores, now)
    elif row.action == "quarantine" and row.result != "error":
        stores[row.source].tag(row.key, QUARANTINED, now)
    elif row.action == "tombstone" and row.result != "error":
        stores[row.source].tag(row.key, TOMBSTONED, now)
    elif row.action == "physical-delete":
        stores[row.source].delete(row.key)


_FAILED = {"drive-import-success": "drive-download-error", "replicate": "replication-error", "rename": "replication-error", "overwrite": "replication-error"}


_TOUCHES = ("replicate", "rename", "overwrite", "drive-import-success", "quarantine", "tombstone", "physical-delete")


def touches() -> Column:
    """Whether a decision does something to a store."""
    return F.col("action").isin(*_TOUCHES) & ~F.col("result").isin("error", "skipped")


def shaped(decisions: DataFrame) -> DataFrame:
    """Decisions with all columns of OUTCOME; those that they lack are null, and an object keeps its key."""
    have = set(decisions.columns)
    out = decisions.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in OUTCOME))
    return out.withColumn("done_key", F.coalesce("done_key", "key"))


def carry_out(
    decisions: DataFrame, factory: Callable[[], dict[str, Store]], now: str, retries: RetrySettings = RetrySettings(), transfers: int = 4, *, journal: str | None = None, told: dict[str, str] | None = None
) -> DataFrame:
    """The decisions (OUTCOME's columns) with what came of them; those that fail keep their payload, and one that ran out
    of attempts has a ``retries-exhausted`` row more. ``journal``: a folder for outcomes, with what ``told`` adds to each."""
    names = OUTCOME.names

    def outcome(row: dict, stores: dict[str, Store]) -> list[dict]:
        try:
            retried(lambda: _do(SimpleNamespace(**row), stores, now), retries)
            return [row]
        except Exception as e:  # noqa: BLE001  any failure is a row of the ledger
            error, extra = f"{type(e).__name__}: {e}", dict(row["extra"] or {})
            action = _FAILED.get(row["action"], row["action"])
            if action == "replication-error":
                extra |= {"expected_content_hash": row["content_hash"] or "", "observed_content_hash": getattr(e, "observed", None) or ""}
            out = [row | {"action": action, "result": "error", "error": error, "extra": extra, "size_bytes": None if action == "replication-error" else row["size_bytes"]}]
            if isinstance(e, RetriesExhausted):
                out.append(row | {"action": "retries-exhausted", "result": "error", "error": error, "extra": {"intended_action": row["action"]}})
            return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores, notes = factory(), Journal(journal) if journal else None
        for batch in batches:
            out = []
            for row in batch.to_pylist(maps_as_pydicts="lossy"):
                effect = row.pop("__effect")
                if row["action"] not in _TOUCHES or row["result"] in ("error", "skipped"):
                    out.append(row)
                    continue
                done = notes.get(effect) if notes else None
                if done is None:
                    done = outcome(row, stores)
                    if notes:
                        notes.put(effect, [r | (told or {}) for r in done])
                out += done
            cols = [[list(r[n].items()) if isinstance(r[n], dict) else r[n] for r in out] for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW, strict=True)], names=names)

    rows = shaped(decisions)
    rows = rows.withColumn("__effect", F.sha2(F.to_json(F.struct("action", "source", "target", "key", "content_hash", "done_key"), {"ignoreNullFields": "false"}), 256))
    copied = F.col("action").isin(*_FAILED)
    load = F.when(copied, F.greatest(F.coalesce("size_bytes", F.lit(0)), F.lit(0))).otherwise(0) + (1 << 18)
    return dealt_by_weight(rows, load, ["__effect"], transfers).mapInArrow(run, OUTCOME)
