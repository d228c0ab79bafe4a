"""Decisions against plain loops over random catalogs, and rules that must hold for any catalog."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import deletion, drift, importing, replication
from ledgerloom.operators import duplicates as D
from ledgerloom.schema import CATALOG

NAMES = ["s3-prod", "s3-archive", "gcs-primary", "drive-folder"]
REPLICATED = NAMES[:3]
PRIORITY = ["gcs-primary", "s3-prod", "gcs-primary"]


def catalog(seed, n=60):
    r = random.Random(seed)
    rows = {}
    for _ in range(n):
        marker = r.choice([None, None, None, "2024-01-01T00:00:00Z", ""])
        row = {
            "source": r.choice(NAMES), "key": r.choice("abcdefgh") + r.choice(["", "é", "/x"]), "content_hash": r.choice("abcdef0") * 64, "size_bytes": r.choice([0, 10, 10, 20]),
            "last_seen_at": r.choice(["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.0004Z", "2023-05-05T05:05:05+02:00", "nonsense", "12:30"]), "last_modified": "2024-01-01T00:00:00Z",
            "content_type": None, "quarantined_at": marker, "tombstoned_at": r.choice([None, None, "2024-01-02T00:00:00Z"]) if marker is None else None, "origin": r.choice([None, "", *NAMES]),
        }
        rows[row["source"], row["key"]] = row
    return list(rows.values())


def frame(spark, rows, parts=3):
    return spark.createDataFrame([tuple(x[f.name] for f in CATALOG) for x in rows], CATALOG).repartition(parts)


TIMES = {"2024-01-01T00:00:00Z": 2, "2024-01-01T00:00:00.0004Z": 2, "2023-05-05T05:05:05+02:00": 1, "nonsense": 9, "12:30": 9}


def canonical_order(x):
    rank = PRIORITY.index(x["source"]) if x["source"] in PRIORITY else 9
    return rank, TIMES[x["last_seen_at"]], x["key"], x["source"]


def is_live(x):
    return x["quarantined_at"] is None and x["tombstoned_at"] is None


def groups(rows):
    out = {}
    for x in rows:
        out.setdefault((x["content_hash"], x["size_bytes"]), []).append(x)
    return {k: v for k, v in out.items() if len(v) > 1}


@pytest.mark.parametrize("seed", range(4))
def test_quarantine_equals_a_loop(spark, seed):
    rows = catalog(seed)
    left = {}
    for x in rows:
        left[x["content_hash"]] = left.get(x["content_hash"], 0) + is_live(x)
    removable = [x for g in groups(rows).values() for x in g if x is not min(g, key=canonical_order)]
    want = set()
    for x in sorted(removable, key=lambda x: (x["content_hash"], x["size_bytes"], x["source"], x["key"])):
        h = x["content_hash"]
        if left[h] <= 1:
            want.add((x["source"], x["key"], "last-copy-protection", "skipped"))
        elif x["source"] not in REPLICATED:
            want.add((x["source"], x["key"], "quarantine", "error"))
        else:
            want.add((x["source"], x["key"], "quarantine", "quarantined"))
            left[h] -= 1
    for parts in (1, 5):
        got = {tuple(r) for r in D.quarantine_decisions(frame(spark, rows, parts), PRIORITY, REPLICATED).select("source", "key", "action", "result").collect()}
        assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_tombstones_equal_a_loop(spark, seed):
    before = catalog(seed)
    r = random.Random(seed)
    now = [x for x in before if r.random() < 0.7]
    kept = {(x["source"], x["key"]) for x in now}
    left = {}
    for x in before:
        if x["source"] in REPLICATED:
            left[x["content_hash"]] = left.get(x["content_hash"], 0) + is_live(x)
    want, seen = [], set()
    for m in sorted((x for x in before if x["source"] in REPLICATED and (x["source"], x["key"]) not in kept), key=lambda x: (x["source"], x["key"])):
        for p in sorted((x for x in before if is_live(x) and x["source"] in REPLICATED and x["source"] != m["source"] and x["content_hash"] == m["content_hash"]), key=lambda x: (x["source"], x["key"])):
            at = (p["source"], p["key"])
            if at in seen:
                continue
            if left[p["content_hash"]] <= 1:
                want.append((*at, m["source"], m["key"], "last-copy-protection", "skipped"))
            elif p["source"] == "s3-archive":
                want.append((*at, m["source"], m["key"], "tombstone", "error"))
            else:
                want.append((*at, m["source"], m["key"], "tombstone", "success"))
                left[p["content_hash"]] -= 1
                seen.add(at)
    got = deletion.tombstone_decisions(frame(spark, before), frame(spark, now) if now else frame(spark, before).limit(0), REPLICATED, ["s3-prod", "gcs-primary"])
    assert sorted(tuple(x) for x in got.select("source", "key", "triggering_source", "triggering_key", "action", "result").collect()) == sorted(want)


@pytest.mark.parametrize("policy", ["skip", "overwrite", "rename"])
@pytest.mark.parametrize("there", [None, "a" * 64, "b" * 64])
def test_conflict_table(spark, policy, there):
    base = {"size_bytes": 1, "last_seen_at": "2024-01-01T00:00:00Z", "last_modified": "x", "content_type": None, "quarantined_at": None, "tombstoned_at": None, "origin": "s3-prod"}
    rows = [base | {"source": "s3-prod", "key": "photos/img.jpg", "content_hash": "a" * 64}]
    objects = rows + ([base | {"source": "gcs-primary", "key": "photos/img.jpg", "content_hash": there}] if there else [])
    plan = replication.replication_plan(frame(spark, rows), ["s3-prod", "gcs-primary"]) if True else None
    extra = replication.source_pairs(["s3-prod", "gcs-primary"])
    assert extra == [("s3-prod", "gcs-primary"), ("gcs-primary", "s3-prod")]
    (got,) = replication.resolve_conflicts(plan.where("dst = 'gcs-primary'"), frame(spark, objects), policy).collect()
    want = "replicate" if there is None else "replicate-skip-existing" if there == "a" * 64 else {"skip": "key-conflict", "overwrite": "overwrite", "rename": "rename"}[policy]
    assert got.action == want
    assert got.renamed_key == ("photos/img.jpg.aaaaaaaa" if want == "rename" else None)
    assert got.previous_content_hash == ("b" * 64 if want == "overwrite" else None)


@pytest.mark.parametrize("seed", range(3))
def test_plan_brings_the_stores_together_and_then_has_nothing_to_do(spark, seed):
    rows = catalog(seed)
    plan = [(x.src, x.dst, x.content_hash) for x in replication.replication_plan(frame(spark, rows), REPLICATED).collect()]
    held = {n: {x["content_hash"] for x in rows if x["source"] == n and is_live(x)} for n in REPLICATED}
    assert set(plan) == {(a, b, h) for a in REPLICATED for b in REPLICATED if a != b for h in held[a] - held[b]}
    more = [next(x for x in rows if x["content_hash"] == h and x["source"] == a and is_live(x)) | {"source": b, "key": f"{a}-{h[:4]}"} for a, b, h in plan]
    assert replication.replication_plan(frame(spark, rows + more), REPLICATED).isEmpty()


@pytest.mark.parametrize("seed", range(3))
def test_divergence(spark, seed):
    rows = catalog(seed)
    held = {}
    for x in rows:
        if x["source"] in REPLICATED:
            held.setdefault(x["content_hash"], set()).add(x["source"])
    got = {x.content_hash: (x.present_in, x.absent_from) for x in drift.divergent_hashes(frame(spark, rows), REPLICATED).collect()}
    assert got == {h: (sorted(s), sorted(set(REPLICATED) - s)) for h, s in held.items() if len(s) < 3}


def test_empty_catalog(spark):
    none = spark.createDataFrame([], CATALOG)
    assert D.duplicate_groups(none).isEmpty()
    assert D.quarantine_decisions(none, PRIORITY, REPLICATED).isEmpty()
    assert replication.replication_plan(none, REPLICATED).isEmpty()
    assert drift.divergent_hashes(none, REPLICATED).isEmpty()


def test_imports(spark):
    files = spark.createDataFrame(
        [("f1", "image/JPEG", "a" * 64, {"createdTime": "2023-04-15T10:30:00Z", "drive_path": "x/pic ü.jpg"}), ("f2", "video/mp4", "c" * 64, {"createdTime": "not-a-date"}),
         ("f3", "application/vnd.google-apps.document", "d" * 64, {}), ("f4", None, "e" * 64, {}), ("f5", "video/mp4", "c" * 64, {"drive_file_id": "", "createdTime": "2024-13-40T99:99:99Z"})],
        "key string, content_type string, content_hash string, user_metadata map<string,string>",
    )
    held = frame(spark, [catalog(0)[0] | {"source": "s3-prod", "content_hash": "a" * 64, "quarantined_at": None, "tombstoned_at": None}])
    got = {x.key: (x.action, x.destination_key) for x in importing.import_plan(files, held, REPLICATED).collect()}
    assert got["f1"] == ("drive-skip-existing", "google-drive/2023/04/f1__pic__.jpg")
    assert got["f2"] == ("drive-import-success", "google-drive/unknown-year/unknown-month/f2__f2") and got["f5"][0] == "drive-import-success"
    assert got["f3"][0] == "drive-skip-native-doc" and got["f4"][0] == "drive-skip-unsupported"
    assert importing.import_plan(files, held, REPLICATED, dedupe_within_batch=True).where(F.col("action") == "drive-import-success").count() == 1
