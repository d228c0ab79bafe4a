"""Payloads and journals: what a run says, and what a crash leaves."""

import os
import random

import pytest
import test_operators as O
from test_files_and_runs import NOW, seed

from ledgerloom.operators import replication
from ledgerloom.plans import control, effects, journal, run
from ledgerloom.schema import LEDGER, OUTCOME
from ledgerloom.sources.stores import FolderStore


def sequential(rows, objects):
    """Conflicts under new names, one row after the other."""
    held = dict(objects)
    out = []
    for src, dst, key, value in sorted(rows, key=lambda x: (x[0], x[1], x[3])):
        place, renamed, first = key, None, "replicate"
        if (dst, key) in held and held[dst, key] != value:
            renamed = place = f"{key}.{value[:8]}"
            first = "rename"
        if (dst, place) not in held:
            held[dst, place] = value
            out.append((src, dst, key, value, first, renamed, None))
        elif held[dst, place] == value:
            out.append((src, dst, key, value, "replicate-skip-existing", renamed, None))
        else:
            out.append((src, dst, key, value, "key-conflict", renamed, held[dst, place]))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(12))
def test_renames_equal_a_loop_where_names_chain(spark, seed):
    r = random.Random(seed)
    hashes = [c * 64 for c in "abc"] + ["a" * 8 + "d" * 56]
    keys = ["k", "k.aaaaaaaa", "k.bbbbbbbb", "k.aaaaaaaa.bbbbbbbb", "k.bbbbbbbb.bbbbbbbb", "m", "m.cccccccc", "n.zz", "k.cccccccc.aaaaaaaa.aaaaaaaa"]
    names = ["s0", "s1", "s2", "s3", "s4"]
    rows = {(s, k): r.choice(hashes) for s in names[:4] for k in keys if r.random() < 0.6}
    plan = [(s, "s4", k, h) for (s, k), h in rows.items()]
    objects = {("s4", k): r.choice([*hashes, None]) for k in keys if r.random() < 0.25}
    plan_df = spark.createDataFrame([(*x, 5, "elsewhere") for x in plan], "src string, dst string, key string, content_hash string, size_bytes long, origin string").repartition(3)
    objects_df = spark.createDataFrame([(d, k, h) for (d, k), h in objects.items()] + [("s0", "k", "z")], "source string, key string, content_hash string")
    got = replication.resolve_conflicts(plan_df, objects_df, "rename")
    assert sorted((tuple(x) for x in got.select("src", "dst", "key", "content_hash", "action", "renamed_key", "observed_content_hash").collect()), key=str) == sequential(plan, objects)


def effects_of(keys):
    return [("quarantine", "quarantined", "a", None, k, "0" * 64, 1, None, None, {"x": k}) for k in keys]


class Fragile(FolderStore):
    """Notes every tag it sets; the third one of a first attempt takes the whole process down."""

    def tag(self, key, name, value):
        log = self.root / "log"
        n = len(log.read_text().splitlines()) if log.exists() else 0
        if n == 3 and not (self.root / "fell").exists():
            (self.root / "fell").touch()
            os._exit(1)
        super().tag(key, name, value)
        with log.open("a") as f:
            f.write(f"{key}\n")


def test_a_task_killed_halfway_leaves_each_effect_once(spark, tmp_path):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    root, notes = str(tmp_path / "store"), str(tmp_path / "runs" / "r1" / "journal")
    keys = [f"k{i}" for i in range(8)]
    for k in keys:
        FolderStore(root).write(k, iter([k.encode()]), {})
    decisions = spark.createDataFrame(effects_of(keys), OUTCOME).coalesce(1)
    told = {"run_id": "r1", "timestamp": NOW}
    once = lambda: effects.carry_out(decisions, lambda: {"a": Fragile(root)}, NOW, control.RetrySettings(1, 0, 0), 1, journal=f"{notes}/quarantine", told=told)
    with pytest.raises(Exception, match="crash|exit|EOF|aborted"):
        once().collect()
    ledger = str(tmp_path / "ledger")
    assert journal.journal_rows(spark, notes).count() == 3
    rows = once().collect()  # carried out again: what was done is taken from the journal
    assert sorted(r.key for r in rows) == keys and all(r.result == "quarantined" and r.extra == {"x": r.key} for r in rows)
    assert sorted((tmp_path / "store" / "log").read_text().split()) == keys  # each object was tagged once
    assert journal.recover(spark, str(tmp_path / "runs"), ledger) == ["r1"] and journal.recover(spark, str(tmp_path / "runs"), ledger) == []
    kept = spark.read.parquet(ledger).collect()
    assert sorted(r.key for r in kept) == keys and all((r.action, r.run_id, r.timestamp) == ("quarantine", "r1", NOW) for r in kept)


def test_a_run_that_ends_early_is_in_the_ledger_of_the_next(spark, tmp_path, monkeypatch):
    settings, s3, gcs = seed(tmp_path)
    folder = settings.runtime.folder

    def falls(*_, **__):
        raise RuntimeError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(run.drift, "divergent_hashes", falls)  # after all effects, before the ledger
        with pytest.raises(RuntimeError):
            run.run(spark, settings, now=NOW, apply=True, confirmed=True, run_id="first")
    assert os.path.isdir(f"{folder}/runs/first/journal") and not os.path.exists(f"{folder}/ledger")
    done = run.run(spark, settings, now=NOW, apply=True, confirmed=True, run_id="second")
    ledger = spark.read.parquet(f"{folder}/ledger")
    first = {(r.action, r.result, r.key) for r in ledger.where("run_id = 'first'").collect()}
    assert ("quarantine", "quarantined", "photos/dup-B.jpg") in first and ("drive-import-success", "success", "file-A") in first
    assert ledger.where("run_id = 'second'").count() == done.ledger.count() and not os.path.exists(f"{folder}/runs/second/journal")
    assert not os.path.exists(f"{folder}/runs/first/journal")


def test_payloads_of_a_run(spark, tmp_path):
    settings, s3, gcs = seed(tmp_path)
    s3.write("photos/img.jpg", iter([b"other"]), {})  # the same key as another store's object, and no origin
    drive = FolderStore(str(tmp_path / "drive"))
    drive.write("odd", iter([b"odd"]), {"drive_path": "o.jpg"}, "image/jpeg")
    drive.write("doc", iter([b"doc"]), {}, "application/vnd.google-apps.document")
    out = run.run(spark, settings, now=NOW, apply=True, confirmed=True)
    rows = out.ledger.collect()
    of = lambda action: [r for r in rows if r.action == action]
    (conflict,) = [r for r in of("key-conflict") if r.target == "gcs-archive"]
    assert set(conflict.extra) == {"expected_content_hash", "observed_content_hash"} and conflict.extra["expected_content_hash"] == conflict.content_hash != conflict.extra["observed_content_hash"]
    assert {r.extra["origin"] for r in of("source-tagged")} == {"s3-prod"}
    assert [r.extra for r in of("drive-skip-native-doc")] == [{"drive_file_id": "doc", "mime_type": "application/vnd.google-apps.document"}]
    assert [r.extra for r in of("drive-warning-missing-created-time")] == [{"drive_file_id": "odd", "drive_path": "o.jpg", "createdTime": ""}]
    assert {r.extra["drive_path"] for r in of("drive-import-success")} == {"vacation.jpg", "sunset.jpg", "o.jpg"}


def test_lasting_failures_tell_what_was_expected(spark, tmp_path):
    class Lossy(FolderStore):
        def read(self, key):
            yield b"short"

    class Busy(FolderStore):
        def tag(self, key, name, value):
            raise control.Transient()

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    FolderStore(a).write("k", iter([b"longer than that"]), {})
    rows = [("replicate", "success", "a", "b", "k", "0" * 64, 16, None, None, {}), ("tombstone", "success", "b", None, "k", "1" * 64, 16, None, None, {"triggering_key": "t"})]
    out = effects.carry_out(spark.createDataFrame(rows, OUTCOME), lambda: {"a": Lossy(a), "b": Busy(b)}, NOW, control.RetrySettings(1, 0, 0), 2).collect()
    (copy,) = [r for r in out if r.action == "replication-error"]
    assert copy.result == "error" and copy.size_bytes is None and copy.extra == {"expected_content_hash": "0" * 64, "observed_content_hash": "0" * 64}
    assert sorted((r.action, r.result) for r in out if r is not copy) == [("retries-exhausted", "error"), ("tombstone", "error")]


def test_old_runs_go(spark, tmp_path):
    for k in range(4):
        spark.range(1).write.parquet(str(tmp_path / "runs" / f"r{k}" / "t"))
        os.utime(tmp_path / "runs" / f"r{k}", (k, k))
    rows = spark.createDataFrame([("t", "r3", "summary", "success", None, None, None, None, None, None, {})], LEDGER)
    journal.close(spark, str(tmp_path / "runs"), "r3", rows, str(tmp_path / "ledger"), 2)
    assert sorted(os.listdir(tmp_path / "runs")) == ["r2", "r3"] and spark.read.parquet(str(tmp_path / "ledger")).first().run_id == "r3"
