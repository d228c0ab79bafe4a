"""Files that come back as they were, and whole runs over stores in folders."""

import json
import os

import pytest
from test_operators import catalog, frame

from ledgerloom.plans import control, run
from ledgerloom.schema import CATALOG, LEDGER
from ledgerloom.sources import jsonl, stores, trees
from ledgerloom.streaming import ledger as stream

NOW = "2024-06-15T12:00:00Z"


@pytest.mark.parametrize("seed", range(2))
def test_catalog_round_trip(spark, tmp_path, seed):
    rows = catalog(seed)
    a, b = str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")
    jsonl.write_catalog(frame(spark, rows), a)
    back = jsonl.read_catalog(spark, a)
    assert sorted(map(str, back.collect())) == sorted(map(str, frame(spark, rows).collect()))
    jsonl.write_catalog(back.repartition(7), b)
    assert open(a, "rb").read() == open(b, "rb").read()


def test_export_by_many_tasks_is_the_export_of_one(spark, tmp_path):
    rows = spark.range(20_000).selectExpr(
        "concat('s', id % 7) AS source", "concat('k', id) AS key", "sha2(CAST(id % 900 AS STRING), 256) AS content_hash", "id AS size_bytes", "'t' AS last_seen_at", "'t' AS last_modified",
        "CAST(NULL AS STRING) AS content_type", "CAST(NULL AS STRING) AS quarantined_at", "CAST(NULL AS STRING) AS tombstoned_at", "'\"q\"' AS origin",
    )
    a, b, c = (str(tmp_path / n) for n in "abc")
    lines = jsonl.to_lines(rows.orderBy("content_hash", "source", "key"), CATALOG)
    jsonl.write_file(lines.coalesce(1), a)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        before = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup("export", "")
        jsonl.write_catalog(rows.repartition(9), b)
        stages = [before.getStageInfo(s) for j in before.getJobIdsForGroup("export") for s in before.getJobInfo(j).stageIds]
        assert max(s.numTasks for s in stages if s) > 1 and stages[-1].numTasks > 1  # the writing stage too
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.sparkContext._jsc.sc().clearJobGroup()
    assert open(a, "rb").read() == open(b, "rb").read() and os.listdir(tmp_path) and not os.path.exists(f"{b}.writing")
    jsonl.write_catalog(rows.limit(0), c)
    assert open(c, "rb").read() == b"" and jsonl.read_catalog(spark, b).count() == 20_000


def test_bad_catalog_line_is_named(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    good = json.dumps({f.name: 1 if f.name == "size_bytes" else "x" for f in CATALOG})
    p.write_text(f"{good}\n\n{good}\n")
    with pytest.raises(jsonl.CatalogInvalid) as e:
        jsonl.read_catalog(spark, str(p))
    assert e.value.line == 2
    p.write_text("")
    assert jsonl.read_catalog(spark, str(p)).isEmpty()


def test_tolerant_ledger(spark, tmp_path):
    row = {f.name: None for f in LEDGER} | {"timestamp": "t", "run_id": "r", "action": "replicate", "result": "success", "extra": {"a": "b"}}
    lines = [json.dumps(row), "{", json.dumps(row | {"more": 1}), json.dumps({k: v for k, v in row.items() if k != "key"}), json.dumps(row | {"action": "dance"}), json.dumps(row | {"size_bytes": True}), "[]", "", json.dumps(row | {"extra": {"a": 1}}), json.dumps(row | {"size_bytes": 2**64})]
    p = tmp_path / "l.jsonl"
    p.write_bytes(("\r\n".join(lines) + "\n").encode())
    good, bad = jsonl.read_ledger(spark, str(p))
    assert [r.line_no for r in good.collect()] == [1]
    want = ["json_syntax", "unknown_key", "missing_field", "unknown_enum", "invalid_value", "json_syntax", "json_syntax", "invalid_value", "invalid_value"]
    assert [r.category for r in bad.orderBy("line_no").collect()] == want


def test_settings_round_trip():
    text = '[[sources]]\nname = "a"\nkind = "s3"\nroot = "/x"\n[replication]\npairs = [["a", "b"]]\n'
    s = control.parse_settings(text)
    assert control.parse_settings(control.print_settings(s)) == s
    for bad in ("[replication]\nnonsense = 1\n", "[retries]\nmax_retries = 99\n", "[retries]\nmax_retries = true\n", '[replication]\non_key_conflict = "x"\n', "= 1"):
        with pytest.raises(control.SettingsError):
            control.parse_settings(bad)


def test_lock_has_one_holder(tmp_path):
    path = str(tmp_path / "lock")
    with control.writer_lock(path, "one"), pytest.raises(control.LockConflict), control.writer_lock(path, "two", timeout_s=0.3):
        pass
    with control.writer_lock(path, "three"):
        pass


def test_retries():
    waits, calls = [], []

    def f():
        calls.append(1)
        raise control.Transient(retry_after_s=2 if len(calls) == 2 else 0)

    with pytest.raises(control.RetriesExhausted):
        control.retried(f, control.RetrySettings(max_retries=3), waits.append)
    assert len(calls) == 4 and waits == [0.5, 2.0, 2.0]


def seed(tmp_path):
    s3, gcs, drive = (stores.FolderStore(str(tmp_path / n)) for n in ("s3", "gcs", "drive"))
    s3.write("photos/dup-A.jpg", iter([b"D" * 10]), {"origin": "s3-prod"})
    s3.write("photos/dup-B.jpg", iter([b"D" * 10]), {"origin": "s3-prod"})
    gcs.write("photos/img.jpg", iter([b"G"]), {"origin": "gcs-archive"})
    for k, n in (("file-A", "vacation.jpg"), ("file-B", "sunset.jpg")):
        drive.write(k, iter([k.encode()]), {"createdTime": "2024-01-15T08:30:00Z", "drive_path": n}, "image/jpeg")
    sources = tuple(control.SourceSettings(n, k, str(tmp_path / f)) for n, k, f in (("s3-prod", "s3", "s3"), ("gcs-archive", "gcs", "gcs"), ("drive-camera", "google_drive", "drive")))
    settings = control.Settings(sources, duplicates=control.DuplicateSettings(("s3-prod", "gcs-archive")), imports=control.ImportSettings("drive-camera", "s3-prod"), runtime=control.RuntimeSettings(str(tmp_path / "catalog")))
    return settings, s3, gcs


def test_full_run(spark, tmp_path):
    settings, s3, gcs = seed(tmp_path)
    before = [x["key"] for x in s3.list()]
    dry = run.run(spark, settings, now=NOW)
    assert dry.code == control.Exit.OK and [x["key"] for x in s3.list()] == before
    assert {r.result for r in dry.ledger.where("action = 'replicate'").collect()} == {"planned"}
    first = run.run(spark, settings, now=NOW, apply=True)
    assert first.code == control.Exit.FIRST_PASS_REVIEW_REQUIRED
    assert not any("quarantined-at" in x["user_metadata"] for x in s3.list())
    done = run.run(spark, settings, now=NOW, apply=True, confirmed=True)
    assert done.code == control.Exit.OK
    keys = {x["key"]: x["user_metadata"] for x in s3.list()}
    assert {"photos/img.jpg", "google-drive/2024/01/file-A__vacation.jpg", "google-drive/2024/01/file-B__sunset.jpg"} <= set(keys)
    assert keys["photos/img.jpg"]["origin"] == "gcs-archive"
    assert "quarantined-at" in keys["photos/dup-B.jpg"] and "quarantined-at" not in keys["photos/dup-A.jpg"]
    assert gcs.head("photos/dup-A.jpg")["user_metadata"]["origin"] == "s3-prod"
    (summary,) = done.ledger.where("action = 'summary'").collect()
    assert summary.extra["cold_start"] == "true" and summary.extra["apply"] == "true"
    for part in ("duplicate groups by source\n  source=s3-prod groups=1\n", "files to import\n  files=2\n"):
        assert part in dry.report
    (told,) = (tmp_path / "catalog").glob(f"reconciliation-*-{dry.run_id}.txt")
    assert told.read_text() == dry.report
    (info,) = dry.events.where("level = 'INFO'").collect()
    assert info.detail["new:s3-prod"] == "2" and info.detail["removed:drive-camera"] == "0"
    assert dry.events.where("level = 'WARN'").count() == int(info.detail["divergent_hashes_count"]) == dry.divergent.count()
    again = run.run(spark, settings, now=NOW, apply=True, confirmed=True)
    assert again.ledger.where("action IN ('overwrite', 'key-conflict')").isEmpty()


def test_catalog_outlives_a_replacement_cut_short(spark, tmp_path):
    at = f"{tmp_path}/catalog"
    read = lambda: [r.id for r in spark.read.parquet(at).collect()]
    write = lambda n, path: spark.range(n, n + 1).write.mode("overwrite").parquet(path)
    assert not run.settled_catalog(spark, at)
    write(1, f"{at}.new")
    run.replace_catalog(spark, at)
    assert run.settled_catalog(spark, at) and read() == [1]
    os.rename(at, f"{at}.old")
    assert run.settled_catalog(spark, at) and read() == [1]  # nothing new was whole
    write(2, f"{at}.new")
    os.rename(at, f"{at}.old")
    assert run.settled_catalog(spark, at) and read() == [2]
    write(3, f"{at}.new")
    run.replace_catalog(spark, at)
    assert read() == [3] and not os.path.exists(f"{at}.old")


def test_read_only_store(tmp_path):
    s = stores.FolderStore(str(tmp_path), supports_writes=False)
    for f in (lambda: s.write("a", iter([b""]), {}), lambda: s.tag("a", "b", "c"), lambda: s.delete("a")):
        with pytest.raises(stores.ReadOnlyStore):
            f()


def test_listing_and_tree(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.txt").write_bytes(b"abc")
    rows = stores.listing(spark, "here", f"file:{tmp_path}").collect()
    assert [(r.source, r.key, r.size_bytes) for r in rows] == [("here", "x/a.txt", 3)]
    assert stores.contents(spark, "here", f"file:{tmp_path}").collect()[0].content == b"abc"
    tree = spark.createDataFrame([("1", "root", "a", True), ("2", "1", "b.jpg", False), ("3", "1", "c", True), ("4", "3", "d.jpg", False)], "id string, parent string, name string, is_folder boolean")
    assert {tuple(r) for r in trees.tree_paths(spark, tree, "root").collect()} == {("2", "a/b.jpg"), ("4", "a/c/d.jpg")}


def test_paths_of_deep_trees(spark):
    deep = [(f"f{i}", f"f{i - 1}" if i else "root", f"n{i}", True) for i in range(300)]
    circle = [("x", "y", "x", True), ("y", "x", "y", True), ("lost", "nowhere", "l", True), ("root", "above", "not shown", True), ("nameless", "root", None, True)]
    files = [("a", "f299", "a.jpg", False), ("b", "root", "b.jpg", False), ("c", "x", "c", False), ("d", "lost", "d", False), ("e", "f1", "e", False), ("e", "f0", "e", False), ("g", "nameless", None, False)]
    got = {tuple(r) for r in trees.tree_paths(spark, spark.createDataFrame(deep + circle + files, "id string, parent string, name string, is_folder boolean").repartition(3), "root").collect()}
    assert got == {("a", "/".join(f"n{i}" for i in range(300)) + "/a.jpg"), ("b", "b.jpg"), ("e", "n0/n1/e"), ("e", "n0/e"), ("g", "/")}


def test_the_first_of_a_repeated_name_counts(spark, tmp_path):
    import dataclasses

    settings, s3, _ = seed(tmp_path)
    again = control.SourceSettings("s3-prod", "google_drive", str(tmp_path / "elsewhere"))
    out = run.run(spark, dataclasses.replace(settings, sources=(*settings.sources, again), imports=control.ImportSettings("drive-camera", "no-such-store")), now=NOW, apply=True, confirmed=True)
    assert out.catalog.where("source = 's3-prod'").count() == len(list(s3.list())) - 1  # img.jpg came from the other store meanwhile
    failed = out.ledger.where("target = 'no-such-store'").select("action", "result", "error").distinct().collect()
    assert [tuple(r) for r in failed] == [("drive-import-success", "error", "no store no-such-store")]


def test_stream_takes_each_row_once(spark, tmp_path):
    new, target, check = (str(tmp_path / n) for n in ("new", "target", "check"))
    row = spark.createDataFrame([("t", "r", "replicate", "success", None, None, None, None, None, None, {})], LEDGER)
    for n in (1, 2):
        row.write.mode("append").parquet(new)
        stream.append_new(stream.ledger_stream(spark, new), target, check)
        assert spark.read.parquet(target).count() == n
