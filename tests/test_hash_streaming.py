"""Bytes are read only where neither tag nor cache tells the hash, and a failure is a row."""

import hashlib

from pyspark.sql import functions as F

from ledgerloom.operators.catalog import resolve_hashes
from ledgerloom.plans.control import RetrySettings
from ledgerloom.plans.run import _store_hashes
from ledgerloom.schema import CATALOG
from ledgerloom.sources.listing import store_listing
from ledgerloom.sources.stores import FolderStore


def test_only_unknown_objects_are_read(spark, tmp_path):
    store = FolderStore(str(tmp_path / "a"))
    for k in range(6):
        tag = {"content-sha256": hashlib.sha256(b"tagged").hexdigest()} if k % 2 else {}
        store.write(f"k{k}", iter([b"x" * k, b"y" * 3_000_000]), tag)
    roots = {"a": str(tmp_path / "a")}
    listed = store_listing(spark, ["a"], lambda: {"a": FolderStore(roots["a"])}, parts=2)
    listed = spark.createDataFrame(listed.collect(), listed.schema).drop("list_error")
    for k in (0, 1, 3, 5):  # with their objects gone, three tagged rows still resolve, and one other fails
        store.delete(f"k{k}")
    before = spark.createDataFrame([], CATALOG)
    got = {r.key: r for r in resolve_hashes(listed, before, _store_hashes(lambda: {n: FolderStore(r) for n, r in roots.items()}, RetrySettings())).collect()}
    assert len(got) == 6
    for k in (1, 3, 5):
        assert (got[f"k{k}"].hash_from, got[f"k{k}"].content_hash) == ("tag", hashlib.sha256(b"tagged").hexdigest())
    for k in (2, 4):
        assert (got[f"k{k}"].hash_from, got[f"k{k}"].content_hash) == ("content", hashlib.sha256(b"x" * k + b"y" * 3_000_000).hexdigest())
    assert got["k0"].content_hash is None and got["k0"].hash_from is None and "FileNotFoundError" in got["k0"].hash_error


def test_rows_without_content_stay(spark):
    listing = spark.createDataFrame([("a", "k", {}, 1, "t"), ("a", "m", {}, 1, "t")], "source string, key string, user_metadata map<string,string>, size_bytes long, last_modified string")
    contents = spark.createDataFrame([("a", "k", bytearray(b"z"))], "source string, key string, content binary")
    got = {r.key: (r.content_hash, r.hash_error) for r in resolve_hashes(listing, spark.createDataFrame([], CATALOG), contents).collect()}
    assert got == {"k": (hashlib.sha256(b"z").hexdigest(), None), "m": (None, "no content")}


def test_objects_are_dealt_by_bytes_and_rows_are_computed_once(spark, tmp_path):
    store = FolderStore(str(tmp_path / "a"))
    sizes = {f"k{k:03d}": 1000 + k for k in range(300)} | {"huge": 60_000_000}
    for k, n in sizes.items():
        store.write(k, iter([b"x" * n]), {})
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("a", k, n, {"m": "1"}) for k, n in sizes.items()], "source string, key string, size_bytes long, user_metadata map<string,string>")
    written = lambda df, name: df.write.parquet(str(tmp_path / name)) or spark.read.parquet(str(tmp_path / name))
    hashes = _store_hashes(lambda: {"a": FolderStore(str(tmp_path / "a"))}, RetrySettings(), written)
    out = hashes(rows.mapInArrow(counted, rows.schema))
    got = out.withColumn("p", F.spark_partition_id()).collect()
    assert seen.value == len(sizes)
    assert {r.key: r.content_hash for r in got} == {k: hashlib.sha256(b"x" * n).hexdigest() for k, n in sizes.items()} and all(r.user_metadata == {"m": "1"} for r in got)
    by = {}
    for r in got:
        by.setdefault(r.p, []).append(r.key)
    assert by[next(r.p for r in got if r.key == "huge")] == ["huge"] and max(len(v) for v in by.values()) <= 300 / spark.sparkContext.defaultParallelism + 1
