"""Listings by ranges of keys: even cuts, filters that reach the reader, reads that go on where they failed."""

import bisect
import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from ledgerloom.schema import CATALOG
from ledgerloom.sources import listing
from ledgerloom.sources.stores import FolderStore, Store


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import a test


class Keys(Store):
    """A store of keys alone, in memory; ``fails``: keys before which a read fails, so many times."""

    ranged = True

    def __init__(self, keys, fails=None, folder=None):
        self.keys, self.fails, self.folder = sorted(keys), fails or {}, folder

    def list(self, after="", upto=None):
        for k in self.keys[bisect.bisect_right(self.keys, after) : None if upto is None else bisect.bisect_right(self.keys, upto)]:
            if self.fails.get(k, 0) > 0:
                self.fails[k] -= 1
                raise OSError(f"before {k}")
            yield {"key": k, "size_bytes": len(k), "last_modified": "2024-01-01T00:00:00Z", "content_type": None, "user_metadata": {"a": "b"}, "etag": None, "provider_hash": None}

    read = head = write = tag = delete = None


Keys.__abstractmethods__ = frozenset()


def skewed(seed, n=30_000):
    """Four fifths below one prefix, of dense numbers; dates; a few anywhere, and some that aren't ASCII."""
    r = random.Random(seed)
    keys = {f"photos/2024/img-{k:08d}.jpg" for k in range(n * 8 // 10)}
    keys |= {f"logs/{2000 + r.randrange(25)}-{r.randrange(1, 13):02d}/{r.randrange(10**6)}" for _ in range(n // 10)}
    keys |= {"".join(r.choice("abcxyz0189/é日") for _ in range(r.randrange(1, 12))) for _ in range(n // 10)}
    return sorted(keys)


def sizes(keys, cuts):
    ends = [0, *(bisect.bisect_right(keys, c) for c in cuts), len(keys)]
    return [b - a for a, b in zip(ends, ends[1:])]


@pytest.mark.parametrize("seed", range(3))
def test_probes_cut_a_skewed_store_evenly(seed):
    keys, asked = skewed(seed), []

    def page(after):
        asked.append(after)
        at = bisect.bisect_right(keys, after)
        return keys[at : at + 100]

    found = sizes(keys, listing.probed_cuts(page, 10, 100, 120))
    assert len(found) == 10 and max(found) <= 2 * len(keys) / 10 and len(asked) <= 120


@pytest.mark.parametrize("keys", [[], ["a"], ["a", "b"], ["", "a"], [f"{k}" for k in range(50)], ["x" * 300 + str(k) for k in range(3000)], [chr(0x4E00 + k) for k in range(3000)]])
def test_cuts_of_any_store_are_in_order(keys):
    keys = sorted(k for k in keys if k)

    def page(after):
        at = bisect.bisect_right(keys, after)
        return keys[at : at + 20]

    cuts = listing.probed_cuts(page, 8, 20, 60)
    assert cuts == sorted(set(cuts)) and sum(sizes(keys, cuts)) == len(keys)
    assert listing.sampled_cuts(keys[:5] * 2, 3) == sorted(set(listing.sampled_cuts(keys[:5], 3)))


def rows(df):
    return sorted((r.source, r.key or "", r.size_bytes or 0, str(r.user_metadata), r.list_error or "") for r in df.collect())


def test_ranges_give_what_one_task_gives(spark):
    keys = {"a": skewed(1, 5000), "b": [], "c": ["only"]}
    factory = lambda: {n: Keys(k) for n, k in keys.items()}
    one = listing.store_listing(spark, [*keys], factory, parts=1)
    many = listing.store_listing(spark, [*keys], factory, parts=6, page=50)
    assert one.rdd.getNumPartitions() == 3 and many.rdd.getNumPartitions() == 6 + 1 + 1
    assert rows(one) == rows(many) and many.count() == len(keys["a"]) + 1
    per_task = [n for (s, n) in many.where("source = 'a'").groupBy(F.spark_partition_id()).count().collect()]
    assert max(per_task) <= 2 * len(keys["a"]) / 6


def test_the_last_catalog_says_where_to_cut(spark):
    keys = skewed(2, 8000)
    row = lambda k: ("a", k, "0" * 64, 1, "t", "t", None, None, None, None)
    known = spark.createDataFrame([row(k) for k in keys[::2]], CATALOG)
    sample = listing.key_samples(known, ["a", "b"], 64 * 8)
    assert sample["b"] == [] and len(sample["a"]) == 512 and sample == listing.key_samples(known.repartition(5), ["a", "b"], 512)
    found = sizes(keys, listing.sampled_cuts(sample["a"], 8))
    assert len(found) == 8 and max(found) <= 2 * len(keys) / 8
    df = listing.store_listing(spark, ["a"], lambda: {"a": Keys(keys)}, parts=8, known=known)
    assert df.rdd.getNumPartitions() == 8 and df.count() == len(keys)


FILTERS = [
    "source = 'a'", "source IN ('b', 'c')", "source = 'none'", "key LIKE 'photos/2024/img-0000%'", "key >= 'logs/' AND key < 'logs/2010'", "key > 'photos'", "key = 'only'", "key IN ('only', 'nothing')", "size_bytes > 26",
    "size_bytes <= 5 AND source = 'a'", "last_modified > '2024-01-01T00:00:00Z'", "last_modified >= '2023' AND key < 'b'", "list_error IS NULL AND key <= 'm'", "key LIKE '%é%'", "key IS NULL", "NOT key = 'only'",
]


def test_filters_reach_the_reader_and_change_no_result(spark):
    keys = {"a": skewed(3, 2000), "b": ["only", "photos/2024/img-00000001.jpg"], "c": ["é", "\U0010ffff", "logs/"]}
    df = listing.store_listing(spark, [*keys], lambda: {n: Keys(k) for n, k in keys.items()}, parts=4, page=50)
    plain = spark.createDataFrame(df.collect(), df.schema)
    for condition in FILTERS:
        assert rows(df.where(condition)) == rows(plain.where(condition)), condition
    plan = df.where("source = 'a' AND key LIKE 'logs/%' AND key LIKE '%1%' AND size_bytes > 20")._jdf.queryExecution().executedPlan().toString()
    assert "Contains(key" in plan and not any(left in plan for left in ("StartsWith", "= a", "> 20"))  # only what the reader doesn't take is left to Spark
    assert df.where("source = 'b'").rdd.getNumPartitions() == 1  # two keys need no cut, and the others' ranges are gone


def test_bounds_of_a_filter_leave_out_pages():
    reader = listing.Reader(["a"], lambda: {"a": Keys(skewed(4, 3000))}, 4, {}, 50, 0)
    assert list(reader.pushFilters([listing.DS.StringStartsWith(("key",), "logs/2010"), listing.DS.StringContains(("key",), "1")])) == [listing.DS.StringContains(("key",), "1")]
    parts = reader.partitions()
    assert all("logs/2010" > p.after >= "logs/201/" or p.after.startswith("logs/2010") for p in parts) and all(p.upto.startswith("logs/2010") for p in parts)


def test_reads_go_on_where_they_failed(spark, monkeypatch):
    monkeypatch.setattr(listing.Reader, "pause_s", 0)
    keys = [f"k{n:03d}" for n in range(200)]
    shared = Keys(keys, {"k050": 2, "k051": 3, "k120": 1})
    reader = listing.Reader(["a"], lambda: {"a": shared}, 1, {}, 50, 3)
    got = [k for b in reader.read(listing.KeyRange("a")) for k in b.column(1).to_pylist()]
    assert got == keys  # each once, for all failures pass
    lasting = Keys(keys, {"k100": 10**6})
    reader = listing.Reader(["a"], lambda: {"a": lasting}, 1, {}, 50, 3)
    (batch,) = reader.read(listing.KeyRange("a"))
    assert batch.column(1).to_pylist() == [*keys[:100], None] and batch.column(8).to_pylist()[-1] == "OSError: before k100"


def test_folder_store_by_ranges(spark, tmp_path):
    store = FolderStore(str(tmp_path))
    keys = [f"p/{k}é" for k in range(40)] + ["a b", "%41", "z\U0001f600"]
    for k in keys:
        store.write(k, iter([k.encode()]), {"x": k})
    assert [r["key"] for r in store.list()] == sorted(keys) and [r["key"] for r in store.list("p/1é", "p/3é")] == [k for k in sorted(keys) if "p/1é" < k <= "p/3é"]
    factory = lambda: {"f": FolderStore(str(tmp_path))}
    assert rows(listing.store_listing(spark, ["f"], factory, parts=5, page=3)) == rows(listing.store_listing(spark, ["f"], factory, parts=1))
