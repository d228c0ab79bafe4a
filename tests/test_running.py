"""Running sums inside groups of any size, rows dealt out by weight, and the decisions that rest on them for a hot hash."""

import random
from statistics import median

import pytest
import test_operators as O
from pyspark.sql import functions as F

from ledgerloom.operators import deletion, replication, running
from ledgerloom.operators import duplicates as D


@pytest.fixture(params=[(8, 64), (12, 3)])
def narrow(request, monkeypatch):
    """Ranges of a few rows, from all rows or from a sample."""
    monkeypatch.setattr(running, "LEAST", request.param[0])
    monkeypatch.setattr(running, "SAMPLED", request.param[1])


def test_running_sums_equal_a_loop(spark, narrow):
    r = random.Random(5)
    rows = [(r.choice(["hot", "hot", "a", "b", None]), r.randrange(50), f"k{i}", r.randrange(-3, 9)) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, o int, k string, v int").repartition(4)
    got = {x.k: x.before for x in running.running_before(df, ["g"], ["o", "k"], F.col("v"), "before", 900).collect()}
    sums, want = {}, {}
    for g, o, k, v in sorted(rows, key=lambda x: (x[1], x[2])):
        want[k] = sums.get(g, 0)
        sums[g] = want[k] + v
    assert got == want
    parts = running.ranges(df, ["g"], ["o", "k"], 900).groupBy("g", running._PART).count().collect()
    assert len([1 for x in parts if x.g == "hot"]) > 10


def test_no_task_sorts_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(running, "LEAST", 500)
    n = 60_000
    rows = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("g"), F.col("id").alias("o"))
    dealt = running.ranges(rows, ["g"], ["o"], n).repartition(12, "g", running._PART)
    sizes = [x["count"] for x in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 12 and max(sizes) <= 2 * median(sizes)
    out = running.running_before(rows, ["g"], ["o"], F.lit(1), "b", n).where("g = 'hot'")
    assert out.where("b <> o / 3").isEmpty() and out.count() == n / 3


@pytest.mark.parametrize("seed", [0, 1])
def test_decisions_in_ranges_equal_loops(spark, narrow, seed, monkeypatch):
    # All 240 objects share two hashes.
    def hot(s, n=240, real=O.catalog):
        rows = real(s, n * 4)
        for i, x in enumerate(rows):
            x["content_hash"] = "ab"[i % 3 == 0] * 64
        return rows

    monkeypatch.setattr(O, "catalog", hot)
    O.test_quarantine_equals_a_loop(spark, seed)
    O.test_tombstones_equal_a_loop(spark, seed)
    rows = hot(seed)
    got = {(x.source, x.key): x.rn for x in D.canonical_members(O.frame(spark, rows), O.PRIORITY).collect()}
    want = {(x["source"], x["key"]): k + 1 for g in O.groups(rows).values() for k, x in enumerate(sorted(g, key=O.canonical_order))}
    assert got == want


def test_canonical_choice_and_plans_sort_no_group(spark):
    rows = O.frame(spark, O.catalog(3))
    for df in (D.removal_plan(rows, O.PRIORITY), replication.replication_plan(rows, O.REPLICATED)):
        assert "Window" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("missing", [40, 160])
def test_tombstones_make_no_pairs(spark, missing):
    """One hash, as many missing objects as peers: what is made grows with both, not with their product."""
    names = ["s0", "s1", "s2"]
    row = O.catalog(0)[0] | {"content_hash": "a" * 64, "quarantined_at": None, "tombstoned_at": None}
    before = [row | {"source": names[i % 3], "key": f"k{i:04d}"} for i in range(2 * missing)]
    now = before[missing:]
    out = deletion.tombstone_decisions(O.frame(spark, before), O.frame(spark, now), names, names)
    done = out.collect()
    assert len([x for x in done if x.result == "success"]) == 2 * missing - 1
    plan = out._jdf.queryExecution()
    metrics, todo = [], [plan.executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if "Join" in name and node.metrics().contains("numOutputRows"):
            metrics.append(node.metrics().apply("numOutputRows").value())
        kids = node.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    assert metrics and max(metrics) <= 4 * missing


def test_rows_dealt_by_weight(spark):
    small = [(f"k{i:05d}", 1000 + i % 700) for i in range(10_000)]
    df = spark.createDataFrame([*small, ("huge", 10**9), ("none", None), ("zero", 0)], "key string, size long").repartition(3)
    dealt = running.dealt_by_weight(df, F.col("size"), ["key"], 16)
    got = dealt.groupBy(F.spark_partition_id().alias("p")).agg(F.sum("size").alias("s"), F.max("size").alias("m"), F.count("*").alias("n")).collect()
    assert dealt.columns == ["key", "size"] and dealt.count() == 10_003
    (alone,) = [x for x in got if x.m == 10**9]
    assert alone.n == 1
    light = [x.s or 0 for x in got if x.m != 10**9]
    mean = sum(x[1] for x in small) / 16
    assert len(light) == 16 and all(abs(x - mean) <= 1700 for x in light)


@pytest.mark.parametrize("rows", [[], [("a", 0), ("b", 0), ("c", None)], [("a", 5)], [("a", -5), ("b", 3)]])
def test_odd_weights(spark, rows):
    df = spark.createDataFrame(rows, "key string, size long")
    assert sorted(map(str, running.dealt_by_weight(df, F.col("size"), ["key"], 3).collect())) == sorted(map(str, df.collect()))
