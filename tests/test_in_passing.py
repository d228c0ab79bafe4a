"""Presence by bits, compact hashes, and counters that cost no job."""

import pytest
import test_operators as O
from pyspark.sql import functions as F
from test_files_and_runs import NOW, seed

from ledgerloom.functions.columns import compact_hash, full_hash
from ledgerloom.operators import drift, report
from ledgerloom.operators.ledger import replication_counters
from ledgerloom.plans import run
from ledgerloom.plans.observed import written


def test_compact_hashes_are_one_to_one(spark):
    rows = [None, "", "a" * 64, "A" * 64, "0" * 63, "é" * 32, "\x01" + "a" * 32, "0123456789abcdef" * 4, "\x00"]
    got = spark.createDataFrame([(x,) for x in rows], "h string").select("h", compact_hash(F.col("h")).alias("c")).select("h", "c", full_hash(F.col("c")).alias("f")).collect()
    assert [r.f for r in got] == rows and len({bytes(r.c) for r in got if r.c is not None}) == len(rows) - 1 and [len(r.c) for r in got if r.h == "a" * 64] == [33]


@pytest.mark.parametrize("n", [1, 3, 63, 64, 130])
def test_divergence_of_any_number_of_sources(spark, n):
    names = [f"s{i:03d}" for i in range(n)]
    rows = [O.catalog(0)[0] | {"source": s, "key": f"k{j}", "content_hash": f"{j:064x}" if j else "odd hash"} for i, s in enumerate(names) for j in range(12) if (i * 7 + j * j) % 5 or j == 11]
    held = {}
    for x in rows:
        held.setdefault(x["content_hash"], set()).add(x["source"])
    got = {x.content_hash: (x.present_in, x.absent_from, x.canonical.source, x.canonical.key) for x in drift.divergent_hashes(O.frame(spark, rows), names).collect()}
    first = {h: min((x["source"], x["key"]) for x in rows if x["content_hash"] == h) for h in held}
    assert got == {h: (sorted(s), sorted(set(names) - s), *first[h]) for h, s in held.items() if len(s) < n}
    assert drift.divergent_hashes(O.frame(spark, rows), []).isEmpty()


def shuffled(df):
    """Bytes that the plan's exchanges took."""
    df.collect()
    total, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        else:
            if name == "Exchange":
                total += node.metrics().apply("dataSize").value()
            kids = node.children()
            todo += [kids.apply(i) for i in range(kids.size())]
    return total


def test_presence_shuffles_half_the_bytes(spark):
    names = [f"store-{i}" for i in range(8)]
    rows = spark.range(40_000).select(F.concat(F.lit("store-"), F.col("id") % 8).alias("source"), F.lit("k").alias("key"), F.sha2((F.col("id") % 5000).cast("string"), 256).alias("content_hash"), F.lit(1).alias("size_bytes"))
    sets = rows.groupBy("content_hash").agg(F.array_sort(F.collect_set("source")).alias("s"))
    assert 2 * shuffled(drift.presence(rows, names).select("hash", "bits")) <= shuffled(sets)
    flags = rows.groupBy("source").agg(F.count("*"), F.sum(F.when(F.col("size_bytes") >= 0, F.col("size_bytes"))), F.count_distinct("content_hash"))
    assert shuffled(report.per_source_counts(rows)) < 0.8 * shuffled(flags)


def test_counters_cost_no_job(spark, tmp_path):
    tracker = spark.sparkContext.statusTracker()

    def jobs(f):
        spark.sparkContext.setJobGroup(name := f"g{f.__name__}", "")
        f()
        spark.sparkContext._jsc.sc().clearJobGroup()
        return len(tracker.getJobIdsForGroup(name))

    df, out = spark.range(1000, numPartitions=3), {}

    def plain():
        df.write.parquet(str(tmp_path / "a"))

    def counted():
        out["got"] = written(df, str(tmp_path / "b"), {"odd": F.count_if(F.col("id") % 2 == 1), "none": F.sum(F.when(F.col("id") < 0, 1))})

    assert jobs(counted) == jobs(plain)
    table, seen = out["got"]
    assert seen == {"rows": 1000, "odd": 500, "none": 0} and table.count() == 1000


def test_counters_of_plans_that_turn_out_empty(spark, tmp_path):
    some, none = spark.range(10), spark.createDataFrame([], "id long")
    empties = [none, some.limit(0), some.where("id < 0"), some.where("false"), some.join(none, "id"), none.repartition(3).join(some.repartition(2, "id"), "id", "left"), some.repartition(3).where("id > 20").groupBy("id").count()]
    for i, df in enumerate(empties):
        table, seen = written(df, str(tmp_path / f"{i}"), {"n": F.sum("id")})
        assert seen == {"rows": 0, "n": 0} and table.isEmpty()


def test_a_runs_counters_are_its_ledgers(spark, tmp_path):
    settings, *_ = seed(tmp_path)
    done = run.run(spark, settings, now=NOW, apply=True, confirmed=True)
    assert done.counters == replication_counters(done.ledger).first().asDict() and done.counters["replicate"] == 2
