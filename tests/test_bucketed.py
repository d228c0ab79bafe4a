"""The catalog in buckets: joins with a listing move the listing alone."""

import os
import shutil

import pytest
import test_operators as O
from pyspark.sql import functions as F

from ledgerloom.operators import catalog, deletion, drift
from ledgerloom.schema import CATALOG
from ledgerloom.sources import bucketed


@pytest.fixture
def stored(spark, tmp_path):
    rows = O.frame(spark, O.catalog(1, 400))
    path = str(tmp_path / "it's a catalog")
    bucketed.write_bucketed(rows, path, 400)
    return rows, path


def exchanges_above(df, table):
    """Exchanges between the scan of ``table``'s folder and the plan's root, leaving out those above the join."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = df._jdf.queryExecution().executedPlan()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    found = []

    def walk(node, below):
        if node.nodeName() == "AdaptiveSparkPlan":
            return walk(node.executedPlan(), below)
        if "Join" in node.nodeName():
            below = []
        if node.nodeName().startswith("Scan") and table in node.toString():
            found.append(list(below))
        kids = node.children()
        for i in range(kids.size()):
            walk(kids.apply(i), [*below, node.nodeName()])

    walk(plan, ["root"])
    return found


def test_round_trip_and_renames(spark, stored, tmp_path):
    rows, path = stored
    back = bucketed.read_bucketed(spark, path, CATALOG)
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect())) and back.schema.names == CATALOG.names
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) <= spark.sparkContext.defaultParallelism
    moved = str(tmp_path / "moved")
    shutil.move(path, moved)
    assert bucketed.read_bucketed(spark, moved, CATALOG).count() == rows.count() == spark.read.parquet(moved).count()
    bucketed.write_bucketed(rows.limit(3), path, 3)
    assert bucketed.read_bucketed(spark, path, CATALOG).count() == 3  # another catalog under a name read before
    bucketed.write_bucketed(rows.limit(0), path, 0)
    assert bucketed.read_bucketed(spark, path, CATALOG).isEmpty()
    rows.write.parquet(plain := str(tmp_path / "plain"))
    assert bucketed.read_bucketed(spark, plain, CATALOG).count() == rows.count()


def test_the_catalog_is_not_shuffled(spark, stored):
    rows, path = stored
    before = bucketed.read_bucketed(spark, path, CATALOG)
    table = bucketed._table(path)
    listing = rows.where("key <> 'a'").select("source", "key", "size_bytes", "last_modified", F.create_map().cast("map<string,string>").alias("user_metadata")).repartition(5)
    plans = {
        "cached_hash": lambda c: catalog.cached_hash(listing, c),
        "missing_records": lambda c: deletion.missing_records(c, listing, O.REPLICATED),
        "new_and_removed": lambda c: drift.new_and_removed(c, listing),
        "remove": lambda c: catalog.remove(c, listing),
    }
    for name, plan in plans.items():
        for between in exchanges_above(plan(before), table):
            assert "Exchange" not in between, (name, between)
        assert exchanges_above(plan(before), table), name
        assert sorted(map(str, plan(before).collect())) == sorted(map(str, plan(rows).collect())), name
