"""A catalog that follows a stream equals the batch upsert, whatever fails on the way."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import catalog as C

START = datetime.datetime(2024, 1, 1)


def listings(seed, n=400):
    r = random.Random(seed)
    rows = [(r.choice("ab"), f"k{r.randrange(60)}", START + datetime.timedelta(minutes=r.randrange(600), microseconds=r.randrange(3)), r.choice(["x", "y", None]), r.choice([1, 2, None])) for _ in range(n)]
    return rows + rows[:40] + [(None, "k", START, "x", 1), ("a", None, START, "x", 1), ("a", "k", None, "x", 1)]


def last(rows):
    out = {}
    for s, k, t, h, n in rows:
        if s is not None and k is not None and t is not None:
            at = (t, h or "", -1 if n is None else n)
            if (s, k) not in out or at > out[s, k][0]:
                out[s, k] = (at, (s, k, t, h, n))
    return sorted(map(str, (x for _, x in out.values())))


def told(df):
    return sorted(str(tuple(r)) for r in df.collect())


def arrive(spark, folder, rows, files=2):
    spark.createDataFrame(rows, C.SEEN).repartition(files).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(C.SEEN).option("maxFilesPerTrigger", 1).parquet(folder)


def test_restarts_lose_and_repeat_nothing(spark, tmp_path, monkeypatch):
    new, folder = str(tmp_path / "new"), str(tmp_path / "catalog")
    rows = listings(1)
    os.makedirs(new)
    for i in range(3):
        arrive(spark, new, rows[i::3])
        if i == 1:  # the batch's changes are written, and then the query fails
            real = C.changes

            def failing(listings, late):
                return real(listings, late).where(F.when(F.col("key") >= "k", F.raise_error(F.lit("the query fails")).cast("boolean")).otherwise(True))

            with monkeypatch.context() as m:
                m.setattr(C, "changes", failing)
                with pytest.raises(Exception, match="the query fails"):
                    C.follow(stream(spark, new), folder).awaitTermination()
        C.follow(stream(spark, new), folder).awaitTermination()
        assert told(C.current(spark, folder)) == last([x for j in range(i + 1) for x in rows[j::3]])
        if i == 1:
            C.compact(spark, folder)
            assert not C._numbers(spark, folder) and told(C.current(spark, folder)) == last(rows[0::3] + rows[1::3])
    C.follow(stream(spark, new), folder).awaitTermination()  # nothing new
    changed = spark.read.schema(C.SEEN).parquet(f"{folder}/changes/*")
    assert told(C.current(spark, folder)) == last(rows) and changed.groupBy("source", "key").agg(F.count("*").alias("n"), F.count_distinct("seen_at", F.coalesce("content_hash", F.lit("")), F.coalesce("size_bytes", F.lit(-1))).alias("d")).where("n > d").isEmpty()


def test_a_batch_done_again_replaces_its_changes(spark, tmp_path):
    new, folder = str(tmp_path / "new"), str(tmp_path / "catalog")
    arrive(spark, new, listings(2), 1)
    C.follow(stream(spark, new), folder).awaitTermination()
    before = told(C.current(spark, folder))
    number = max(os.listdir(f"{folder}/checkpoint/commits"), key=lambda n: int(n) if n.isdigit() else -1)
    for f in (number, f".{number}.crc"):
        os.remove(f"{folder}/checkpoint/commits/{f}")  # as if the driver had gone before the commit
    C.follow(stream(spark, new), folder).awaitTermination()
    assert told(C.current(spark, folder)) == before and len({n for n in os.listdir(f"{folder}/changes")}) == len(C._numbers(spark, folder))


def test_late_rows_are_dropped_and_state_goes(spark, tmp_path):
    new, folder = str(tmp_path / "new"), str(tmp_path / "catalog")
    day = datetime.timedelta(days=1)
    arrive(spark, new, [("a", "old", START, "x", 1)], 1)
    C.follow(stream(spark, new), folder, "1 day").awaitTermination()
    arrive(spark, new, [("a", "new", START + 5 * day, "x", 1)], 1)
    C.follow(stream(spark, new), folder, "1 day").awaitTermination()
    arrive(spark, new, [("a", "late", START + day, "x", 1), ("a", "old", START - day, "z", 9), ("a", "intime", START + 5 * day, "x", 1)], 1)
    q = C.follow(stream(spark, new), folder, "1 day")
    q.awaitTermination()
    assert sorted(r.key for r in C.current(spark, folder).collect()) == ["intime", "new", "old"]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 2  # what the watermark has passed is gone


def test_a_compaction_cut_short(spark, tmp_path):
    new, folder = str(tmp_path / "new"), str(tmp_path / "catalog")
    arrive(spark, new, listings(3), 1)
    C.follow(stream(spark, new), folder).awaitTermination()
    want = told(C.current(spark, folder))
    C.current(spark, folder).write.parquet(f"{folder}/base.new")  # whole, but not yet in place
    assert told(C.current(spark, folder)) == want and os.path.isdir(f"{folder}/base")
    C.current(spark, folder).write.parquet(f"{folder}/base.new")
    os.rename(f"{folder}/base", f"{folder}/gone")
    os.remove(f"{folder}/base.new/_SUCCESS")
    assert told(C.current(spark, folder)) == want  # from the changes, which are still there
    C.compact(spark, folder)
    assert told(C.current(spark, folder)) == want


def test_nothing_yet(spark, tmp_path):
    assert C.current(spark, str(tmp_path / "none")).isEmpty()
