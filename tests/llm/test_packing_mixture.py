"""Mixtures of windows where the input is sorted by source, and of corpora of many sources."""

from pyspark.sql import functions as F

from ledgerloom.llm.packing import pack

WINDOW = 8192


def test_windows_hold_the_mixture_of_sorted_input(spark):
    kinds = {"hot": 2400, "mid": 1600, "rare": 800}
    rows = [(f"{s}", i) for s, n in kinds.items() for i in range(n)]
    d = spark.createDataFrame(spark.sparkContext.parallelize(rows, 24), "source string, k long")
    d = d.select(F.monotonically_increasing_id().alias("doc_id"), F.repeat(F.lit("some words of text "), (20 + F.col("k") * 7 % 31).cast("int")).alias("text"), "source")
    rows = pack(d, window_tokens=WINDOW, block_tokens=16 * WINDOW).toPandas()
    rows["window"] = (rows.sequence_id * 1024 + rows.offset) // WINDOW
    share = rows.groupby("source").length.sum() / rows.length.sum()
    per = rows.pivot_table(index="window", columns="source", values="length", aggfunc="sum", fill_value=0).iloc[:-2]
    off = abs(per.div(per.sum(axis=1), axis=0) - share).max(axis=1)
    assert len(per) > 30
    assert off.max() < 0.03


def test_every_source_has_its_target(spark):
    """Of 12,000 sources of equal size the last 2,000 by name must not be held back to the end."""
    rows = [(f"s{i:05d}", 1) for i in range(12_000)]
    d = spark.createDataFrame(rows, "source string, k long").repartition(4)
    d = d.select(F.monotonically_increasing_id().alias("doc_id"), F.lit("one two three four five six seven").alias("text"), "source")
    got = pack(d, window_tokens=1024, block_tokens=1 << 20).toPandas()
    got["small"] = got.source > "s09999"
    got["part"] = got.sequence_id * 4 // (got.sequence_id.max() + 1)
    share = got[got.small].length.sum() / got.length.sum()
    per = got[got.small].groupby("part").length.sum() / got.groupby("part").length.sum()
    assert (abs(per - share) < 0.1).all()
