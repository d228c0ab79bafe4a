"""Running sums inside groups of any size, and rows dealt out by weight.

A window sorts each group in one task, so a group with a third of all rows would be slow.
Here such a group falls into ranges of its order. The bounds come from a sample drawn by a
hash, hence the same one in every run: about ``SAMPLED`` rows for each range. Sums of ranges, which
combine before they are shuffled, give each range the sum of those before it, and a window
over group and range does the rest. Ranges number ``RANGES`` and few more in all, so bounds
and offsets are small by construction and are broadcast. A table of ``LEAST`` rows or fewer
has no ranges, and its plan is the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LEAST, RANGES, SAMPLED = 100_000, 500, 64
_ME, _PART, _BOUNDS, _SUM, _BEFORE = (f"__run_{x}" for x in ("me", "part", "bounds", "sum", "before"))


def ranges(rows: DataFrame, group: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """``rows`` with the number of their range inside their group; ``n``: how many rows there are, or more."""
    size = max(LEAST, math.ceil(n / RANGES))
    one_in = max(1, size // SAMPLED)
    step = max(1, size // one_in)
    me = F.struct(*order)
    drawn = rows.where(F.pmod(F.xxhash64(*group, *order), F.lit(one_in)) == 0).groupBy(*group).agg(F.sort_array(F.collect_list(me)).alias(_BOUNDS))
    bounds = drawn.where(F.size(_BOUNDS) > step).withColumn(_BOUNDS, F.filter(_BOUNDS, lambda _, i: (i + 1) % step == 0))
    same = [f"__run_g{i}" for i in range(len(group))]
    on = [F.col(g).eqNullSafe(F.col(s)) for g, s in zip(group, same, strict=True)]
    rows = rows.withColumn(_ME, me).join(F.broadcast(bounds.select(*(F.col(g).alias(s) for g, s in zip(group, same, strict=True)), _BOUNDS)), on, "left").drop(*same)
    return rows.withColumn(_PART, F.when(F.col(_BOUNDS).isNull(), 0).otherwise(F.size(F.filter(_BOUNDS, lambda b: b < F.col(_ME))))).drop(_ME)


def running_before(rows: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, out: str, n: int) -> DataFrame:
    """``rows`` with ``out`` (long): the sum of ``value`` over the rows before in the group, by ``order`` (columns, ascending, that tell all rows of a group apart)."""
    rows = rows.withColumn(_SUM, value.cast("long"))
    before = lambda w: F.coalesce(F.sum(_SUM).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if n <= LEAST:
        return rows.withColumn(out, before(W.partitionBy(*group).orderBy(*order))).drop(_SUM)
    rows = ranges(rows, group, order, n)
    sums = rows.where(F.col(_BOUNDS).isNotNull()).groupBy(*group, _PART).agg(F.sum(_SUM).alias(_SUM))
    sums = sums.withColumn(_BEFORE, before(W.partitionBy(*group).orderBy(_PART))).drop(_SUM)
    same = [f"__run_g{i}" for i in range(len(group))]
    on = [F.col(g).eqNullSafe(F.col(s)) for g, s in zip(group, same, strict=True)]
    sums = sums.select(*(F.col(g).alias(s) for g, s in zip(group, same, strict=True)), F.col(_PART).alias("__run_p"), _BEFORE)
    rows = rows.withColumn(out, before(W.partitionBy(*group, _PART).orderBy(*order))).drop(_SUM, _BOUNDS)
    rows = rows.join(F.broadcast(sums), [*on, F.col(_PART) == F.col("__run_p")], "left")
    return rows.withColumn(out, F.col(out) + F.coalesce(_BEFORE, F.lit(0))).drop(*same, "__run_p", _PART, _BEFORE)


def numbered(rows: DataFrame, order: Sequence[str], out: str, n: int) -> DataFrame:
    """``rows`` with ``out`` (long): their place, from 1, in one order of the whole table, without sorting it in one task. ``n``: as above."""
    rows = running_before(rows.withColumn("__run_all", F.lit(0)), ["__run_all"], order, F.lit(1), out, n)
    return rows.withColumn(out, F.col(out) + 1).drop("__run_all")


def dealt_by_weight(rows: DataFrame, weight: Column, key: Sequence[str], tasks: int) -> DataFrame:
    """``rows`` in partitions of about equal weight: what weighs as much as a task's share goes alone, the others by running sums.

    At most ``2 * tasks`` partitions; one holds no more than the mean of the light rows and one row
    more. ``key`` tells rows apart. The table is read three times: hand over a written one.
    """
    w = F.greatest(F.coalesce(weight, F.lit(0)).cast("double"), F.lit(0.0))
    rows = rows.withColumn(_SUM, w)
    total = rows.agg(F.sum(_SUM)).first()[0] or 0.0
    heavy = F.col(_SUM) * tasks >= total if total else F.lit(False)  # of these there are ``tasks`` at most
    light = rows.where(~heavy)
    buckets = 16 * tasks
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets))
    light = light.withColumn("__run_b", bucket)
    sums = light.groupBy("__run_b").agg(F.sum(_SUM).alias("__run_s"))  # one row a bucket
    sums = sums.select("__run_b", (F.sum("__run_s").over(W.orderBy("__run_b")) - F.col("__run_s")).alias(_BEFORE), F.sum("__run_s").over(W.partitionBy()).alias("__run_all"))
    inside = F.coalesce(F.sum(_SUM).over(W.partitionBy("__run_b").orderBy(*key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    light = light.withColumn(_ME, inside).join(F.broadcast(sums), "__run_b")
    share = F.when(F.col("__run_all") > 0, F.floor((F.col(_BEFORE) + F.col(_ME)) / F.col("__run_all") * tasks)).otherwise(0)
    light = light.withColumn(_PART, F.least(share, F.lit(tasks - 1)).cast("int")).drop("__run_b", _BEFORE, "__run_all", _ME)
    alone = rows.where(heavy).withColumn(_PART, (F.lit(tasks - 1) + F.row_number().over(W.orderBy(*key))).cast("int"))
    both = light.unionByName(alone) if total else light
    return both.drop(_SUM).repartitionById(2 * tasks, _PART).drop(_PART)
