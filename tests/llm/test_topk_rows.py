"""Repeated rows, large components and clashing names in the exact top-k search."""

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm.topk import top_k


def brute(rows, k):
    good = [(n, i, [int(np.floor(256.0 * float(x))) for x in v]) for n, (i, v) in enumerate(rows)]
    out = []
    for n, i, v in good:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for m, j, w in good if m != n and len(v) == len(w))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j, _) in enumerate(best)]
    return sorted(out)


def found(spark, rows, **more):
    table = spark.createDataFrame([(i, v, "x", 1, 2.0, 3) for i, v in rows], "vec_id long, embedding array<double>, query_id string, rank int, score double, r int").repartition(3)
    return sorted(map(tuple, top_k(table, F.col("vec_id") % 20 == 0, **more).collect()))


def test_repeated_query_rows_keep_their_own_places(spark):
    r = np.random.default_rng(9)
    rows = [(int(i), [float(x) for x in r.normal(size=6)]) for i in range(60)]
    rows += [rows[40], rows[40], (20, [float(x) for x in r.normal(size=6)])]
    for more in ({}, {"block_rows": 7, "wave_rows": 1}):
        assert found(spark, rows, **more) == brute(rows, 5)


def test_large_components(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=4) * 10.0 ** r.integers(0, 7)]) for i in range(40)]
    assert found(spark, rows, block_rows=9) == brute(rows, 5)
    rows = [(i, [float(x) * 1e6 for x in r.integers(-9, 9, 4)]) for i in range(40)]
    assert found(spark, rows) == brute(rows, 5)
    huge = [(0, [1e30, 1.0]), (1, [1e8, -1.0]), (2, [-1e30, 1.0]), (3, [0.5, 0.5])]
    got = found(spark, huge)
    most = 2**63 - 1
    assert [(x[1], x[2]) for x in got] == [(1, 1), (2, 3), (3, 2)] and got[0][3] == most and got[2][3] == -most - 1


def test_queries_meet_the_rows_of_their_own_length(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=[1, 2, 2, 5][i % 4] if i % 20 else i % 3 + 1)]) for i in range(200)]
    for more in ({}, {"block_rows": 30, "wave_numbers": 5}):
        assert found(spark, rows, **more) == brute(rows, 5)
    few = [(0, [1.0, 2.0]), (1, [1.0]), (2, [3.0, 1.0]), (3, [2.0]), (20, [5.0])]  # the query's length isn't the most common one
    assert found(spark, few) == brute(few, 5) and {x[0] for x in found(spark, few)} == {0, 20}
    more = [("extra", [1.0])]
    table = spark.createDataFrame([(20, [1.0], *more), (21, None, *more), (22, [], *more), (None, [1.0], *more), (23, [2.0], *more)], "vec_id long, embedding array<double>, QUERY_ID struct<a: string, b: array<double>>")
    assert [tuple(x) for x in top_k(table, F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 23, 512 * 256)]
