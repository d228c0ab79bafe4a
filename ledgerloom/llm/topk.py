"""Exact top-k by inner product, score at a time over an impact-ordered index.

Components become integers floor(scale * x). Rows go into blocks of about ``block_rows``,
dealt by hash and written once; each block is an index. A posting is a row's component in
one dimension, its quantised impact the power of two below its magnitude; a segment holds
the postings of one dimension and one impact, so zeros have none. Segments are taken by
descending impact and add to the scores of a batch of queries. What has not been taken of
a row is a vector of known length, so a row's score is its accumulated score plus or minus
that length times the query's (Cauchy-Schwarz). A row whose upper bound is below the k-th
best lower bound, or below the k-th best exact score of earlier blocks, is out by proof. A
batch's traversal ends only when this leaves few rows, or when no segment is left; all rows
left are rescored exactly.

Queries travel to the blocks in waves of about ``wave_rows`` and of at most about
``wave_numbers`` components, one broadcast each; a task keeps k rows for each query of the wave over all its blocks, and a window the best k of all
tasks. So each row is shuffled once, and no pair of rows is ever made by Spark.

Queries and rows are told apart by a number of their own. Defined results: a vector that is
null or empty, or holds a null or non-finite component, takes no part, neither does a null
id. A query meets the rows of its own length, whatever lengths others have. Rows of equal id are queries and candidates
of their own; only the query's own row is no candidate. Equal scores go to the smaller id.
With fewer candidates than k all are returned. Components beyond 64 bits after scaling count
as the largest number of 64 bits, scores likewise; blocks too large for exact sums of floats
are scored by whole numbers without limits. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch


AT_ONCE = 64  # queries whose scores over a block are held together
I64 = np.iinfo(np.int64)


def _most(v: np.ndarray) -> int:
    return max(int(v.max(initial=0)), -int(v.min(initial=0)))


class ImpactIndex:
    """Of integer vectors (rows, dimensions), rows in the order of their ids, then numbers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, numbers: np.ndarray | None = None):
        numbers = np.arange(len(ids)) if numbers is None else numbers
        order = np.lexsort((numbers, ids))
        self.ids, self.numbers, self.v = ids[order], numbers[order], vectors[order].astype(np.int64)
        self.most, self.width = _most(self.v), self.v.shape[1]
        self.segments: list[tuple[list[tuple[int, np.ndarray, np.ndarray]], np.ndarray]] = []
        if self.most**2 * self.width >= 1 << 52:
            return  # sums of floats would not be exact
        level = np.where(self.v, np.floor(np.log2(np.maximum(np.abs(self.v), 1))).astype(np.int64), -1)
        left = (self.v.astype(np.float64) ** 2).sum(axis=1)
        for i in range(int(level.max(initial=-1)), -1, -1):
            dims, rows = np.nonzero((level == i).T)
            values = self.v[rows, dims].astype(np.float64)
            left = left - np.bincount(rows, values * values, minlength=len(ids))
            cut = np.searchsorted(dims, np.arange(self.width + 1))
            postings = [(d, rows[cut[d] : cut[d + 1]], values[cut[d] : cut[d + 1]]) for d in range(self.width) if cut[d] < cut[d + 1]]
            self.segments.append((postings, np.sqrt(np.maximum(left, 0))))

    def _exact(self, rows: np.ndarray, query: np.ndarray) -> np.ndarray:
        if self.most * _most(query) * self.width <= I64.max:
            return self.v[rows] @ query
        whole = self.v[rows].astype(object) @ query.astype(object)
        return np.array([min(max(x, I64.min), I64.max) for x in whole], np.int64)

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, bar: np.ndarray | None = None, few: int = 64) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (row indexes, scores) of the k best except the row of the number ``own``; of rows
        that don't reach the query's ``bar`` none is needed."""
        n, b = len(self.ids), len(queries)
        bar = np.full(b, -np.inf) if bar is None else bar
        possible = self.numbers[:, None] != own[None, :]
        summed = self.segments and self.most * _most(queries) * self.width < 1 << 52
        # Sums of 32-bit floats are exact below 2**24.
        kind = np.float32 if self.most * _most(queries) * self.width < 1 << 24 else np.float64
        acc = np.zeros((n, b), kind)
        size = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        lowest = np.where(possible, acc.dtype.type(0), acc.dtype.type(-np.inf))
        for depth, (postings, left) in enumerate(self.segments if summed else ()):
            for d, rows, values in postings:
                acc[rows] += values.astype(kind)[:, None] * queries[:, d].astype(kind)[None, :]
            if depth < 2 and left.any():
                continue  # what is left still outweighs any score
            reach = (np.outer(left, size) * (1 + 1e-6) + 1e-3).astype(kind)
            if n > k:
                bar = np.maximum(bar, np.partition(acc - reach + lowest, n - k, axis=0)[n - k])
            possible &= acc + reach >= bar[None, :]
            if possible.sum() <= max(few, k) * b:
                break
        out = []
        for j in range(b):
            rows = np.flatnonzero(possible[:, j])
            score = self._exact(rows, queries[j])
            best = np.lexsort((rows, -score.astype(object) if len(score) and score.min() == I64.min else -score))[:k]
            out.append((rows[best], score[best]))
        return out


def quantised(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def top_k(
    vectors: DataFrame,
    query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 5,
    scale: int = 256,
    block_rows: int = 16_384,
    wave_rows: int = 65_536,
    wave_numbers: int = 1 << 24,
) -> DataFrame:
    """query_id, rank (from 1), the id column and score (long) for every row where ``query`` holds."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    sound = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(query, F.lit(False)).alias("q"))
    rows = scratch.table(rows.withColumn("r", F.monotonically_increasing_id()), "vectors")
    total, asked, numbers = rows.agg(F.count("*"), F.count_if("q"), F.sum(F.when(F.col("q"), F.size("v")))).first()
    n_blocks, waves = max(1, -(-total // block_rows)), max(1, -(-asked // wave_rows), -(-(numbers or 0) // wave_numbers))

    def by_length(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, matrix) of each length of vectors."""
        size = pc.list_value_length(column).to_numpy(zero_copy_only=False)
        for d in np.unique(size).tolist():
            at = np.flatnonzero(size == d)
            yield d, at, column.take(pa.array(at)).flatten().to_numpy().reshape(len(at), d)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[tuple[int, int], list[tuple[np.ndarray, ...]]] = {}
        for batch in batches:
            b, ids, numbers = (batch.column(c).to_numpy() for c in range(3))
            for d, at, v in by_length(batch.column(3)):
                for x in np.unique(b[at]).tolist():
                    some = b[at] == x
                    blocks.setdefault((x, d), []).append((ids[at][some], numbers[at][some], v[some]))
        for parts in blocks.values():
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(p).astype("<i8").tobytes()], pa.binary()) for p in zip(*parts, strict=True)], names=["ids", "numbers", "v"])

    # Blocks are dealt by hash, so their sizes agree whatever the ids are.
    dealt = rows.select(F.pmod(F.xxhash64("r"), F.lit(n_blocks)).alias("b"), "id", "r", "v").repartition(n_blocks, "b")
    data = scratch.table(dealt.mapInArrow(pack, "ids binary, numbers binary, v binary"), "blocks")
    ask = rows.where("q").select("id", "r", "v", F.pmod(F.xxhash64("r", F.lit(1)), F.lit(waves)).alias("w"))
    found = None
    for wave in range(waves):
        held = ask.where(F.col("w") == wave).select("id", "r", "v").toArrow().combine_chunks()  # bounded by the wave
        column = held.column("v").combine_chunks() if held.num_rows else pa.array([], pa.list_(pa.int64()))
        ids, numbers = (held.column(c).to_numpy() for c in ("id", "r"))
        sent = spark.sparkContext.broadcast((ids, numbers, {d: (at, v) for d, at, v in by_length(column)}))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            q_ids, q_numbers, of_length = sent.value
            best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids)  # scores, ids, numbers
            for batch in batches:
                for r in range(batch.num_rows):
                    ids, numbers, v = (np.frombuffer(batch.column(c)[r].as_py(), "<i8") for c in range(3))
                    own, q = of_length.get(len(v) // len(ids), (np.zeros(0, np.int64), None))
                    if not len(own):
                        continue
                    index = ImpactIndex(ids, v.reshape(len(ids), -1), numbers)
                    for lo in range(0, len(own), AT_ONCE):
                        some = own[lo : lo + AT_ONCE].tolist()
                        bar = np.array([float(best[j][0][-1]) if len(best[j][0]) == k else -np.inf for j in some])
                        for j, (at, score) in zip(some, index.top(q[lo : lo + AT_ONCE], q_numbers[some], k, bar), strict=True):
                            s, i, x = (np.concatenate(c) for c in zip(best[j], (score, index.ids[at], index.numbers[at]), strict=True))
                            order = sorted(range(len(s)), key=lambda y: (-int(s[y]), i[y], x[y]))[:k]
                            best[j] = s[order], i[order], x[order]
            sizes = [len(s) for s, _, _ in best]
            cols = [np.repeat(q_numbers, sizes), np.repeat(q_ids, sizes), *(np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*best, strict=True))] if len(q_ids) else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], names=["query", "query_id", "score", "id", "r"])

        part = data.mapInArrow(search, "query long, query_id long, score long, id long, r long")
        part = scratch.table(part, "found") if waves > 1 else part
        found = found.union(part) if found is not None else part
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id", "r"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
