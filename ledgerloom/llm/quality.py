"""Quality by hierarchical empirical Bayes: a document's own evidence within its host's and path's posteriors.

A naive Bayes classifier over a text's form (shares of character classes, lengths of words
and lines, repetition; quantised) gives each document a log-likelihood ratio; it is fitted
on ``max_examples`` labelled rows at most, by hash of the id. Its bins are counts of rows.

The prior comes from where the document lies. Each document's probability under the global
prior is a fractional observation of its host and of its path (host and language here).
Grouped sums give their shares. A host's posterior is a Beta with mean shrunk to the global
share, a path's to its host's; the strength of either shrinkage is the method-of-moments
estimate over the groups of that level, from sums alone. A sparse site stays at its parent.
The final score combines the path's posterior mean, without the document's own share, and
the document's ratio by Bayes' rule.

Sums over hosts and paths combine before they move; a host with a third of all rows is a
row per task. Documents meet their path's two sums in a join on the path, which is
broadcast below Spark's threshold and split by adaptive execution when skewed.

Defined results: null or empty text has the form of an empty text; null hosts and paths are
sites of their own; rows of equal or null id are judged one by one, and each observes its
site once. Labels count once per id (the smallest); labels other than 0 and 1
and held-out ids (crc32 of the id divisible by five) are not learnt from. With one class only all ratios are zero and the
score is the prior. Input columns are kept, those named like the operator's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import plain_names
from .scratch import Scratch
from .text import NOT_SPACE, text_slices, words
from .toxicity import held_out

BINS = 16
FORMS = ("letters", "digits", "blanks", "marks", "pipes", "upper", "other", "word_length", "words", "line_length", "distinct", "end_marks")
_CLASS = np.zeros(256, np.uint8)  # 0: any other mark
_CLASS[[*range(97, 123), *range(65, 91)]] = 1
_CLASS[48:58] = 2
_CLASS[[32, 9, 10, 11, 12, 13]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[ord("|")] = 5
_CLASS[128:] = 6


def forms(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bin numbers (text, form)."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    kind = _CLASS[raw]

    def count(which: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(which, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    share = {k: count(kind == k) / size for k in range(7)}
    w = words(raw, offsets, NOT_SPACE)
    n_words = np.diff(w.first).astype(float)
    lines = count(raw == 10) + 1.0
    upper = count((raw >= 65) & (raw <= 90)) / np.maximum(n_words, 1)
    distinct = np.array([len(np.unique(w.hash[a:b])) for a, b in zip(w.first[:-1], w.first[1:], strict=True)], float) / np.maximum(n_words, 1)
    # Words that end in a mark other than a full stop's kind.
    last = kind[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    odd = np.concatenate([[0], np.cumsum(last == 0, dtype=np.int64)])
    odd = (odd[w.first[1:]] - odd[w.first[:-1]]) / np.maximum(n_words, 1)
    log = lambda x: np.log2(1 + x)
    unit = [share[1], share[2] * 4, share[3] * 2, share[0] * 4, share[5] * 4, upper, share[6] * 2, log(size / np.maximum(n_words, 1)) / 6, log(n_words) / 16, log(n_words / lines) / 12, distinct, odd]
    return np.minimum((np.stack(unit, axis=1).reshape(n, len(FORMS)) * BINS).astype(np.int64), BINS - 1).clip(0)


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_examples: int = 20_000) -> tuple[np.ndarray, float]:
    """(log-likelihood ratio of each form's bin, share of label 1)."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("i")).agg(F.min(label_col).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("i"), "i").limit(max_examples)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(sample), "i").select("t", "y")  # max_examples rows of two numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((2, len(FORMS), BINS), np.int64)
        seen = np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, raw, off in text_slices(batch.column(0)):
                np.add.at(table, (y[lo:hi, None], np.arange(len(FORMS)), forms(raw, off)), 1)
            seen += np.bincount(y, minlength=2)
        at = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(x, [0, 1])) for x in (at[0],)] + [pa.array(np.append(x, [-1, -1])) for x in at[1:]] + [pa.array(np.append(table[at], seen))], names=["y", "f", "b", "n"])

    table, seen = np.zeros((2, len(FORMS), BINS)), np.zeros(2)
    for r in rows.mapInArrow(count, "y long, f long, b long, n long").groupBy("y", "f", "b").agg(F.sum("n").alias("n")).collect():  # a row for each bin
        if r.f < 0:
            seen[r.y] = r.n
        else:
            table[r.y, r.f, r.b] = r.n
    base = float(seen[1] / seen.sum()) if seen.sum() else 0.5
    if not seen.all():
        return np.zeros((len(FORMS), BINS)), base
    p = (table + 0.5) / (table.sum(axis=2, keepdims=True) + 0.5 * BINS)
    return np.log(p[1] / p[0]), base


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """How many observations a parent's mean is worth: 1 / rho - 1, rho the share of variance between groups."""
    m = groups.where("n > 1").agg(
        F.sum("n").alias("n"), F.count("*").alias("g"), F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2).alias("between"),
        F.sum(mean * (1 - mean) * F.col("n")).alias("all"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).first()
    if not m.g or m.g < 2 or not m["all"]:
        return 1000.0
    variance = m["all"] / m.n
    room = m.n - m.nn / m.n
    rho = (m.between - (m.g - 1) * variance) / (room * variance) if room > 0 else 0.0
    return 1 / min(max(rho, 1e-3), 0.5) - 1


@plain_names("evidence", "host_posterior", "path_posterior", "score", "keep", columns=("host", "path"))
def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], *, host: Column, path: Column, text_col: str = "text", damp: float = 0.5) -> DataFrame:
    """``docs`` without its text, with evidence (log ratio), host_posterior, path_posterior, score (0 to 1) and keep.

    ``damp`` weighs the evidence, for forms are not independent.
    """
    spark = docs.sparkSession
    weights, base = model
    sent = spark.sparkContext.broadcast(weights)  # forms x bins
    own = ("evidence", "host_posterior", "path_posterior", "score", "keep")
    kept = [f for f in docs.schema if f.name not in own and f.name != text_col]
    site = docs.select(*(f.name for f in kept), host.cast("string").alias("__q_host"), path.cast("string").alias("__q_path"), text_col)
    schema = T.StructType([*kept, T.StructField("__q_host", T.StringType()), T.StructField("__q_path", T.StringType()), T.StructField("evidence", T.DoubleType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in text_slices(batch.column(batch.num_columns - 1)):
                ratio = damp * sent.value[np.arange(len(FORMS)), forms(raw, off)].sum(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], pa.array(ratio)], names=[f.name for f in schema])

    prior = float(np.log((base + 1e-6) / (1 - base + 1e-6)))
    judged = Scratch(spark, "quality").table(site.mapInArrow(judge, schema).withColumn("__q_p", 1 / (1 + F.exp(-(F.col("evidence") + prior)))), "evidence")
    paths = judged.groupBy("__q_host", "__q_path").agg(F.sum("__q_p").alias("s"), F.count("*").alias("n"))
    hosts = paths.groupBy("__q_host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    share = F.lit(total.s / total.n if total.n else base)
    a = _strength(hosts, share)
    hosts = hosts.select(F.col("__q_host").alias("__q_h"), ((F.col("s") + a * share) / (F.col("n") + a)).alias("host_posterior"))
    paths = paths.join(hosts, F.col("__q_host").eqNullSafe(F.col("__q_h"))).drop("__q_h")
    b = _strength(paths, F.col("host_posterior"))
    paths = paths.select(F.col("__q_host").alias("__q_h"), F.col("__q_path").alias("__q_t"), F.col("s").alias("__q_s"), F.col("n").alias("__q_n"), "host_posterior", ((F.col("s") + b * F.col("host_posterior")) / (F.col("n") + b)).alias("path_posterior"))
    out = judged.join(paths, F.col("__q_host").eqNullSafe(F.col("__q_h")) & F.col("__q_path").eqNullSafe(F.col("__q_t")))
    without = (F.col("__q_s") - F.col("__q_p") + b * F.col("host_posterior")) / (F.col("__q_n") - 1 + b)  # the site without the document
    without = F.least(F.greatest(without, F.lit(1e-6)), F.lit(1 - 1e-6))
    score = 1 / (1 + F.exp(-(F.col("evidence") + _logit(without))))
    return out.select(*(f.name for f in kept), "evidence", "host_posterior", "path_posterior", score.alias("score"), (score >= 0.5).alias("keep"))
