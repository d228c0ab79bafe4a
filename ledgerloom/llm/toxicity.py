"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The examples are labelled documents, ``max_examples`` at most (the bound of the fit; those
with the smallest hash of their id), one for each distinct text. Words and
word beginnings whose presence goes with the label among the examples (G-test, with a
least share of either class) are the terms; their document frequencies come from all documents. A document is the vector of
its terms, (1 + ln tf) * idf, of unit length.

The index keeps postings by term and block of examples, and each term's largest weight in
each block. A query sums these into a bound for each block, scores blocks by descending
bound, and stops at the first bound below the k-th best cosine, which proves the rest
away. The neighbours vote with weight 1 / (1 - cosine + ``soft``). A step function fitted
on leave-one-out votes of the examples (isotonic, by pooling adjacent violators, each pool
shrunk to the base rate) turns the vote into a probability. Documents without any term
get the share of the label among examples without any.

The model is bounded by ``max_examples``; documents are scored by their
own row, without a shuffle. The score depends on the text alone.

Defined results: a null or empty text has no term. Repeated label rows of an id count as
the largest label; labels other than 0 and 1, or whose id is null or not in the documents, are
left out. Without labels of both classes all scores are the base rate (0 without any).
Input columns are kept, those named like the operator's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import plain_names
from .scratch import Scratch
from .text import ALNUM, U64, Vocabulary, text_slices, words

EVIDENCE = T.ArrayType(T.StructType([T.StructField("example", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("label", T.IntegerType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learnt from. Null ids: true."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


#: Words longer than these many bytes also count by their beginnings, so inflected forms meet.
PREFIXES = (5, 6, 7, 8)


def features(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, hash) of words, then of the beginnings of longer words."""
    w = words(raw, offsets, ALNUM, prefixes=PREFIXES)
    yield w.doc, w.hash
    for at, h in w.prefix.values():
        yield w.doc[at], h


def term_counts(raw: np.ndarray, offsets: np.ndarray, terms: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, count) of known features, by text and term."""
    keys = [np.zeros(0, np.int64)]
    for doc, h in features(raw, offsets):
        at, term = terms.number(h)
        keys.append(doc[at] * max(1, len(terms)) + term)
    key, n = np.unique(np.concatenate(keys), return_counts=True)
    return key // max(1, len(terms)), key % max(1, len(terms)), n


class BlockMaxIndex:
    """Unit vectors of examples; ``top`` returns the k best by cosine, ties to the smaller number."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = 64):
        self.n, self.block, self.blocks = len(rows), block, -(-len(rows) // block)
        example = np.repeat(np.arange(self.n), [len(t) for t, _ in rows])
        term = np.concatenate([*(t for t, _ in rows), np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([*(w for _, w in rows), np.zeros(0)])
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        self.first = np.searchsorted(term[order] * max(1, self.blocks) + self.example // block, np.arange(terms * max(1, self.blocks) + 1))
        self.most = np.zeros((terms, max(1, self.blocks)))
        np.maximum.at(self.most, (term, example // block), weight)

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        bound = weights @ self.most[terms]
        blocks = np.argsort(-bound, kind="stable")
        best_s, best_e, at, some = np.zeros(0), np.zeros(0, np.int64), 0, 4
        while at < len(blocks):  # by descending bound, so all of ``b`` up to the first that can't hold a better one
            b = blocks[at : at + some]
            b = b[(bound[b] > 0) & (bound[b] >= (best_s[-1] - 1e-12 if len(best_s) == k else 0))]
            if not len(b):
                break
            at, some = at + some, some * 2
            i = (terms[:, None] * self.blocks + b).ravel()
            n = self.first[i + 1] - self.first[i]
            s = np.repeat(self.first[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            acc = np.bincount(self.example[s], np.repeat(np.repeat(weights, len(b)), n) * self.weight[s], self.n)
            e = np.flatnonzero(acc > 0)
            if skip >= 0:
                e = e[e != skip]
            s, e = np.concatenate([best_s, acc[e]]), np.concatenate([best_e, e])
            order = np.lexsort((e, -np.round(s, 12)))[:k]
            best_s, best_e = s[order], e[order]
        return best_s, best_e


def isotonic(x: np.ndarray, y: np.ndarray, base: float, strength: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Upper ends and values of a rising step function, by pooling adjacent violators."""
    pools: list[list[float]] = []  # end, sum, count
    for v in np.unique(x):
        hit = y[x == v]
        pools.append([float(v), float(hit.sum()), float(len(hit))])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            end, s, n = pools.pop()
            pools[-1] = [end, pools[-1][1] + s, pools[-1][2] + n]
    ends = np.array([p[0] for p in pools])
    return ends, np.array([(p[1] + strength * base) / (p[2] + strength) for p in pools])


@dataclass
class ToxicityModel:
    terms: Vocabulary
    idf: np.ndarray
    index: BlockMaxIndex
    example_ids: np.ndarray
    labels: np.ndarray
    ends: np.ndarray
    values: np.ndarray
    empty: float
    k: int
    soft: float

    def vector(self, term: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(count)) * self.idf[term]
        return term, w / np.sqrt((w * w).sum())

    def vote(self, similar: np.ndarray, example: np.ndarray) -> float:
        w = 1 / (1 - np.minimum(similar, 1) + self.soft)
        return float((w * self.labels[example]).sum() / w.sum())

    def calibrated(self, vote: float) -> float:
        return float(self.values[min(np.searchsorted(self.ends, vote - 1e-9), len(self.values) - 1)])

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[list[dict]]]:
        n = len(offsets) - 1
        score, evidence = np.full(n, self.empty), [[] for _ in range(n)]
        if not self.index.n:
            return score, evidence
        text, term, count = term_counts(raw, offsets, self.terms)
        cut = np.flatnonzero(np.diff(text, prepend=-1))
        for a, b in zip(cut, np.append(cut, len(text))[1:], strict=True):
            s, e = self.index.top(*self.vector(term[a:b], count[a:b]), self.k)
            if len(s):
                score[text[a]] = self.calibrated(self.vote(s, e))
                evidence[text[a]] = [{"example": int(self.example_ids[j]), "similarity": float(min(x, 1.0)), "label": int(self.labels[j])} for x, j in zip(s, e, strict=True)]
        return score, evidence


def _each_text(text_col: str, names: list[str], kinds: list[pa.DataType], f):
    """A mapInArrow function: f(batch slice, bytes, offsets) gives the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in text_slices(batch.column(batch.schema.get_field_index(text_col)), 1 << 19):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(f(batch.slice(lo, hi - lo), raw, off), kinds, strict=True)], names=names)

    return run


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_examples: int = 10_000,
    least_g: float = 20.0,
    k: int = 12,
    soft: float = 0.05,
) -> ToxicityModel:
    """Learns from labelled rows that are not held out. Only bounded tables reach the driver."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).alias("i")).agg(F.max(label_col).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("i"), "i").limit(max_examples)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).join(F.broadcast(sample), "i")  # max_examples rows of two numbers
    texts = texts.groupBy("t").agg(F.min("i").alias("i"), F.max("y").alias("y"))
    texts = Scratch(docs.sparkSession, "toxicity").table(texts, "examples")

    def seen(part: pa.RecordBatch, raw: np.ndarray, off: np.ndarray):
        y = part.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        doc, h = (np.concatenate(x) for x in zip(*features(raw, off), strict=True))
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        return h[new].astype(np.int64), y[doc[new]]

    present = texts.select("t", "y").mapInArrow(_each_text("t", ["h", "y"], [pa.int64(), pa.int64()], seen), "h long, y long")
    total = texts.agg(F.count("*").alias("n"), F.sum("y").alias("p")).first()
    n, p = int(total.n), int(total.p or 0)
    base = p / n if n else 0.0
    a, m = F.col("a").cast("double"), F.col("m").cast("double")

    def part(x: Column, expected: Column) -> Column:
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)

    if p in (0, n):
        return ToxicityModel(Vocabulary(np.zeros(0, U64)), np.zeros(0), BlockMaxIndex([], 0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0), np.zeros(0), base, k, soft)
    q = n - p
    g = 2 * (part(a, m * p / n) + part(m - a, m * q / n) + part(p - a, (n - m) * p / n) + part(q - m + a, (n - m) * q / n))
    chosen = (
        present.groupBy("h").agg(F.sum("y").alias("a"), F.count("*").alias("m"))
        .where((a * n > m * p) & (g >= least_g)).select("h").collect()  # no more than words of the examples
    )
    terms = Vocabulary(np.array([r.h for r in chosen], np.int64).astype(U64))

    def frequency(part: pa.RecordBatch, raw: np.ndarray, off: np.ndarray):
        f = np.bincount(term_counts(raw, off, terms)[1], minlength=len(terms))
        return np.arange(len(f)), f, np.full(len(f), part.num_rows if len(f) else 0)

    counted = docs.select(F.col(text_col).alias("t")).mapInArrow(_each_text("t", ["k", "f", "n"], [pa.int64()] * 3, frequency), "k long, f long, n long")
    df = {r.k: (r.f, r.n) for r in counted.groupBy("k").agg(F.sum("f").alias("f"), F.sum("n").alias("n")).collect()}
    idf = np.array([np.log((1 + df[j][1]) / (1 + df[j][0])) + 1 for j in range(len(terms))])

    def vectors(part: pa.RecordBatch, raw: np.ndarray, off: np.ndarray):
        text, term, count = term_counts(raw, off, terms)
        cut = np.searchsorted(text, np.arange(part.num_rows + 1))
        each = [slice(x, y) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        return part.column(1), part.column(2), [term[s] for s in each], [count[s] for s in each]

    schema = "i long, y int, term array<long>, n array<long>"
    rows = texts.select("t", F.col("i").cast("long").alias("i"), "y").mapInArrow(_each_text("t", ["i", "y", "term", "n"], [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())], vectors), schema).collect()
    rows.sort(key=lambda r: r.i)
    model = ToxicityModel(terms, idf, None, None, None, None, None, base, k, soft)
    full, bare = [r for r in rows if r.term], [r.y for r in rows if not r.term]
    made = [model.vector(np.array(r.term), np.array(r.n)) for r in full]
    model.index, model.example_ids = BlockMaxIndex(made, len(terms)), np.array([r.i for r in full])
    model.labels = np.array([r.y for r in full], float)
    model.empty = (sum(bare) + base) / (len(bare) + 1)
    # Leave-one-out votes, by tasks over the examples.
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def votes(part: pa.RecordBatch, raw: np.ndarray, off: np.ndarray):
        model, out = sent.value, []
        text, term, count = term_counts(raw, off, model.terms)
        cut = np.searchsorted(text, np.arange(part.num_rows + 1))
        at = np.searchsorted(model.example_ids, part.column(1).to_numpy())
        for j, x, y in zip(at, cut[:-1], cut[1:], strict=True):
            s, e = model.index.top(*model.vector(term[x:y], count[x:y]), model.k, skip=int(j)) if x < y else ((), ())
            out.append(model.vote(s, e) if len(s) else base if x < y else None)
        return part.column(1), out

    each = texts.select("t", F.col("i").cast("long").alias("i")).repartition(docs.sparkSession.sparkContext.defaultParallelism)
    voted = each.mapInArrow(_each_text("t", ["i", "vote"], [pa.int64(), pa.float64()], votes), "i long, vote double").where("vote IS NOT NULL").orderBy("i").collect()  # max_examples rows
    model.ends, model.values = isotonic(np.round([r.vote for r in voted], 9), model.labels, base) if made else (np.ones(1), np.full(1, base))
    return model


@plain_names("score", "predicted", "evidence")
def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1), predicted (0 or 1) and evidence (the nearest examples)."""
    own = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", EVIDENCE)])
    kept = [f for f in docs.schema if f.name not in own.names]
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_examples
    kinds = [pa.float64(), pa.int32(), pa.list_(pa.struct([("example", pa.int64()), ("similarity", pa.float64()), ("label", pa.int32())]))]

    def run(part: pa.RecordBatch, raw: np.ndarray, off: np.ndarray):
        score, evidence = sent.value.score(raw, off)
        return [*(part.column(part.schema.get_field_index(f.name)) for f in kept), score, (score >= 0.5).astype(np.int32), evidence]

    return docs.mapInArrow(_each_text(text_col, [*(f.name for f in kept), *own.names], [*([None] * len(kept)), *kinds], run), T.StructType([*kept, *own]))
