"""Benchmark decontamination by an FM-index over every training shard.

A shard is a slice of an Arrow batch of documents. Its words become symbols: the number
of the word in the test set's vocabulary, or a break for any other word. A run of
symbols that is shorter than the shortest test window holds no occurrence, and no
window holds a break, so only the other runs enter the index; that drops no match.
The index is a suffix array built by prefix doubling, its Burrows-Wheeler transform in
a wavelet matrix, and suffix positions sampled at regular text positions. All windows
search backwards together, one word a step. Occurrences are located by walking to a
sampled position, and overlapping ones merge into removal spans.

A document needs nothing but itself and the test set, so the plan is one pass without a
shuffle, and no key can be hot. The test set goes to the executors in blocks of bounded
size (``block_bytes`` of text each); every block searches the same index.

Defined results: a null text has no words; a document without words is clean. A test
item without words, or a null one, has no window. Items with the same id are one item
with the windows of all its rows; so are items with null id, which count in n_hit, spans
and once in n_items, but have no name in items. Rows of the
documents are judged one by one, so equal or null ids do no harm. Input columns are
kept; the operator's columns replace columns of the same names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import plain_names
from .text import ALNUM, text_slices, words

OWN = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


class WaveletMatrix:
    """Rank over symbols below ``2**bits``: a bit vector with prefix counts for each bit, highest first."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for k in range(bits - 1, -1, -1):
            ones = (symbols >> k & 1).astype(np.int32)
            before = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(ones, out=before[1:])
            self.levels.append((k, before, len(symbols) - int(before[-1])))
            symbols = np.concatenate([symbols[ones == 0], symbols[ones == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        lo, hi = np.zeros_like(upto), upto
        for k, before, zeros in self.levels:
            one = (symbol >> k & 1).astype(bool)
            a, b = before[lo], before[hi]
            lo, hi = np.where(one, zeros + a, lo - a), np.where(one, zeros + b, hi - b)
        return hi - lo

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros_like(at)
        for k, before, zeros in self.levels:
            a = before[at]
            one = (before[at + 1] - a).astype(bool)
            out |= one.astype(at.dtype) << k
            at = np.where(one, zeros + a, at - a)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; after each round only suffixes that still tie are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    key = text[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # a group is named by its first place
    rank = np.empty(n, np.int64)
    rank[order] = group
    h = 1
    while True:
        end = np.append(np.flatnonzero(head)[1:], n)
        size = end - np.flatnonzero(head)
        tied = np.flatnonzero(np.repeat(size, size) > 1)
        if not len(tied):
            return order
        at = order[tied]
        nxt = at + h
        after = np.where(nxt < n, rank[np.minimum(nxt, n - 1)] + 1, 0)
        g = group[tied]
        k = np.lexsort((after, g))
        at, after, g = at[k], after[k], g[k]
        order[tied] = at
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (after[1:] != after[:-1])])
        head[tied] = new
        group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[at] = group[tied]
        h *= 2


class FMIndex:
    """Over symbols from 0 up; ``sample``: every so many text positions the suffix's position is kept."""

    def __init__(self, text: np.ndarray, alphabet: int, sample: int = 8):
        text = np.append(text.astype(np.int64) + 1, 0)  # 0 ends the text
        self.n = len(text)
        sa = suffix_array(text)
        self.bwt = WaveletMatrix(text[sa - 1], max(1, int(alphabet).bit_length()))
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet + 1))]).astype(np.int64)
        kept = sa % sample == 0
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept = sa[kept]

    def ranges(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of all patterns (rows, left-aligned), by backward search."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            on = np.flatnonzero((lengths >= step) & (lo < hi))
            if not len(on):
                break
            c = patterns[on, lengths[on] - step] + 1
            lo[on], hi[on] = self.below[c] + self.bwt.rank(c, lo[on]), self.below[c] + self.bwt.rank(c, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes, each found by steps to the left up to a kept one."""
        out, steps = np.full(len(rows), -1, np.int64), 0
        todo, at = np.arange(len(rows)), rows
        while len(todo):
            found = self.kept_before[at + 1] > self.kept_before[at]
            out[todo[found]] = self.kept[self.kept_before[at[found]]] + steps
            todo, at = todo[~found], at[~found]
            c = self.bwt.access(at)
            at = self.below[c] + self.bwt.rank(c, at)
            steps += 1
        return out


class TestSet:
    """Windows of one block of items, as rows of symbols."""

    __test__ = False

    def __init__(self, items: Iterable[tuple[str | None, str]], window: int):
        ids, texts = [], []
        for i, t in items:
            if t:
                ids.append(i)
                texts.append(t)
        names = sorted(set(ids), key=lambda i: (i is None, i or ""))
        number = {i: k for k, i in enumerate(names)}
        self.ids = names
        hashes, rows, lengths, owner = [], [], [], []
        for lo, _, raw, off in text_slices(pa.array(texts, pa.string())):
            w = words(raw, off, ALNUM)
            for k in range(len(off) - 1):
                h = w.hash[w.first[k] : w.first[k + 1]]
                hashes.append(h)
                n = min(len(h), window)
                for s in range(len(h) - n + 1 if n else 0):
                    rows.append(h[s : s + n])
                    lengths.append(n)
                    owner.append(number[ids[lo + k]])
        self.vocabulary = np.unique(np.concatenate([*hashes, np.zeros(0, np.uint64)]))
        self.shortest = min(lengths, default=0)
        # Equal windows of several items are searched once.
        seen: dict[bytes, int] = {}
        self.patterns = np.zeros((len(rows), window), np.int64)
        self.lengths = np.zeros(len(rows), np.int64)
        self.owners: list[set[int]] = []
        for r, n, o in zip(rows, lengths, owner, strict=True):
            p = seen.setdefault(r.tobytes(), len(seen))
            if p == len(self.owners):
                self.patterns[p, :n] = np.searchsorted(self.vocabulary, r)
                self.lengths[p] = n
                self.owners.append(set())
            self.owners[p].add(o)
        self.patterns, self.lengths = self.patterns[: len(seen)], self.lengths[: len(seen)]
        self._maybe = np.zeros(1 << 16, bool)
        self._maybe[self.vocabulary & np.uint64(0xFFFF)] = True

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers in the vocabulary, -1 for other words."""
        out = np.full(len(hashes), -1, np.int64)
        at = np.flatnonzero(self._maybe[hashes & np.uint64(0xFFFF)])
        k = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        good = self.vocabulary[k] == hashes[at]
        out[at[good]] = k[good]
        return out

    def occurrences(self, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word position, pattern) of every occurrence inside one document of the shard."""
        none = np.zeros(0, np.int64)
        if not self.shortest or not len(hashes):
            return none, none
        sym = self.symbols(hashes)
        known = sym >= 0
        # Runs of known words inside one document, as long as the shortest window at least.
        joined = np.zeros(len(sym), bool)
        joined[1:] = known[1:] & known[:-1] & (doc[1:] == doc[:-1])
        start = np.flatnonzero(known & ~joined)
        length = np.diff(np.append(np.flatnonzero(~joined), len(sym)))[known[np.flatnonzero(~joined)]]
        keep = length >= self.shortest
        start, length = start[keep], length[keep]
        if not len(start):
            return none, none
        # Each run is followed by a break, whose symbol no pattern has.
        where = np.arange(int((length + 1).sum())) - np.repeat(np.cumsum(length + 1) - (length + 1), length + 1) + np.repeat(start, length + 1)
        broken = np.cumsum(length + 1) - 1
        text = sym[np.minimum(where, len(sym) - 1)]
        text[broken] = len(self.vocabulary)
        index = FMIndex(text, len(self.vocabulary) + 1)
        lo, hi = index.ranges(self.patterns, self.lengths)
        n = np.maximum(hi - lo, 0)
        pattern = np.repeat(np.arange(len(n)), n)
        rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return where[index.locate(rows)], pattern


def shard_hits(raw: np.ndarray, offsets: np.ndarray, sets: list[TestSet]) -> Iterator[tuple[int, int, int, list[str], list[tuple[int, int]]]]:
    """For each text: words, hit words, items found, their names, merged spans of word positions (end exclusive)."""
    w = words(raw, offsets, ALNUM)
    docs = len(offsets) - 1
    cover = np.zeros(len(w.hash) + 1, np.int64)
    items: dict[int, set[str | None]] = {}
    for s in sets:
        at, pattern = s.occurrences(w.hash, w.doc)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + s.lengths[pattern], -1)
        pairs = np.unique(np.stack([w.doc[at], pattern]), axis=1) if len(at) else np.zeros((2, 0), np.int64)
        for d, p in pairs.T.tolist():
            items.setdefault(d, set()).update(s.ids[o] for o in s.owners[p])
    hit = np.cumsum(cover[:-1]) > 0
    count = np.concatenate([[0], np.cumsum(hit)])
    for d in range(docs):
        a, b = int(w.first[d]), int(w.first[d + 1])
        spans: list[tuple[int, int]] = []
        if n := int(count[b] - count[a]):
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[a:b].astype(np.int8), [0]])))
            spans = [(int(x), int(y)) for x, y in zip(edge[::2], edge[1::2], strict=True)]
        found = items.get(d, set())
        yield b - a, n, len(found), sorted(found - {None}), spans


@plain_names(*OWN.names)
def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 13, block_bytes: int = 16 << 20, shard_bytes: int = 1 << 21) -> DataFrame:
    """``docs`` with n_words, n_hit, n_items (long), items (sorted strings) and spans (of word positions, merged).

    A window is ``window`` consecutive words of an item, or the whole of a shorter one.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    blocks = []
    for k in range(n):  # one block at a time on the driver
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k)
        blocks.append(spark.sparkContext.broadcast(TestSet(((r.i, r.t) for r in part.toLocalIterator()), window)))
    own = {f.name for f in OWN}
    kept = [f for f in docs.schema if f.name not in own]
    schema = T.StructType([*kept, *OWN])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = [b.value for b in blocks]
        kinds = [pa.int64()] * 3 + [pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        for batch in batches:
            for lo, hi, raw, off in text_slices(batch.column(batch.schema.get_field_index(text_col)), shard_bytes):
                n_words, n_hit, n_items, found, spans = zip(*shard_hits(raw, off, sets), strict=True)
                cols = [n_words, n_hit, n_items, found, [[{"start": a, "end": b} for a, b in s] for s in spans]]
                part = batch.slice(lo, hi - lo)
                arrays = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def contaminated(share_of: int = 20) -> F.Column:
    """Whether a twentieth of a document's words, and one at least, lies in occurrences."""
    return (F.col("n_hit") > 0) & (share_of * F.col("n_hit") >= F.col("n_words"))
