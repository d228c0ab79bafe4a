"""Near duplicates by Jaccard similarity of word shingles, filtered under several global token orders.

Tokens are 64-bit hashes of shingles. In any one order of all tokens, two sets of
similarity t share a token among the first n - ceil(t n) + 1 of each (prefix filter). A
candidate must pass under every one of ``orders`` different orders before it is verified,
and verification counts the whole intersection. All orders put rare tokens first, by a
power of two of the number of sets that hold the token, and break ties by hashes of their
own. Those numbers are counted exactly, so tokens of one set alone come first of all, and a
set more than 1 - t of whose tokens are its own can have no partner.

Steps:

1. Each document's set: its size and a 128-bit digest.
2. Counts. A task gathers sets into slices of ``slice_tokens``, folds equal ones, and sends
   each slice's distinct tokens, sorted, to buckets of the hash space. A bucket answers each
   slice with those that several sets hold, and with their class. A slice's own sets whose
   shared tokens reach t of them live on; the others are done. A token that a slice holds
   more than once travels once, so a token of a third of all rows is a few bytes a slice.
   What lives on folds by digest and is counted once more among itself, which lets go of
   sets whose tokens only copies of them, or sets that are gone, held.
3. Postings of the first order's prefixes, with their places in the order. Tokens of one
   posting lead nowhere; each other token links its postings to one leader (a star, not all
   pairs). A pair whose first common token stands too late in either set is no candidate:
   no common token stands before it. The other orders' prefixes must meet, too; then the
   sets are intersected.
4. Components of the verified links; further stars with other leaders while a round still
   joins at least one set in fifty.
5. What stars may miss lies in tokens whose sets are in several components. There the sets
   outside the token's largest component meet all others of other components and of fitting
   sizes, if their places let them be candidates and no star has tried them.
6. Components over all links, and the smallest id of each.

No two sets of one component are paired again, so a group of n near copies costs about n
candidates for each round. Step 5 compares the places of sets of one token that no chain
of links has joined; its candidates are those that could still be similar by their sizes,
exact counts and places.

Defined results: a null or empty text, or one of white space, has no tokens and links with
nothing; fewer words than a shingle are one token. Rows with a null id take no part (their
component is null); rows with the same id are one document with the links of all its texts.
An empty table yields no rows. Input columns except the text are kept, those named like the
operator's are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .names import plain_names
from .scratch import Scratch
from .text import NOT_SPACE, U64, mix, text_slices, words

_STEP = np.random.default_rng(5).integers(1, 2**63, 64, dtype=np.int64).astype(U64) | U64(1)


def shingles(raw: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted set of each text."""
    w = words(raw, offsets, NOT_SPACE)
    n = np.diff(w.first)
    if len(w.hash) >= size:
        rolled = np.zeros(len(w.hash) - size + 1, U64)
        for k in range(size):
            rolled += w.hash[k : k + len(rolled)] * _STEP[k]
        rolled = mix(rolled)
    for d in range(len(offsets) - 1):
        a, b = w.first[d], w.first[d + 1]
        if n[d] >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif n[d]:
            short = w.hash[a:b] * _STEP[: n[d]]
            yield mix(short.sum(keepdims=True) + _STEP[63:] * U64(n[d]))
        else:
            yield np.zeros(0, U64)


def digest(tokens: np.ndarray) -> tuple[int, int, int]:
    """Of a set: its size and two sums of hashes, as signed 64-bit numbers."""
    d = [mix(tokens ^ _STEP[k]).sum(dtype=U64).astype(np.int64) for k in (61, 62)]
    return len(tokens), int(d[0]), int(d[1])


def needed(n: int, percent: int) -> int:
    """Of n tokens, those that a set of the wanted similarity shares at least."""
    return -(-percent * n // 100)


def prefix(tokens: np.ndarray, classes: np.ndarray, alone: int, percent: int, order: int) -> np.ndarray:
    """Of a set's shared tokens those in its prefix, in the order's own sequence; ``alone`` tokens of no other set precede them."""
    n = len(tokens) + alone
    rank = mix(tokens ^ _STEP[order]) >> U64(8) | classes.astype(U64) << U64(56)
    return tokens[np.lexsort((tokens, rank))[: n - needed(n, percent) + 1 - alone]]


def packed(tokens: np.ndarray) -> bytes:
    """Rising numbers: the width of a step in bytes, the first number, the steps."""
    if not len(tokens):
        return b""
    step = np.diff(tokens)
    width = max(1, (int(step.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + tokens[:1].tobytes() + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, U64)
    step = np.frombuffer(data, np.uint8, offset=9).reshape(-1, data[0])
    wide = np.zeros((len(step) + 1, 8), np.uint8)
    wide[0] = np.frombuffer(data, np.uint8, 8, 1)
    wide[1:, : data[0]] = step
    return np.cumsum(wide.view("<u8").ravel(), dtype=U64)


class Slice:
    """Distinct sets of one task, until they are sent out."""

    def __init__(self, buckets: int, most: int):
        self.shift, self.buckets, self.most = U64(64 - (buckets.bit_length() - 1)), buckets, most
        self.part, self.number = TaskContext.get().partitionId(), 0
        self.clear()

    def clear(self) -> None:
        self.sets: dict[tuple[int, int, int], np.ndarray] = {}
        self.size = 0

    def add(self, key: tuple[int, int, int], tokens: np.ndarray) -> bool:
        """Whether the slice is full."""
        if key not in self.sets:
            self.sets[key] = tokens
            self.size += len(tokens)
        return self.size >= self.most

    def rows(self) -> pa.RecordBatch:
        """A row for each bucket: tokens, the set of each or a mark that several hold it, and how many do. And one
        with the digests and the sets of those several, which goes along with any bucket."""
        kind = np.uint16 if len(self.sets) < 1 << 16 else np.uint32
        mark = np.iinfo(kind).max
        tokens = np.concatenate([*self.sets.values()])
        owner = np.repeat(np.arange(len(self.sets)), [len(s) for s in self.sets.values()])
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        count = np.diff(np.append(head, len(tokens)))
        several = count > 1
        own = np.where(several, mark, owner[head]).astype(kind)
        distinct = tokens[head]
        cut = np.searchsorted((distinct >> self.shift).astype(np.int64), np.arange(self.buckets + 1))
        number = (self.part << 32) + self.number
        self.number += 1
        rows = [(number % self.buckets, np.array([*self.sets], "<i8").tobytes(), packed(distinct[several]), count[several].astype("<u4").tobytes(), owner[np.repeat(several, count)].astype("<u4").tobytes())]
        for b in np.flatnonzero(np.diff(cut)).tolist():
            s = slice(cut[b], cut[b + 1])
            rows.append((b, packed(distinct[s]), own[s].tobytes(), count[s][several[s]].astype("<u4").tobytes(), None))
        self.clear()
        cols = [*zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([number] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "slice", "a", "b", "c", "d"])


SENT = "bucket long, slice long, a binary, b binary, c binary, d binary"
_BYTES = ("a", "b", "c", "d")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[tuple[int, list[bytes]]]]]:
    """Rows of one key, which stand together: (slice, binaries) each."""
    now, rows = None, []
    for batch in batches:
        keys, slices = batch.column(batch.schema.get_field_index(key)).to_pylist(), batch.column(batch.schema.get_field_index("slice")).to_pylist()
        cols = [batch.column(batch.schema.get_field_index(c)) for c in _BYTES]
        for i, k in enumerate(keys):
            if k != now and rows:
                yield now, rows
                rows = []
            now = k
            rows.append((slices[i], [c[i].as_py() for c in cols]))
    if rows:
        yield now, rows


def _owners(own: bytes, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of sets, which are the mark of several sets)"""
    x = np.frombuffer(own, np.uint16 if len(own) == 2 * tokens else np.uint32)
    return x.astype(np.int64), x == np.iinfo(x.dtype).max


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets to slices: of each row the tokens that several sets hold, with the class of how many do."""
    for _, rows in _runs(batches, "bucket"):
        heads = [(s, x) for s, x in rows if x[3] is not None]
        asked = [(s, unpacked(x[0]), x[1], x[2]) for s, x in rows if x[3] is None]
        out = [(s, *x) for s, x in heads]
        if asked:
            tokens = np.concatenate([t for _, t, _, _ in asked])
            weight = np.ones(len(tokens), np.int64)
            weight[np.concatenate([_owners(own, len(t))[1] for _, t, own, _ in asked])] = np.concatenate([np.frombuffer(c, "<u4") for *_, c in asked])
            order = np.argsort(tokens, kind="stable")
            head = np.concatenate([[True], tokens[order][1:] != tokens[order][:-1]])
            total = np.empty(len(tokens), np.int64)
            total[order] = np.add.reduceat(weight[order], np.flatnonzero(head))[np.cumsum(head) - 1]
            at = 0
            for s, t, own, _ in asked:
                n = total[at : at + len(t)]
                at += len(t)
                keep = n > 1
                if keep.any():
                    classes = np.floor(np.log2(n[keep])).astype(np.uint8)
                    out.append((s, packed(t[keep]), np.frombuffer(own, np.uint8).reshape(len(t), -1)[keep].tobytes(), classes.tobytes(), None))
        if out:
            cols = [*zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["slice", *_BYTES])


def _gathered(rows: list[tuple[int, list[bytes]]], percent: int) -> Iterator[tuple[tuple[int, int, int], np.ndarray, np.ndarray]]:
    """(digest, shared tokens, their classes) of a slice's sets that may have a partner."""
    head = next(x for _, x in rows if x[3] is not None)
    keys = np.frombuffer(head[0], "<i8").reshape(-1, 3)
    tokens, classes, owner = [np.zeros(0, U64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    held, counts, several = unpacked(head[1]), np.frombuffer(head[2], "<u4"), np.frombuffer(head[3], "<u4").astype(np.int64)
    class_of = np.zeros(len(held), np.uint8)
    for _, x in rows:
        if x[3] is None:
            t, c = unpacked(x[0]), np.frombuffer(x[2], np.uint8)
            own, many = _owners(x[1], len(t))
            class_of[np.searchsorted(held, t[many])] = c[many]
            tokens.append(t[~many])
            classes.append(c[~many])
            owner.append(own[~many])
    tokens, classes, owner = (np.concatenate([*x, np.repeat(y, counts) if z else y]) for x, y, z in ((tokens, held, True), (classes, class_of, True), (owner, several, False)))
    shared = np.bincount(owner, minlength=len(keys))
    lives = shared * 100 >= keys[:, 0] * percent
    keep = lives[owner]
    tokens, classes, owner = tokens[keep], classes[keep], owner[keep]
    order = np.argsort(owner, kind="stable")
    cut = np.searchsorted(owner[order], np.arange(len(keys) + 1))
    for d in np.flatnonzero(lives).tolist():
        at = order[cut[d] : cut[d + 1]]
        yield tuple(keys[d].tolist()), tokens[at], classes[at]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, U64), *parts]).astype(np.int64)))


def _surviving(source: DataFrame, sets_of: Callable, buckets: int, slice_tokens: int, percent: int, made: Callable, schema: str) -> DataFrame:
    """Step 2: what ``made`` makes of the sets of ``source`` that may have a partner."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = Slice(buckets, slice_tokens)
        for batch in batches:
            for key, tokens in sets_of(batch):
                # A set of n has no other partner than its equals unless n of n + 1 tokens are similar enough.
                if key[0] * 100 >= (key[0] + 1) * percent and part.add(key, tokens):
                    yield part.rows()
        if part.sets:
            yield part.rows()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _runs(batches, "slice"):
            found = []
            for x in _gathered(rows, percent):
                found.append(x)
                if sum(len(t) for _, t, _ in found[-64:]) > 1 << 20 or len(found) == 4096:
                    yield made(found)
                    found = []
            if found:
                yield made(found)

    n = max(1, min(int(source.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets))
    sent = source.mapInArrow(send, SENT)
    answered = sent.repartitionById(n, F.floor(F.col("bucket") * n / buckets).cast("int")).sortWithinPartitions("bucket").mapInArrow(_answer, "slice long, a binary, b binary, c binary, d binary")
    return answered.repartition("slice").sortWithinPartitions("slice").mapInArrow(gather, schema)


def _close(n: str, m: str, percent: int) -> Column:
    """Sizes that allow the similarity."""
    return (F.col(n) * 100 >= F.col(m) * percent) & (F.col(m) * 100 >= F.col(n) * percent)


def _early(n: str, m: str, p: str, q: str, percent: int) -> Column:
    """Whether sets of n and m tokens whose first common token is the p-th and the q-th (from 0) can be similar
    enough: they share no token before it, so at most n - p and m - q."""
    need = (F.col(n) + F.col(m)) * percent
    return ((F.col(n) - F.col(p)) * (100 + percent) >= need) & ((F.col(m) - F.col(q)) * (100 + percent) >= need)


@plain_names("n_shingles", "component_id")
def ngram_jaccard(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    orders: int = 3,
    slice_tokens: int = 1 << 21,
    bucket_tokens: int = 1 << 21,
) -> DataFrame:
    """``docs`` without its text, with n_shingles (long) and component_id: the smallest id reachable by links of
    ``100 * intersection >= percent * union``."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    kept = [f for f in docs.schema if f.name not in (text_col, "n_shingles", "component_id")]
    own = T.StructType.fromDDL("n_shingles long, __ng_d1 long, __ng_d2 long")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in text_slices(batch.column(batch.schema.get_field_index(text_col))):
                made = zip(*(digest(s) for s in shingles(raw, off, shingle)), strict=True)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(f.name)) for f in kept), *(pa.array(c, pa.int64()) for c in made)], names=[*(f.name for f in kept), *own.names])

    described = scratch.table(docs.mapInArrow(describe, T.StructType([*kept, *own])), "sets")
    sets = described.where(F.col(id_col).isNotNull() & (F.col("n_shingles") > 0)).select(F.col(id_col).alias("id"), F.col("n_shingles").alias("n"), F.col("__ng_d1").alias("d1"), F.col("__ng_d2").alias("d2"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    buckets = max(256, 1 << (total // bucket_tokens).bit_length())

    # Sets that may have a partner: first of all texts, then among themselves.
    def of_texts(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
        for _, _, raw, off in text_slices(batch.column(0)):
            for s in shingles(raw, off, shingle):
                if len(s):
                    yield digest(s), s

    def of_sets(batch: pa.RecordBatch) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
        n, d1, d2 = (batch.column(k).to_pylist() for k in range(3))
        for k in range(batch.num_rows):
            yield (n[k], d1[k], d2[k]), np.sort(batch.column(3)[k].values.to_numpy().astype(U64))

    def bare(found: list) -> pa.RecordBatch:
        keys = [*zip(*(k for k, _, _ in found), strict=True)]
        return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), _lists([t for _, t, _ in found])], names=["n", "d1", "d2", "tokens"])

    def ordered(found: list) -> pa.RecordBatch:
        keys = [*zip(*(k for k, _, _ in found), strict=True)]
        alone = [k[0] - len(t) for k, t, _ in found]
        prefixes = [_lists([prefix(t, c, a, percent, o) for a, (_, t, c) in zip(alone, found, strict=True)]) for o in range(orders)]
        return pa.RecordBatch.from_arrays([*(pa.array(k, pa.int64()) for k in keys), pa.array(alone, pa.int64()), _lists([t for _, t, _ in found]), *prefixes], names=["n", "d1", "d2", "alone", "tokens", *(f"o{o}" for o in range(orders))])

    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(text_col).alias("t"))
    schema = "n long, d1 long, d2 long, tokens array<long>"
    first = _surviving(texts, of_texts, buckets, slice_tokens, percent, bare, schema).withColumn("part", F.monotonically_increasing_id())
    first = scratch.table(first, "first")
    one = first.groupBy("n", "d1", "d2").agg(F.min("part").alias("part")).select("part")
    first = first.join(one, "part", "left_semi").select("n", "d1", "d2", "tokens")
    schema = "n long, d1 long, d2 long, alone long, tokens array<long>, " + ", ".join(f"o{o} array<long>" for o in range(orders))
    alive = _surviving(first, of_sets, buckets, slice_tokens, percent, ordered, schema)
    alive = scratch.table(alive.withColumn("key", F.monotonically_increasing_id()), "alive")
    living = alive.agg(F.count("*")).first()[0]

    # Postings of tokens in two prefixes and more. A token's leader has few tokens of its own, as the source of a family of copies.
    postings = alive.select("key", "n", "alone", F.posexplode("o0").alias("p", "k")).withColumn("p", F.col("p") + F.col("alone"))
    shared = postings.groupBy("k").agg(F.count("*").alias("held")).where("held > 1").select("k")
    postings = scratch.table(postings.join(shared, "k").select("k", "key", "n", "p", (F.col("alone") / F.col("n")).alias("off")), "postings")

    side = ["key", "n", "tokens", *(f"o{o}" for o in range(1, orders))]
    left, right = (alive.select(*(F.col(c).alias(f"{s}_{c}") for c in side)) for s in "ab")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) those that share prefix tokens under all orders and are similar enough."""
        pairs = pairs.join(left, F.col("a") == F.col("a_key")).join(right, F.col("b") == F.col("b_key"))
        for o in range(1, orders):
            pairs = pairs.where(F.arrays_overlap(f"a_o{o}", f"b_o{o}"))
        both = F.size(F.array_intersect("a_tokens", "b_tokens"))
        return scratch.table(pairs.where(both * (100 + percent) >= (F.col("a_n") + F.col("b_n")) * percent).select("a", "b"), "links")

    none = alive.select(F.col("key").alias("a"), F.col("key").alias("b")).where(F.lit(False))
    links, tried, placed = none, none, postings.withColumn("c", F.col("key"))
    for turn in range(64):
        # The first leader is the least changed set, later ones are drawn by a hash, the same for all tokens.
        best = (-F.col("off")) if not turn else F.xxhash64("key", F.lit(turn)).cast("double")
        lead = placed.groupBy("k").agg(F.max(F.struct(best.alias("best"), (-F.col("key")).alias("tie"), "key", "n", "p", "c")).alias("x"))
        lead = lead.select("k", F.col("x.key").alias("l"), F.col("x.n").alias("m"), F.col("x.p").alias("q"), F.col("x.c").alias("lc"))
        star = placed.join(lead, "k").where((F.col("c") != F.col("lc")) & _close("n", "m", percent) & _early("n", "m", "p", "q", percent))
        star = star.select(F.least("key", "l").alias("a"), F.greatest("key", "l").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")
        star = scratch.table(star, "star")
        new = verified(star)
        joined = new.agg(F.count("*")).first()[0]
        links, tried = links.union(new), tried.union(star)
        if turn and not joined:
            break
        parts = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
        placed = postings.join(parts, F.col("key") == F.col("node"), "left").select("k", "key", "n", "p", "off", F.coalesce("component", "key").alias("c"))
        of_token = placed.groupBy("k", "c").agg(F.count("*").alias("held")).groupBy("k").agg(F.count("*").alias("parts"), F.max(F.struct("held", "c"))["c"].alias("main")).where("parts > 1")
        placed = scratch.table(placed.join(of_token.select("k", "main"), "k"), "mixed")
        if joined * 50 < living:
            break

    # The smaller of two sets (by size, then key) must hold the token early enough for a partner of its own size.
    x = placed.where((F.col("n") - F.col("p")) * (100 + percent) >= F.col("n") * 2 * percent).alias("x")
    y = placed.alias("y")
    fits = (F.col("x.k") == F.col("y.k")) & (F.col("x.c") != F.col("y.c")) & ((F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.key") < F.col("y.key")))
    fits = fits & _close("x.n", "y.n", percent) & _early("x.n", "y.n", "x.p", "y.p", percent)
    pair = (F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b"))
    outside = x.where("c != main").join(y, fits).select(*pair).union(x.where("c = main").join(y.where("c != main").alias("y"), fits).select(*pair))
    late = scratch.table(outside.distinct().join(tried, ["a", "b"], "left_anti"), "late")
    more = verified(late)

    # Rows of one id are one document: its sets are linked. Sets that have no partner get keys below zero.
    nodes = alive.select("n", "d1", "d2", "key")
    twice = sets.groupBy("id").agg(*(f(c).alias(f"{f.__name__}_{c}") for c in ("n", "d1", "d2") for f in (F.min, F.max)))
    twice = twice.where("min_n != max_n OR min_d1 != max_d1 OR min_d2 != max_d2").select("id")
    again = scratch.table(sets.join(twice, "id", "left_semi").distinct(), "again")
    if not again.isEmpty():
        lone = again.select("n", "d1", "d2").distinct().join(nodes, ["n", "d1", "d2"], "left_anti").withColumn("key", -1 - F.monotonically_increasing_id())
        nodes = nodes.union(scratch.table(lone, "lone"))
        held = again.join(nodes, ["n", "d1", "d2"]).select("id", "key")
        more = more.union(held.join(held.groupBy("id").agg(F.min("key").alias("least")), "id").select("least", "key"))

    if not more.isEmpty():
        parts = components(parts.select(F.col("component").alias("u"), F.col("node").alias("v")).union(more.select("a", "b")), scratch)
    named = nodes.join(parts, F.col("key") == F.col("node"), "left").select("n", "d1", "d2", F.coalesce("component", "key").alias("c"))
    reps = sets.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep")).join(named, ["n", "d1", "d2"], "left")
    least = reps.where(F.col("c").isNotNull()).groupBy("c").agg(F.min("rep").alias("low"))
    reps = reps.join(least, "c", "left").select(F.col("n").alias("__ng_n"), F.col("d1").alias("__ng_e1"), F.col("d2").alias("__ng_e2"), F.coalesce("low", "rep").alias("__ng_component"))
    takes_part = F.col(id_col).isNotNull() & (F.col("n_shingles") > 0)
    names = [f.name for f in kept]
    out = described.where(takes_part).join(reps, (F.col("n_shingles") == F.col("__ng_n")) & (F.col("__ng_d1") == F.col("__ng_e1")) & (F.col("__ng_d2") == F.col("__ng_e2")))
    out = out.select(*names, "n_shingles", F.col("__ng_component").alias("component_id"))
    out = out.union(described.where(~takes_part).select(*names, "n_shingles", F.col(id_col).alias("component_id")))
    out = Scratch(spark, "ngrams-result").table(out, "components")
    scratch.drop()  # only the result is needed from here on
    return out
