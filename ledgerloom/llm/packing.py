"""Sequence packing with a controlled mixture: deficit round-robin over source queues.

First pass, one task per input split: texts become token ids, and each document gets a place
in [0, 1). The documents of one source in one split take the steps of a golden-ratio
sequence from a start of their own, so that every source spreads evenly over all places,
however the input is sorted. The ids are written to the shared folder.

Then documents are dealt out by place, in one shuffle of the ids, sorted by place, and gather
into blocks of about ``block_tokens``. A block is one row: its documents, their sources and
all ids in order. The blocks are written to the shared folder too.

Between the passes only counts move: tokens per block and source. Running sums over
partitions, and inside them over blocks, give each block the place where its stream
begins and, for each source, the deficit that everything before it has left: its target
share of all tokens so far, less what it got.

Last pass, again one row at a time: each source's documents queue; in every window of
``window_tokens`` a source may send its share of the window plus its carried deficit, a
document being cut where the quota ends, and a source with nothing left passes its quota
on. The block's stream is cut at every multiple of ``seq_tokens`` of the corpus-wide
stream, so only the very last sequence of the corpus is padded.

Targets: shares given by the caller (normalised; a source not named gets none and fills
what the others leave), or each source's share of all tokens, however many sources there are. Every document is packed,
so in the end the mixture is the corpus's; the targets rule the order.

No source is a key of the shuffle, so one source with a third of all rows changes nothing.
A block holds about the corpus's mixture; what it has too much of goes out in its last window, and the deficit is
carried. Windows are those of the corpus-wide stream. Blocks and counts meet in a join that is broadcast only below Spark's own
threshold. ``premix=False`` leaves documents in input order, without the shuffle: then a
block of one source fills its windows with that source, whatever the targets.

Defined results: a null text is empty and yields the end token alone; a null source is a
source of its own; rows of equal or null id are packed one by one; other columns are not
read. An empty table packs into no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .scratch import Scratch

END = 0
SPECIAL = "<|endoftext|>"
NO_SOURCE = "\x00"  # the key that stands for a null source
GOLDEN = 0.6180339887498949

CODED = "doc_id long, source string, tokens long, ids binary, place double"
BLOCK = "part int, block long, tokens long, doc_ids array<long>, sources array<string>, lengths array<long>, ids binary, by_source map<string,long>"
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"


class Encoder:
    """Token ids of a text as little-endian words of ``kind``; the special token's string counts as that token."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str, kind: str = "<u2"):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(t): int(n) for t, n in map(bytes.split, f)}
        self.json_path, self.slow, self.kind = json_path, None, kind
        # The same vocabulary as the JSON file's, several times faster.
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if SPECIAL not in text:
            try:
                return self.fast.encode_to_numpy(text).astype(self.kind).tobytes()
            except ValueError:  # its pattern gives up on runs of several 100,000 blanks
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.json_path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, self.kind).tobytes()


def id_kind(ranks_path: str) -> str:
    """The words that hold any id of a vocabulary."""
    with open(ranks_path, "rb") as f:
        return "<u2" if max(int(line.split()[1]) for line in f) < 1 << 16 else "<u4"


def default_tokenizer() -> tuple[str, str, str]:
    """(json, ranks, pattern) of the installed 50k byte-level vocabulary."""
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


def deal(sources: list[str], lengths: np.ndarray, targets: dict[str, float], deficits: dict[str, float], window: int, at: int) -> list[tuple[int, int, int]]:
    """(document, start, length) in stream order, for one block's documents, whose stream begins at ``at``. ``deficits`` is carried and updated."""
    queues: dict[str, deque[int]] = {}
    for i, s in enumerate(sources):
        queues.setdefault(s, deque()).append(i)
    names = sorted(queues, key=lambda s: (-targets.get(s, 0.0), s))
    left, done, out = int(lengths.sum()), [0] * len(sources), []

    def send(s: str, quota: int) -> int:
        sent, q = 0, queues[s]
        while q and sent < quota:
            i = q[0]
            n = min(quota - sent, int(lengths[i]) - done[i])
            if out and out[-1][0] == i and out[-1][1] + out[-1][2] == done[i]:
                out[-1] = (i, out[-1][1], out[-1][2] + n)
            else:
                out.append((i, done[i], n))
            done[i] += n
            sent += n
            if done[i] == lengths[i]:
                q.popleft()
        return sent

    while left:
        size = min(window - at % window, left)
        room = size
        live = [s for s in names if queues[s]]
        sent = dict.fromkeys(live, 0)
        for s in sorted(live, key=lambda s: (-deficits.get(s, 0.0), s)):
            if room and (n := min(room, int(targets.get(s, 0.0) * size + deficits.get(s, 0.0)))) > 0:
                sent[s] = send(s, n)
                room -= sent[s]
        # Quotas of empty or indebted sources go to the others, by their share.
        live = [s for s in live if queues[s]]
        total = sum(targets.get(s, 0.0) for s in live)
        for k, s in enumerate(live):
            share = targets.get(s, 0.0) / total if total else 1 / len(live)
            if room and (n := min(room, max(1, int(share * room)) if k < len(live) - 1 else room)):
                sent[s] += (got := send(s, n))
                room -= got
        for s in live:
            if room and queues[s]:
                sent[s] += (got := send(s, room))
                room -= got
        for s in set(targets) | set(sent):
            deficits[s] = deficits.get(s, 0.0) + targets.get(s, 0.0) * size - sent.get(s, 0)
        left, at = left - size, at + size
    return out


def tokenize(docs: DataFrame, *, tokenizer: tuple[str, str, str], kind: str = "<u2", id_col: str, text_col: str, source_col: str) -> DataFrame:
    """One row per document: its ids with the end token, and its place in [0, 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = Encoder(*tokenizer, kind), TaskContext.get().partitionId()
        end = np.array([END], kind).tobytes()
        next_place: dict[str, float] = {}
        for batch in batches:
            sources = [NO_SOURCE if s is None else s for s in batch.column(2).to_pylist()]
            coded = [encode(t.as_py() or "") + end for t in batch.column(1)]
            places = []
            for s in sources:
                at = next_place.get(s)
                if at is None:
                    at = int.from_bytes(hashlib.blake2b(f"{part} {s}".encode("utf-8", "surrogatepass"), digest_size=6).digest()) / 2**48
                places.append(at)
                next_place[s] = (at + GOLDEN) % 1.0
            cols = [batch.column(0), pa.array(sources, pa.string()), pa.array([len(c) // len(end) for c in coded], pa.int64()), pa.array(coded, pa.binary()), pa.array(places, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in CODED.split(", ")])

    source = F.col(source_col) if source_col in docs.columns else F.lit(None)
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), source.cast("string").alias("s")).mapInArrow(run, CODED)


def gather(coded: DataFrame, block_tokens: int, kind: str = "<u2") -> DataFrame:
    """One row per block of documents, in the order of the partitions."""

    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        sources: list[str] = []
        coded: list[bytes] = []
        size = 0

        def block() -> pa.RecordBatch:
            lengths = [len(c) // width for c in coded]
            by: dict[str, int] = {}
            for s, n in zip(sources, lengths, strict=True):
                by[s] = by.get(s, 0) + n
            cols = [[part], [number], [sum(lengths)], [ids], [sources], [lengths], [b"".join(coded)], [list(by.items())]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary(), pa.map_(pa.string(), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split()[0] for f in BLOCK.split(", ")])

        for batch in batches:
            for i, s, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                ids.append(i)
                sources.append(s)
                coded.append(c)
                size += len(c) // width
                if size >= block_tokens:
                    yield block()
                    number, ids, sources, coded, size = number + 1, [], [], [], 0
        if coded:
            yield block()

    return coded.select("doc_id", "source", "ids").mapInArrow(run, BLOCK)


def mixed(coded: DataFrame, block_tokens: int) -> DataFrame:
    """Documents in the order of their places: ranges of places in partitions of a block and more, so far as Spark's number of partitions allows."""
    total = coded.agg(F.sum("tokens")).first()[0] or 0
    n = max(1, min(int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // block_tokens))
    return coded.repartitionById(n, F.floor(F.col("place") * n).cast("int")).sortWithinPartitions("place")


def pack(
    docs: DataFrame,
    *,
    targets: dict[str, float] | None = None,
    seq_tokens: int = 1024,
    window_tokens: int = 65_536,
    block_tokens: int = 1 << 20,
    premix: bool = True,
    tokenizer: tuple[str, str, str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (long) and source."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    tokenizer = tokenizer or default_tokenizer()
    kind = id_kind(tokenizer[1])
    coded = tokenize(docs, tokenizer=tokenizer, kind=kind, id_col=id_col, text_col=text_col, source_col=source_col)
    if premix:
        # Written first: places hang on the order of rows, which a task that runs again must not change.
        coded = scratch.table(coded, "coded")
        path = scratch.last
        blocks = scratch.table(gather(mixed(coded, block_tokens), block_tokens, kind), "blocks")
        scratch.drop(path)
    else:
        blocks = scratch.table(gather(coded, block_tokens, kind), "blocks")
    # Counts alone from here to the join: running sums over partitions, then over a partition's blocks.
    count = blocks.select("part", "block", F.explode("by_source").alias("s", "n"))
    by_part = count.groupBy("part", "s").agg(F.sum("n").alias("n"))
    all_parts = by_part.groupBy("part").agg(F.sum("n").alias("n"))
    before = all_parts.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("at"))
    in_part = W.partitionBy("part").orderBy("block")
    places = blocks.select("part", "block", (F.sum("tokens").over(in_part) - F.col("tokens")).alias("inside")).join(before, "part").select("part", "block", (F.col("at") + F.col("inside")).alias("at"))
    # What each source got before a block: in earlier partitions, then in earlier blocks of its own.
    parts_so_far = by_part.select("part", "s", F.sum("n").over(W.partitionBy("s").orderBy("part")).alias("so_far"))
    so_far = (
        count.join(parts_so_far.withColumnRenamed("so_far", "part_end"), ["part", "s"])
        .join(by_part.withColumnRenamed("n", "part_n"), ["part", "s"])
        .select("part", "block", "s", (F.col("part_end") - F.col("part_n") + F.sum("n").over(W.partitionBy("part", "s").orderBy("block")) - F.col("n")).alias("got"))
    )
    # Each block takes along its own sources' tokens in the whole corpus; no table of all sources reaches the driver.
    of_corpus = by_part.groupBy("s").agg(F.sum("n").alias("all"))
    carried = so_far.join(of_corpus, "s").groupBy("part", "block").agg(F.map_from_entries(F.collect_list(F.struct("s", F.struct("got", "all")))).alias("got"))
    layout = scratch.table(places.join(carried, ["part", "block"]), "layout")
    given = None
    if targets is None:
        total = float(by_part.agg(F.sum("n")).first()[0] or 1)
    else:
        total = sum(map(float, targets.values())) or 1.0
        given = {NO_SOURCE if s is None else s: float(x) / total for s, x in targets.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in PIECE.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):
                at, got, doc_ids, sources, lengths, ids = (batch.column(i)[k].as_py() for i in range(6))
                lengths, got = np.array(lengths, np.int64), dict(got)
                # Targets of sources that the block doesn't hold would change nothing in it.
                share = {s: x["all"] / total if given is None else given.get(s, 0.0) for s, x in got.items()}
                deficits = {s: share[s] * at - x["got"] for s, x in got.items()}
                first = np.concatenate([[0], np.cumsum(lengths)])
                wide = np.frombuffer(ids, kind).astype("<u4")
                rows: list[tuple] = []
                for i, start, n in deal(sources, lengths, share, deficits, window_tokens, at):
                    while n:
                        m = min(n, seq_tokens - at % seq_tokens)
                        crc = zlib.crc32(wide[first[i] + start : first[i] + start + m].tobytes())
                        rows.append((doc_ids[i], start, m, crc, int(lengths[i]), at // seq_tokens, at % seq_tokens, None if sources[i] == NO_SOURCE else sources[i]))
                        at, start, n = at + m, start + m, n - m
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return blocks.join(layout, ["part", "block"]).select("at", "got", "doc_ids", "sources", "lengths", "ids").mapInArrow(run, PIECE)
