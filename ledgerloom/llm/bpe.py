"""Byte-pair encoding with word ends, and decoding, of whole texts in one pass each.

A text is cut at special tokens and split into normalised words: by a pattern where all signs
lie below U+0180, whose classes and normal form no Unicode version changes, else by the file's own normaliser
and splitter. A worker keeps the ids of a bounded number of short words, so frequent ones are
merged once. All new words of a slice of texts are merged together: each word is a row of
contiguous arrays, its parts and the ranks of adjacent parts. Again and again the least rank
of each row is found, the boundary there deleted, and the two neighbouring ranks are looked
up anew, until no adjacent parts have a rank. Rows stand with others of about their length,
so padding is bounded. A word of more than ``SHORT`` parts, where scanning would be
quadratic, merges by a heap of ranks over linked parts, with the same result.

No shuffle: a text is encoded where it is read, and its size is all that a task holds.

Defined results: a null or empty text has no tokens (an empty array) and decodes to ''.
Special tokens written out in a text are those tokens, as the library has it by default. Decoding takes null
as an empty array, and leaves out ids without a token, and nulls. Other columns are kept, and
tables may be empty; the column added replaces one of its name, whatever its case.
"""

from __future__ import annotations

import heapq
import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import text_slices

SHORT = 64
NO_RANK = np.int32(2**31 - 1)
_KNOWN, _LONG = 1 << 18, 48  # words kept by a worker, and bytes of the longest
_BELOW = 0x180  # these signs are their own normal form, and so are their lower cases but for U+0130's, which the library splits in the same places
_BELOW_BYTE = 0xC6  # the first byte of U+0180 and what follows is this or more


def _splitter() -> re.Pattern:
    signs = [chr(i) for i in range(_BELOW)]
    members = lambda kind: "".join(re.escape(c) for c in signs if unicodedata.category(c)[0] == kind)
    letter, number, blank = members("L"), members("N"), "\\t-\\r \\x85\\xa0"
    return re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{letter}]+|[{number}]|[^{letter}{number}{blank}]+")


_SPLIT = _splitter()


def default_tokenizer() -> str:
    import public_tokenizers as P

    return P.path("word_bpe_49k.json")


def byte_signs() -> list[str]:
    """The sign that stands for each byte in such vocabularies: itself if printable, else the next free one from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Merges:
    """Ids of initial parts, and ranks of adjacent parts, of a vocabulary file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.signs = byte_signs()
        self.plain = {ord(s): chr(b) for b, s in enumerate(self.signs)}
        self.inner = np.array([vocab[s] for s in self.signs], np.int32)
        self.last = np.array([vocab[s + end] for s in self.signs], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        library = Tokenizer.from_file(path)
        self.normal, self.split = library.normalizer, library.pre_tokenizer

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of parts; NO_RANK where they don't merge, or one of them is -1."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.ranks[at], NO_RANK)

    def words(self, raw: np.ndarray) -> list[str]:
        """A text's words; special tokens stand among them as they are written."""
        text = raw.tobytes().decode("utf-8", "replace")
        out: list[str] = []
        for piece in self.cut.split(text) if self.cut and "<|" in text else [text]:
            if piece in self.special:
                out.append(piece)
            elif not len(raw) or raw.max() < _BELOW_BYTE:
                out += _SPLIT.findall(piece.lower())
            else:
                found = self.split.pre_tokenize_str(self.normal.normalize_str(piece))
                out += [word.translate(self.plain).encode("latin-1").decode() for word, _ in found]
        return out

    def first_parts(self, word: bytes) -> np.ndarray:
        raw = np.frombuffer(word, np.uint8)
        ids = self.inner[raw]
        ids[-1] = self.last[raw[-1]]
        return ids

    def merged(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(start, ids): word i's ids are ids[start[i]:start[i + 1]]."""
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        counts, parts = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        low = 0
        while low < len(order) and size[order[low]] <= SHORT:
            width = max(4, 1 << (int(size[order[low]]) - 1).bit_length())  # rows of one array differ in length by less than half
            high = min(int(np.searchsorted(size[order], width, "right")), low + 65_536)
            rows = self._scanned([words[i] for i in order[low:high]], width)
            counts.append((rows >= 0).sum(1))
            parts.append(rows[rows >= 0])
            low = high
        for i in order[low:]:
            parts.append(self._heaped(self.first_parts(words[i])))
            counts.append(np.array([len(parts[-1])]))
        n, ids = np.empty(len(words), np.int64), np.concatenate(parts)
        n[order] = (count := np.concatenate(counts))
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(count) - count
        start = np.concatenate([[0], np.cumsum(n)])
        return start, _taken(ids, begin, n)

    def _scanned(self, words: list[bytes], width: int) -> np.ndarray:
        """A row of ids for each word, filled up with -1."""
        n = len(words)
        size = np.array([len(w) for w in words])
        inside = np.arange(width) < size[:, None]
        raw = np.frombuffer(b"".join(words), np.uint8)
        parts = np.full((n, width + 1), -1, np.int32)
        parts[:, :width][inside] = self.inner[raw]
        parts[np.arange(n), size - 1] = self.last[raw[np.cumsum(size) - 1]]
        ranks = self.rank(parts[:, :-1], parts[:, 1:])
        live = np.arange(n)
        while len(live):
            at = ranks[live].argmin(1)
            best = ranks[live, at]
            some = best != NO_RANK
            live, at, best = live[some], at[some], best[some]
            if not len(live):
                break
            # Delete the boundary behind ``at``: what lies behind moves up by one.
            place = np.arange(width + 1)
            moved = np.minimum(place + (place > at[:, None]), width)
            row = parts[live[:, None], moved]
            row[np.arange(len(live)), at] = self.made[best]
            parts[live] = row
            near = ranks[live[:, None], moved[:, :width].clip(max=width - 1)]
            near[:, -1] = NO_RANK
            k = np.arange(len(live))
            near[k, at] = self.rank(row[k, at], row[k, at + 1])
            left = at > 0
            near[k[left], at[left] - 1] = self.rank(row[k[left], at[left] - 1], row[k[left], at[left]])
            ranks[live] = near
        return parts

    def _heaped(self, ids: np.ndarray) -> np.ndarray:
        """The same for a long word: ranks in a heap, parts in linked order; an entry whose parts have changed is stale."""
        parts, n = ids.tolist(), len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        told: dict[tuple[int, int], int] = {}

        def rank(a: int, b: int) -> int:
            if (a, b) not in told:
                told[a, b] = int(self.rank(np.array([a]), np.array([b]))[0])
            return told[a, b]

        first = self.rank(ids[:-1], ids[1:])
        heap = [(int(first[i]), int(i), parts[i], parts[i + 1]) for i in np.flatnonzero(first != NO_RANK)]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j < 0 or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = int(self.made[r]), -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank(parts[x], parts[y])) != NO_RANK:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([p for p in parts if p >= 0], np.int32)


def _taken(ids: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs of ``n`` ids from ``begin``, one behind the other."""
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.arange(total) + np.repeat(begin - (ends - n), n)]


class Encoder:
    """Ids of texts; words met before are looked up."""

    def __init__(self, path: str):
        self.merges = Merges(path)
        special = self.merges.special
        self.known = {s: k for k, s in enumerate(special)}
        self.start, self.ids = np.arange(len(special) + 1), np.array([*special.values()], np.int32)
        self.fixed = len(special)

    def _forget(self, used: np.ndarray) -> None:
        """Keeps the special tokens and the words of the last slice, in which frequent ones are."""
        keep = np.zeros(len(self.start) - 1, bool)
        keep[: self.fixed] = True
        keep[used] = True
        place = np.cumsum(keep) - 1
        self.known = {w: int(place[k]) for w, k in self.known.items() if keep[k]}
        n = np.diff(self.start)[keep]
        self.ids = _taken(self.ids, self.start[:-1][keep], n)
        self.start = np.concatenate([[0], np.cumsum(n)])

    def __call__(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): text i's ids are ids[offsets[i]:offsets[i + 1]]."""
        known = self.known
        split = [self.merges.words(raw[a:b]) for a, b in itertools.pairwise(offsets)]
        words = list(itertools.chain.from_iterable(split))
        new = sorted({w for w in words if w not in known}, key=len)  # short ones first: those are kept
        base, start, ids = len(known), self.start, self.ids
        if new:
            coded = [w.encode() for w in new]
            more, more_ids = self.merges.merged(coded)
            start, ids = np.concatenate([start, start[-1] + more[1:]]), np.concatenate([ids, more_ids])
            known.update(zip(new, range(base, base + len(new)), strict=True))
        at = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        n = start[at + 1] - start[at]
        out = _taken(ids, start[at], n)
        short = base + next((k for k, w in enumerate(new) if len(w) > _LONG), len(new))
        for w in new[short - base :]:
            del known[w]
        self.start, self.ids = start[: short + 1], ids[: start[short]]
        if len(known) > _KNOWN:
            self._forget(at[at < short])
        of_text = np.concatenate([[0], np.cumsum([len(ws) for ws in split])]).astype(np.int64)
        return np.concatenate([[0], np.cumsum(n)])[of_text], out


def _with(df: DataFrame, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    keep = [f for f in df.schema if f.name.lower() != name.lower()]
    return [f.name for f in keep], T.StructType([*keep, T.StructField(name, kind)])


def _added(df: DataFrame, column: str, name: str, kind: T.DataType, make) -> DataFrame:
    """``df`` with one more column, made from ``column`` by ``make()(array)`` in tasks."""
    names, schema = _with(df, name, kind)
    places = [df.columns.index(n) for n in names]
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for low, high, values in each(batch.column(at)):
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in places), values], names=[*names, name])

    return df.toDF(*(f"c{i}" for i in range(len(df.columns)))).mapInArrow(run, schema)  # its names are looked up as they are, dots and all


def bpe_encode(df: DataFrame, *, text_col: str = "text", out_col: str = "token_ids", tokenizer: str | None = None) -> DataFrame:
    """``df`` with ``out_col`` (array<int>): the ids of ``text_col``."""
    path = tokenizer or default_tokenizer()

    def make():
        encode = Encoder(path)

        def each(column: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
            for low, high, raw, off in text_slices(column):
                offsets, ids = encode(raw, off)
                yield low, high, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))

        return each

    return _added(df, text_col, out_col, T.ArrayType(T.IntegerType()), make)


def bpe_decode(df: DataFrame, *, ids_col: str = "token_ids", out_col: str = "decoded", tokenizer: str | None = None) -> DataFrame:
    """``df`` with ``out_col``: the tokens of ``ids_col`` joined by a blank, as the library decodes a vocabulary without decoder."""
    path = tokenizer or default_tokenizer()

    def make():
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        named = {**{i: t for t, i in spec["model"]["vocab"].items()}, **{t["id"]: t["content"] for t in spec["added_tokens"]}}
        tokens = pa.array([named.get(i) for i in range(max(named) + 1)], pa.large_string())

        def each(column: pa.Array) -> Iterator[tuple[int, int, pa.Array]]:
            size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            ends = np.cumsum(size)
            low = 0
            while low < len(column):  # about a million tokens at a time
                begin = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, begin + (1 << 20), "right")))
                ids = flat.slice(begin, int(ends[high - 1]) - begin)
                good = pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(tokens)))
                text = pc.take(tokens, pc.if_else(good, ids, pa.scalar(None, ids.type)))
                offsets = np.concatenate([[0], ends[low:high] - begin])
                yield low, high, pc.binary_join(_dense(text, offsets), pa.scalar(" ", pa.large_string())).cast(pa.string())
                low = high

        return each

    return _added(df, ids_col, out_col, T.StringType(), make)


def _dense(values: pa.Array, offsets: np.ndarray) -> pa.LargeListArray:
    """Lists by offsets, without their nulls."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if values.null_count:
        there = np.concatenate([[0], np.cumsum(values.is_valid().to_numpy(zero_copy_only=False))])
        values, offsets = values.drop_null(), there[offsets]
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)
