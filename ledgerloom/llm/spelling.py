"""Spelling variants of a corpus's words, by rolling-hash deletion keys.

Words are counted in each task first, and their sums are the vocabulary. Two words are near
if one code point inserted, deleted or replaced makes one of the other. So each word takes
keys for itself, for each string that lacks one of its code points, and for each pattern in
which one of them is open: two words are near just if one's own string is another's
deletion, or if both fit one pattern. All keys of a slice of words are made at once by numpy,
from polynomial hashes of prefixes and suffixes, 64 bits each.

Keys are dealt out by their leading bits and sorted, so equal ones lie side by side, and only those
that words share go on: a long word makes many keys, but its text moves only with keys that
meet another's. There the words are looked up and the meeting is settled on the strings themselves, so two
strings of one hash do no harm.

No pairs are made. A deletion's string is met by at most one word of its own, and a pattern's
words differ in one code point, so at most 90 fit it: each word takes the number of
others and the best of them from a window over the string. Links from a word to its form go
up by a factor of ``ratio`` at each step, so roots come from a few rounds of pointer jumping.

Defined results: a null text has no words; a null id is written as nothing in front of the colon
that the planted misspellings are drawn by. Repeated rows count again. A text's words are
runs over its whole length; only runs that can leave ``min_chars`` code points are looked at.
Ties of n go to the smaller word in code-point order. Only the two columns named are read, so
names can't clash; an empty table has no words. A word of millions of code points costs its
own keys and no more.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import Scratch
from .text import U64, _BASE, _Powers, inverse, mix

RUN = "[a-zÀ-ÿ]"
OPEN = "\x01"  # stands for the open place of a pattern; no word holds it
WHOLE, DELETION, PATTERN = 0, 1, 2
_OPEN_CODE = U64(0x5851F42D4C957F2D)
_FLUSH = 200_000  # different words that a task holds before it passes their counts on


def count_words(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, planted: int = 31) -> DataFrame:
    """word, n: runs of letters with A-Z lower-cased, of ``min_chars`` code points and more.

    One in ``planted`` pairs of document and run loses a code point, drawn by crc32 of
    ``<id>:<run>``; 0 plants none.
    """
    runs = re.compile(f"{RUN}{{{min_chars},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([*held], pa.string()), pa.array([*held.values()], pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                if not text.is_valid:
                    continue
                begin = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(runs.findall(text.as_py().lower().decode("utf-8", "replace"))).items():  # lower() of bytes is A-Z alone
                    h = zlib.crc32(word.encode(), begin)
                    if planted and h % planted == 0:
                        p = h % len(word)
                        word = word[:p] + word[p + 1 :]
                        if len(word) < min_chars:
                            continue
                    held[word] += n
                if len(held) > _FLUSH:
                    yield flush()
        if held:
            yield flush()

    counted = docs.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word's index, kind, place, key) of all keys of ``words``; a deletion that gives the same string as the next one is left out."""
    size = np.array([len(w) for w in words], np.int64)
    code = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(U64)
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - first[word]
    _Powers.upto(int(size.max(initial=0)))
    up = _Powers.up[place]
    term = mix(code + U64(1)) * up
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(term, dtype=U64)])
    base = sums[first]
    total = sums[first + size] - base
    prefix, suffix = sums[:-1] - base[word], total[word] + base[word] - sums[1:]
    back = U64(inverse(int(_BASE)))
    deletion = mix(prefix + suffix * back)
    pattern = mix(prefix + _OPEN_CODE * up + suffix)
    following = np.concatenate([code[1:], np.zeros(1, U64)])
    last = place == size[word] - 1
    kept = last | (code != following)
    n = len(words)
    kinds = np.concatenate([np.full(n, WHOLE), np.full(int(kept.sum()), DELETION), np.full(len(code), PATTERN)])
    places = np.concatenate([np.zeros(n, np.int64), place[kept], place])
    return np.concatenate([np.arange(n), word[kept], word]), kinds, places, np.concatenate([mix(total), deletion[kept], pattern])


def keys(words: DataFrame) -> DataFrame:
    """key, id, kind, place for ``words`` (id, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            size = np.cumsum([len(w) for w in text])
            low = 0
            while low < len(text):  # slices of about 100,000 code points, a longer word alone
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + 100_000, "right")))
                of, kind, place, key = deletion_keys(text[low:high])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[low:high][of]), pa.array(kind, pa.int32()), pa.array(place, pa.int32())], names=["key", "id", "kind", "place"])
                low = high

    return words.select("id", "word").mapInArrow(run, "key long, id long, kind int, place int")


def shared_keys(keyed: DataFrame, radix_bits: int = 16) -> DataFrame:
    """id, kind, place of the keys under which words can meet: a whole word with deletions, or several patterns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(cols: list[np.ndarray]) -> pa.RecordBatch:
            key, ids, kind, place = cols
            new = np.concatenate([np.ones(1, bool), key[1:] != key[:-1]])[: len(key)]
            group = np.cumsum(new) - 1
            n = lambda k: np.bincount(group[kind == k], minlength=int(new.sum()))
            whole, deleted, fit = n(WHOLE), n(DELETION), n(PATTERN)
            keep = np.where(kind == PATTERN, fit[group] > 1, (whole[group] > 0) & (deleted[group] > 0))
            return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(kind[keep]), pa.array(place[keep])], names=["id", "kind", "place"])

        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [c.to_numpy() for c in batch.columns]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            # The last key may go on in the next batch.
            end = int(np.searchsorted(cols[0], cols[0][-1], "left")) if len(cols[0]) else 0
            rest = [c[end:] for c in cols]
            if end:
                yield met([c[:end] for c in cols])
        if rest is not None and len(rest[0]):
            yield met(rest)

    radix = F.shiftright("key", 64 - radix_bits)
    dealt = keyed.withColumn("radix", radix).repartition("radix").sortWithinPartitions("key")
    return dealt.select("key", "id", "kind", "place").mapInArrow(run, "id long, kind int, place int")


def near_words(words: DataFrame) -> DataFrame:
    """id, n_near and best (less: -n, word) for those of ``words`` (id, word, n) that have a near word."""
    met = shared_keys(keys(words)).join(words, "id")
    before, behind = F.substring("word", F.lit(1), F.col("place")), F.substring("word", F.col("place") + 2, F.length("word"))
    string = F.when(F.col("kind") == WHOLE, F.col("word")).when(F.col("kind") == DELETION, F.concat(before, behind)).otherwise(F.concat(before, F.lit(OPEN), behind))
    met = met.select("id", "kind", string.alias("string"), F.struct((-F.col("n")).alias("less"), "word").alias("me"))
    same, own = W.partitionBy("string"), F.col("me")
    of = lambda kind: F.when(F.col("kind") == kind, own)
    met = met.select(
        "id", "kind", "me", "string", F.max(of(WHOLE)).over(same).alias("whole"), F.min(of(DELETION)).over(same).alias("longer"), F.min(of(PATTERN)).over(same).alias("first"),
        F.count_if(F.col("kind") == DELETION).over(same).alias("n_longer"), F.count_if(F.col("kind") == PATTERN).over(same).alias("n_fit"),
    )
    met = met.withColumn("second", F.min(F.when((F.col("kind") == PATTERN) & (own != F.col("first")), own)).over(same))
    kind = F.col("kind")
    n = F.when(kind == WHOLE, F.col("n_longer")).when(kind == DELETION, F.col("whole").isNotNull().cast("long")).otherwise(F.col("n_fit") - 1)
    best = F.when(kind == WHOLE, F.col("longer")).when(kind == DELETION, F.col("whole")).when(own == F.col("first"), F.col("second")).otherwise(F.col("first"))
    return met.select("id", n.alias("n"), best.alias("best")).groupBy("id").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root for ``forms`` (word, form): where following forms ends. Every round doubles the steps taken."""
    links = scratch.table(forms.select("word", F.col("form").alias("root")), "links")
    while True:
        old = scratch.last
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = scratch.table(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        scratch.drop(old)
        if links.where("moved").isEmpty():
            return links.select("word", "root")
        links = links.drop("moved")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 7, min_count: int = 2, ratio: int = 10, planted: int = 31) -> DataFrame:
    """word, n, n_near, form, form_n, root: one row per word of ``min_count`` occurrences and more.

    ``form``: the near word of largest n, if that is at least ``ratio`` (2 and more) times the word's own.
    """
    if ratio < 2:
        raise ValueError("forms must be more frequent than their variants")
    scratch = Scratch(docs.sparkSession, "spelling")
    counted = count_words(docs, id_col=id_col, text_col=text_col, min_chars=min_chars, planted=planted)
    # Written, so that every scan sees the same numbers.
    words = scratch.table(counted.where(F.col("n") >= min_count).withColumn("id", F.monotonically_increasing_id()), "words")
    good = -F.col("best.less") >= ratio * F.col("n")
    out = words.join(near_words(words), "id", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"),
    )
    out = scratch.table(out, "variants")
    roots = _roots(out.where("form IS NOT NULL"), scratch)
    return out.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
