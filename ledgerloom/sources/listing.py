"""Listings of stores as a data source that Spark plans by ranges of keys, prunes by filters and reads side by side.

A store that can list from a key on (``Store.ranged``) is cut into ranges of about equally
many objects. Where the last run's catalog is given, a sample of its keys holds the cuts.
Otherwise the reader asks the store for single pages between known keys: a page tells how dense its keys lie,
an empty stretch shrinks its range, and what is thought to hold most is halved next. A bad estimate makes
ranges uneven, never wrong: ranges cover all keys, each once.

Filters on source, key, size and time are applied where rows are read. Those on the source
leave out whole stores, and prefixes or bounds of the key leave out ranges and pages. A read
that fails goes on behind the last key it gave, as long as it gets further between failures.

Defined results: LISTING's columns and list_error. A store, or a range of it, that can't be listed to
its end gives the rows it has and one more without a key, which holds the error; that row
passes no filter but one on the source. A store without objects has no rows.
"""

from __future__ import annotations

import bisect
import itertools
import math
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as DS
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, MapType, StringType, StructField, StructType

from ..schema import LISTING
from .stores import Store

Factory = Callable[[], dict[str, Store]]
SCHEMA = StructType([*LISTING, StructField("list_error", StringType())])
FIELDS = [f.name for f in LISTING if f.name != "source"]
_ARROW = [pa.map_(pa.string(), pa.string()) if isinstance(f.dataType, MapType) else pa.int64() if isinstance(f.dataType, LongType) else pa.string() for f in SCHEMA]
_DIGITS = 9
BATCH, PAGE = 10_000, 1000


@dataclass
class KeyRange(DS.InputPartition):
    """Keys of one store behind ``after``, up to ``upto`` and with it; None: to the end."""

    source: str
    after: str = ""
    upto: str | None = None


def _common(a: str, b: str) -> int:
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


class Scale:
    """Numbers for keys, growing with them: the characters behind the first ``skip`` as digits of the alphabets that some keys show there."""

    alphabets = ("0123456789", "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz", "".join(map(chr, range(32, 127))))

    def __init__(self, keys: Sequence[str], skip: int):
        self.skip, self.digits = skip, []
        for i in range(skip, skip + _DIGITS):
            seen = {k[i] for k in keys if len(k) > i}
            if not seen:
                break
            self.digits.append(next((a for a in self.alphabets if seen <= set(a)), self.alphabets[-1]))

    def place(self, key: str) -> int:
        n, over = 0, 0  # over: -1 or 1 once a character lies outside its alphabet, so that what follows doesn't matter
        for i, alphabet in enumerate(self.digits):
            c = key[self.skip + i : self.skip + i + 1]
            over = over or (-1 if c < alphabet[0] else 1 if c > alphabet[-1] else 0)
            n = n * len(alphabet) + (0 if over < 0 else len(alphabet) - 1 if over > 0 else min(bisect.bisect_left(alphabet, c), len(alphabet) - 1))
        return n

    def key(self, place: int, head: str) -> str:
        signs = []
        for alphabet in reversed(self.digits):
            place, c = divmod(place, len(alphabet))
            signs.append(alphabet[c])
        return head + "".join(reversed(signs))


class Stretch:
    """Keys behind ``after`` up to ``upto`` (None: open), with the page that follows ``after``; ``count``: how many there may be."""

    def __init__(self, after: str, upto: str | None, page: list[str], full: int):
        self.after, self.upto = after, upto
        inside = page if upto is None else page[: bisect.bisect_right(page, upto)]
        self.page, self.known = inside, len(inside) < len(page) or len(page) < full
        self.count, self.middle = float(len(inside)), None
        if not inside or self.known:
            return
        end, last = "\U0010ffff" if upto is None else upto, inside[-1]
        skip, deep = _common(last, end), _common(inside[0], last)
        scale = Scale(inside, min(skip, deep))
        # The page's later half tells the density: it borders on what is unknown.
        later = inside[len(inside) // 2 :]
        low, now, high = (scale.place(k) for k in (later[0], last, end))
        self.count = len(inside) + len(later) * max(0.0, (high - now) / max(1, now - low))
        beyond = last[: scale.skip] + chr(ord(scale.digits[0][-1]) + 1) if scale.digits else end
        if deep - skip > 1:
            # The page lies below one prefix, deeper than the stretch's own: leave what shares half of the surplus.
            half = (skip + deep) // 2
            middle = last[:half] + chr(min(ord(last[half]) + 1, 0x10FFFF))
        elif last < beyond < end:
            middle = beyond  # keys of another alphabet come first: the scale can't see them
            self.count = math.inf
        else:
            middle = scale.key((now + high) // 2, last[: scale.skip])
        if last < middle < end and not 0xD800 <= ord(middle[-1]) < 0xE000:
            self.middle = middle


def probed_cuts(page: Callable[[str], list[str]], parts: int, full: int, requests: int) -> list[str]:
    """Keys that cut a store into ``parts`` ranges, from at most so many ``requests`` of pages of ``full`` keys behind a key."""
    stretches = [Stretch("", None, page(""), full)]
    if stretches[0].known:
        return []  # one page is the whole store
    asked = 1
    while asked < requests:
        open_ones = [s for s in stretches if s.middle is not None]
        if not open_ones:
            break
        s = max(open_ones, key=lambda s: s.count)
        mid = s.middle
        found = page(mid)
        asked += 1
        left = Stretch(s.after, mid, s.page, full)
        # Nothing lies between ``mid`` and the page's first key: the right part begins there.
        right = Stretch(mid, s.upto, found, full)
        i = stretches.index(s)
        stretches[i : i + 1] = [left, right] if right.page else [left]
    # Pages inside a stretch refine it: each of its keys is a place to cut at.
    marks: list[tuple[float, str]] = []
    total = 0.0
    for s in stretches:
        if s.page:
            step = max(1, len(s.page) // 16)
            for k in range(step - 1, len(s.page), step):
                marks.append((total + k + 1, s.page[k]))
            total += s.count if s.count < math.inf else len(s.page)
            if s.upto is not None:
                marks.append((total, s.upto))
    return _spread(marks, total, parts)


def _spread(marks: list[tuple[float, str]], total: float, parts: int) -> list[str]:
    """Of places with the number of keys before them, those nearest to equal shares."""
    marks = [m for m in marks if m[0] < total]
    cuts, at = [], [m for m, _ in marks]
    for k in range(1, parts):
        want = total * k / parts
        i = bisect.bisect_left(at, want)
        near = min((j for j in (i - 1, i) if 0 <= j < len(marks)), key=lambda j: abs(at[j] - want), default=None)
        if near is not None and (not cuts or marks[near][1] > cuts[-1]):
            cuts.append(marks[near][1])
    return cuts


def sampled_cuts(sample: Sequence[str], parts: int) -> list[str]:
    """Keys that cut a sample into equal shares."""
    keys = sorted(set(sample))
    return _spread([(k + 1.0, key) for k, key in enumerate(keys)], float(len(keys)), parts)


_COMPARE = {
    DS.EqualTo: lambda a, b: a == b, DS.GreaterThan: lambda a, b: a > b, DS.GreaterThanOrEqual: lambda a, b: a >= b, DS.LessThan: lambda a, b: a < b, DS.LessThanOrEqual: lambda a, b: a <= b,
    DS.In: lambda a, b: a in b, DS.StringStartsWith: lambda a, b: a.startswith(b),
}
_PUSHED = ("source", "key", "size_bytes", "last_modified")


class Reader(DS.DataSourceReader):
    pause_s = 0.1

    def __init__(self, names: Sequence[str], factory: Factory, parts: int, samples: dict[str, list[str]], page: int, retries: int):
        self.names, self.factory, self.parts, self.samples, self.page, self.retries = sorted(set(names)), factory, parts, samples, page, retries
        self.filters: list[DS.Filter] = []

    def pushFilters(self, filters: list[DS.Filter]) -> Iterator[DS.Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, DS.IsNotNull) and f.attribute == ("source",):
                continue
            value = getattr(f, "value", None)
            if type(f) in _COMPARE and len(f.attribute) == 1 and f.attribute[0] in _PUSHED and value is not None:
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, column: str, value: object) -> bool:
        """Whether a column's value passes all filters on it."""
        own = [f for f in self.filters if f.attribute == (column,)]
        return all(value is not None and _COMPARE[type(f)](value, f.value) for f in own)

    def _bounds(self) -> tuple[str, str | None]:
        """(after, upto): keys outside pass no filter."""
        low, high = "", None
        for f in (f for f in self.filters if f.attribute == ("key",)):
            values = f.value if isinstance(f, DS.In) else (f.value,)
            if not isinstance(f, (DS.LessThan, DS.LessThanOrEqual)):
                first = min(values, default="")
                # Behind the greatest key below the first one, as far as one can be written down.
                low = max(low, first[:-1] + chr(ord(first[-1]) - 1) + "\U0010ffff" if first and first[-1] not in "\0" else "")
            if not isinstance(f, (DS.GreaterThan, DS.GreaterThanOrEqual)):
                last = max(values, default="") + ("\U0010ffff" * 8 if isinstance(f, DS.StringStartsWith) else "")
                high = last if high is None else min(high, last)
        return low, high

    def partitions(self) -> list[DS.InputPartition]:
        names = [n for n in self.names if self._wanted("source", n)]
        if not names:
            return [KeyRange("")]
        stores, (low, high) = self.factory(), self._bounds()
        out: list[DS.InputPartition] = []
        for n in names:
            cuts: list[str] = []
            if stores[n].ranged and self.parts > 1:
                sample = self.samples.get(n) or []
                if len(sample) >= 2 * self.parts:
                    cuts = sampled_cuts([k for k in sample if low < k and (high is None or k <= high)], self.parts)
                else:
                    cuts = self._probed(stores[n], low, high)
            ends = [low, *(c for c in cuts if low < c and (high is None or c < high)), high]
            out += [KeyRange(n, a, b) for a, b in itertools.pairwise(ends)]
        return out

    def _probed(self, store: Store, low: str, high: str | None) -> list[str]:
        def page(after: str) -> list[str]:
            return [r["key"] for r in itertools.islice(store.list(max(low, after), high), self.page)]

        try:
            return probed_cuts(page, self.parts, self.page, 12 * self.parts)
        except Exception:  # noqa: BLE001  what is wrong with the store shows, as a row, when it is read
            return []

    def _rows(self, part: KeyRange) -> Iterator[tuple]:
        after, failures, ranged = part.after, 0, False
        while True:
            begun = after
            try:
                store = self.factory()[part.source]
                ranged = store.ranged
                for row in store.list(after, part.upto) if ranged else store.list():
                    after = row["key"]
                    if all(self._wanted(c, row[c]) for c in _PUSHED[1:]):
                        yield (part.source, *(row[f] for f in FIELDS), None)
                return
            except Exception as e:  # noqa: BLE001  any failure that lasts is a row
                failures = 1 if after > begun else failures + 1
                if not ranged or failures > self.retries:
                    if all(self._wanted(c, None) for c in _PUSHED[1:]):
                        yield (part.source, *(None for _ in FIELDS), f"{type(e).__name__}: {e}")
                    return
                time.sleep(self.pause_s * 2**failures)

    def read(self, partition: KeyRange) -> Iterator[pa.RecordBatch]:
        rows = self._rows(partition) if partition.source else iter(())
        while batch := list(itertools.islice(rows, BATCH)):
            cols = [[[*v.items()] if isinstance(v, dict) else v for v in c] for c in zip(*batch, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _ARROW, strict=True)], names=SCHEMA.names)


def key_samples(catalog: DataFrame, names: Sequence[str], most: int) -> dict[str, list[str]]:
    """At most ``most`` keys of each store, drawn by hash: the same ones from the same catalog."""
    out = {}
    for n in sorted(set(names)):  # of configuration, few
        drawn = catalog.where(F.col("source") == n).select("key").orderBy(F.xxhash64("key"), "key").limit(most)
        out[n] = [r.key for r in drawn.collect()]
    return out


def store_listing(spark: SparkSession, names: Sequence[str], factory: Factory, *, parts: int | None = None, known: DataFrame | None = None, page: int = PAGE, retries: int = 3) -> DataFrame:
    """LISTING and list_error of the named stores, each in ``parts`` ranges (all cores' number). ``known``: a catalog whose keys say where to cut."""
    parts = parts or max(1, spark.sparkContext.defaultParallelism)
    samples = {} if known is None or parts == 1 else key_samples(known, names, 64 * parts)

    class Stores(DS.DataSource):
        @classmethod
        def name(cls) -> str:
            return "object_stores"

        def schema(self) -> StructType:
            return SCHEMA

        def reader(self, schema: StructType) -> DS.DataSourceReader:
            return Reader(names, factory, parts, samples, page, retries)

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # the reader takes filters
    spark.dataSource.register(Stores)
    return spark.read.format("object_stores").load()
