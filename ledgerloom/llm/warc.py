"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing. Payloads are compared by SHA-1 and length. Of equal payloads of ``min_bytes`` and
more the row with the smallest id becomes a response, the others revisit it. Records are
composed as strings and written by Spark's text sink, whose line separator is the blank
line that ends a WARC record; so any store that Spark writes will do. Only digests that
occur more than once are joined back to the pages, by broadcast below Spark's threshold.

Reading. Files are scanned in splits, cut at the magic; no file and no split is held whole.
A task emits each piece's offset and, where the piece begins like a record, the offset that
its length announces for the successor. Magic inside a payload makes pieces that look like
records too, and magic inside a head (a url may hold it) cuts the head: the length and the
blank line are then sought in the following pieces, and where a head runs over the end of its
split, in the summaries of the splits after it. Which are real is decided by the chain from the file's start: pointer jumping
inside each split (in numpy) leads from every candidate to where its chain leaves the split,
and pointer jumping over splits (joins, doubling the stride each round) finds where the
chain of the file's start enters each split. Records off that chain are dropped. A real
record that magic had cut is put together from its pieces in a second scan, which runs only
if there is one.

Defined results: null html is an empty payload, null url has no target line. Rows with null
id revisit an equal payload's smallest id, or are responses if all its ids are null; rows
that repeat the smallest id are responses. Control characters in a url are percent-encoded.
A chain that a damaged record breaks ends there: what follows in its file is not returned.
No rows write no records and read as no rows. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

MAGIC = "WARC/1."
END = "\r\n\r\n"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PIECES = "file string, block long, off long, next long, exit long, whole boolean, covers long, open boolean, told long, blank long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean"


def base32_sha1(text: Column) -> Column:
    """Five hexadecimal digits are four of base 32."""
    h = F.sha1(text)
    parts = [F.lpad(F.conv(F.substring(h, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def write_warc(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes one record for each row, in files of about the input's partitions."""
    scratch = Scratch(pages.sparkSession, "warc-write")
    body = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("body"))
    body = body.withColumn("n", F.octet_length("body").cast("long")).withColumn("digest", base32_sha1(F.col("body")))
    often = body.where(F.col("n") >= min_bytes).groupBy("digest", "n").agg(F.min("id").alias("lead"), F.count("*").alias("c")).where("c > 1").select("digest", "n", "lead")
    often = scratch.table(often, "repeated")
    rows = body.join(often, ["digest", "n"], "left").withColumn("revisit", F.col("lead").isNotNull() & ~F.coalesce(F.col("id") == F.col("lead"), F.lit(False)))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit(END))
    block = F.when(F.col("revisit"), http).otherwise(F.concat(http, F.col("body")))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))  # noqa: E731  a null value leaves the line out
    url = F.col("url")
    for c in [*map(chr, range(32)), "\x7f"]:
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    record = F.concat(
        F.lit(f"{MAGIC}1\r\n"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("none")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.when(F.col("revisit"), "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        line("WARC-Refers-To", F.when(F.col("revisit"), F.concat(F.lit("<urn:page:"), F.col("lead").cast("string"), F.lit(">")))),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    rows.select(record.alias("value")).write.option("lineSep", END).text(path)


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*(?=\r\n)", re.I)


_VERSIONS = (b"1\r\n", b"0\r\n")


def _header(head: bytes, name: bytes) -> str | None:
    m = re.search(rb"\r\n" + name + rb":[ \t]*([^\r\n]*)", head, re.I)
    return m[1].decode("utf-8", "replace") if m else None


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def _facts(value: bytes, head_end: int, length: int) -> tuple:
    """page_id, url, type, refers_to, payload bytes and digest, whether the digest is the announced one."""
    head, block = value[:head_end], value[head_end + 4 : head_end + 4 + length]
    kind, told = _header(head, b"warc-type"), (_header(head, b"warc-payload-digest") or "").removeprefix("sha1:")
    cut = block.find(b"\r\n\r\n")
    payload = block[cut + 4 :] if cut >= 0 else block
    if kind == "revisit":
        m = _LENGTH.search(block[: cut + 2]) if cut >= 0 else None
        n, digest = int(m[1]) if m else 0, told
    else:
        n, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return _page(_header(head, b"warc-record-id")), _header(head, b"warc-target-uri"), kind, _page(_header(head, b"warc-refers-to")), n, digest, digest == told


def _announced(value: bytes) -> tuple[int, int] | None:
    """(end of the head, length of the block) if the piece after the magic begins like a record."""
    if value[:3] not in _VERSIONS:
        return None
    end = value.find(b"\r\n\r\n")
    m = _LENGTH.search(value[: end + 2]) if end >= 0 else None
    return (end, int(m[1])) if m else None


def _exits(off: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Where each candidate's chain leaves the split: the stride doubles until no pointer moves."""
    n = len(off)
    to = np.minimum(np.searchsorted(off, following), max(0, n - 1))
    inside = (off[to] == following) if n else np.zeros(0, bool)
    jump = np.where(inside, to, np.arange(n))
    while n and (jump[jump] != jump).any():
        jump = jump[jump]
    return following[jump]


def _scan(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], int, bytes, bool]]:
    """(split, offset inside it, bytes after the magic, whether it has magic), in order."""
    at, off = None, 0
    for batch in batches:
        for f, b, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            v = v.as_py()
            magic = True
            if (f, b) != at:
                at, off = (f, b), 0
                magic = b != 0  # a file's first piece comes before any magic
            yield at, off, v, magic
            off += len(v) + len(MAGIC) * magic


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in PIECES.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}

    def rows_of(split: tuple[str, int], rows: list[list], covers: int, lead: int | None, blank: int | None, heads: list[list]) -> pa.RecordBatch:
        for r in heads:
            r[3], r[5] = False, True
        real = [r for r in rows if r[1] is not None]
        for r, x in zip(real, _exits(np.array([r[0] for r in real], np.int64), np.array([r[1] for r in real], np.int64)).tolist(), strict=True):
            r[2] = x
        rows.append([-1, None, None, None, covers, None, lead, blank, *[None] * 7])
        cols = zip(*([*split, *r] for r in rows), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(cols, PIECES.split(", "), strict=True)], names=names)

    split, rows, end = None, [], 0
    lead = blank = None  # the first length before the split's first blank line, and where that is
    bare, heads = [], []  # candidates whose head is open: those without a length yet, and all
    for s, off, value, magic in _pieces(batches):
        if s != split:
            if split:
                yield rows_of(split, rows, end, lead, blank, heads)
            split, rows, lead, blank, bare, heads = s, [], None, None, [], []
        skip = len(MAGIC) * magic
        end = off + len(value) + skip
        row = [off, *[None] * 14]
        begins = magic and value[:3] in _VERSIONS
        if magic or value:
            rows.append(row)
        if begins:
            bare.append(row)
            heads.append(row)
        # Neither a blank line nor a line with a length can hold magic, so each stands inside one piece.
        cut = value.find(b"\r\n\r\n")
        if bare or blank is None and lead is None:
            m = _LENGTH.search(value, 0, cut + 2 if cut >= 0 else len(value))
            if m:
                for r in bare:
                    r[6] = int(m[1])
                bare = []
                if blank is None and lead is None:
                    lead = int(m[1])
        if cut < 0:
            continue
        if blank is None:
            blank = off + skip + cut
        for r in heads:
            if r[6] is not None:
                r[1], r[3] = off + skip + cut + 4 + r[6] + len(END), False
        if begins and row[1] is not None and len(value) >= (size := cut + 4 + row[6]):
            row[3], row[8:] = True, _facts(value, size - row[6] - 4, row[6])
        bare, heads = [], []
    if split:
        yield rows_of(split, rows, end, lead, blank, heads)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, url, digest_ok, file, offset."""
    scratch = Scratch(spark, "warc-read")
    pieces = scratch.table(_scan(spark, path).mapInArrow(_index, PIECES), "pieces")
    by_file = Window.partitionBy("file").orderBy("block")
    splits = pieces.where("off < 0").select("file", "block", (F.sum("covers").over(by_file) - F.col("covers")).alias("base"), "told", "blank")
    # For heads that run over a split's end: the next blank line and the next length, which counts if its split is not after the blank line's.
    ahead = by_file.rowsBetween(1, Window.unboundedFollowing)
    later = lambda c: F.first(F.when(F.col(c).isNotNull(), F.struct("block", (F.col(c) + (F.col("base") if c == "blank" else 0)).alias("x"))), True).over(ahead)
    splits = splits.withColumn("stop", later("blank")).withColumn("length", later("told")).select("file", "block", "base", F.col("stop.x").alias("stop"), F.when(F.col("length.block") <= F.col("stop.block"), F.col("length.x")).alias("later"))
    found = pieces.where("off >= 0").join(splits, ["file", "block"])
    for c in ("off", "next", "exit"):
        found = found.withColumn(c, F.col(c) + F.col("base"))
    over = F.when(F.col("open"), F.col("stop") + 4 + F.coalesce("told", "later") + len(END))
    found = found.withColumn("next", F.coalesce("next", over)).withColumn("exit", F.coalesce("exit", over))
    found = scratch.table(found.drop("covers", "open", "told", "blank", "stop", "later"), "candidates")

    # Chains from split to split: only candidates that some chain arrives at, or that begin a file.
    nodes = found.where("next IS NOT NULL").select("file", "off", F.col("exit").alias("to"))
    targets = nodes.select("file", F.col("to").alias("off")).union(nodes.select("file", F.lit(0).cast("long"))).distinct()
    jump = scratch.table(nodes.join(targets, ["file", "off"], "left_semi"), "jumps")
    reached = scratch.table(jump.where("off = 0").select("file", "off"), "reached")
    count = 0
    while (now := reached.count()) != count:
        count = now
        further = reached.join(jump, ["file", "off"]).select("file", F.col("to").alias("off")).join(jump.select("file", "off"), ["file", "off"], "left_semi")
        reached = scratch.table(reached.union(further).distinct(), "reached")
        twice = jump.alias("x").join(jump.alias("y"), (F.col("x.file") == F.col("y.file")) & (F.col("x.to") == F.col("y.off")), "left")
        jump = scratch.table(twice.select("x.file", "x.off", F.coalesce("y.to", "x.to").alias("to")), "jumps")
    entry = reached.join(found.select("file", "off", "block"), ["file", "off"]).groupBy("file", "block").agg(F.min("off").alias("entry"))

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        """Follows the chain from the split's entry; a split's candidates fit in memory, for the split does."""
        pdf = pdf.sort_values("off")
        ahead = dict(zip(pdf["off"], pdf["next"], strict=True))
        at, real = pdf["entry"].iloc[0], set()
        while at in ahead and not pd.isna(at) and at not in real and not pd.isna(ahead[at]):
            real.add(at)
            at = ahead[at]
        return pdf[["file", "block", "off"]].assign(real=pdf["off"].isin(real))

    marked = found.select("file", "block", "off", "next").join(entry, ["file", "block"], "left").groupBy("file", "block").applyInPandas(mark, "file string, block long, off long, real boolean")
    marked = scratch.table(found.join(marked, ["file", "block", "off"]), "marked")
    out = [F.col(c) for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "digest_ok", "file")]
    whole = marked.where("real AND whole").select(*out, F.col("off").alias("offset"))
    if marked.where("real AND NOT whole").isEmpty():
        return whole

    # Pieces of real records that magic had cut: each piece belongs to the last real record before it.
    in_split = Window.partitionBy("file", "block").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    last = marked.where("real").groupBy("file", "block").agg(F.max("off").alias("last"))
    carry = splits.join(last, ["file", "block"], "left").select("file", "block", F.last("last", True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carry"))
    owner = marked.withColumn("own", F.last(F.when(F.col("real"), F.col("off")), True).over(in_split)).join(carry, ["file", "block"], "left")
    owner = owner.select("file", "block", "base", "off", F.coalesce("own", "carry").alias("owner"))
    cut = marked.where("real AND NOT whole").select("file", F.col("off").alias("owner"))
    wanted = scratch.table(owner.join(cut, ["file", "owner"], "left_semi").select("file", "block", (F.col("off") - F.col("base")).alias("off"), F.col("off").alias("abs"), "owner"), "wanted")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (f, b), off, v, magic in _pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([b]), pa.array([off]), pa.array([(MAGIC.encode() if magic else b"") + v], pa.binary())], names=["file", "block", "off", "value"])

    parts = _scan(spark, path).mapInArrow(again, "file string, block long, off long, value binary").join(wanted, ["file", "block", "off"])
    joined = parts.groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("abs", "value"))).alias("p")).select("file", F.col("owner").alias("offset"), F.col("p.value").alias("p"))

    names = whole.columns

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, o, p in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                value = b"".join(p)[len(MAGIC) :]
                page, url, kind, refers, n, digest, ok = _facts(value, *_announced(value))
                cols = [page, n, digest, kind, refers, url, ok, f, o]
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types, strict=True)], names=names)

    return whole.unionByName(joined.mapInArrow(stitch, whole.schema))
