"""Line deduplication over a whole corpus, with DataFrame functions only.

Lines are exploded, normalised and hashed; one aggregation finds the keys that lie in
enough documents; a line under such a key stays only in the smallest document holding
it; each document is put together again by line position.

The aggregate combines before its shuffle, so a line that a third of the corpus holds
arrives as one row per task. The lines that lose come from an ordinary inner join,
whose large partitions adaptive execution splits. Texts move once, by document id.

Defined results: a null text is an empty one, hence one empty line. Two rows of one id
are one document: their lines count once, and each row is rewritten by itself. A row
with null id is no document: it lends no line and loses none. Input columns are kept;
the operator's own use names of its own prefix, so a clash cannot happen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .names import plain_names
from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
_ID, _ROW, _TEXT, _POS, _KEY, _KEY2, _MIN, _MAX, _GONE = (f"__ld_{x}" for x in ("id", "row", "text", "pos", "k1", "k2", "min", "max", "gone"))


def line_key(line: Column) -> Column:
    """The line without ASCII blanks at its ends and with A-Z in lower case.

    ``lower`` is several times faster than ``translate``, and equal to it on ASCII.
    """
    line = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


@plain_names("n_lines", "n_dropped")
def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """``docs`` with ``text_col`` rewritten, and ``n_lines`` and ``n_dropped`` (long).

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses
    all its lines but those of the smallest document that holds it.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    row = F.xxhash64(F.col(text_col))  # tells rows of one id apart
    key = line_key(F.col(_TEXT))
    at = (
        docs.where(F.col(id_col).isNotNull())
        .select(F.col(id_col).alias(_ID), row.alias(_ROW), F.posexplode(lines).alias(_POS, _TEXT))
        .select(_ID, _ROW, _POS, F.when(F.length(key) >= min_chars, F.xxhash64(key)).alias(_KEY), F.xxhash64(F.lit(1), key).alias(_KEY2))
    )
    # Read twice below: written once, so that each line is normalised once.
    scratch = Scratch(docs.sparkSession, "lines")
    at = scratch.table(at, "keys").where(F.col(_KEY).isNotNull())
    by_key = at.groupBy(_KEY, _KEY2)
    if min_docs <= 2:  # two documents show in the extremes, which combine before the shuffle
        shared = by_key.agg(F.min(_ID).alias(_MIN), F.max(_ID).alias(_MAX)).where(F.col(_MIN) < F.col(_MAX) if min_docs == 2 else F.lit(True))
    else:
        shared = at.groupBy(_KEY, _KEY2, _ID).agg(F.lit(1).alias(_MAX)).groupBy(_KEY, _KEY2).agg(F.min(_ID).alias(_MIN), F.count("*").alias(_MAX)).where(F.col(_MAX) >= min_docs)
    # Written too: then both sides of the join are plain shuffles, whose hot partitions can be split.
    shared = scratch.table(shared.select(_KEY, _KEY2, _MIN), "shared")
    gone = (
        at.join(shared, [_KEY, _KEY2])
        .where(F.col(_ID) > F.col(_MIN))
        .groupBy(F.col(_ID).alias(_KEY), F.col(_ROW).alias(_KEY2))
        .agg(F.collect_set(_POS).alias(_GONE))
    )
    # The lines go through the join as an array, so that no lambda below splits a text again.
    own = [c for c in docs.columns if c != text_col and c not in ("n_lines", "n_dropped")]
    out = docs.select(*own, row.alias(_ROW), lines.alias(_TEXT)).join(gone, (F.col(id_col) == gone[_KEY]) & (F.col(_ROW) == gone[_KEY2]), "left")
    lines = F.col(_TEXT)
    lost = F.coalesce(F.size(_GONE), F.lit(0))
    kept = F.when(
        F.col(_GONE).isNull(), F.array_join(lines, "\n")
    ).otherwise(F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(_GONE)), lambda i: F.get(lines, i)), "\n"))
    return out.select(*own, kept.alias(text_col), F.size(lines).cast("long").alias("n_lines"), lost.cast("long").alias("n_dropped"))
