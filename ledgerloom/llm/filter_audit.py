"""How filters of a corpus interact: what each removes, in every order they could be applied.

Each document becomes a mask, one bit for each filter it fails, and only masks are counted:
a cell is (part, mask, quality, toxic) with a number of documents, so all that follows works
on a few cells for each part, however many documents there are. Cells are unpivoted against
the steps of all orders; a running ``bit_or`` over the steps before shows whether an earlier
filter has taken the cell's documents, and conditional sums give the step's metrics. The sum
over a filter's window in all orders is its Shapley total.

A document is a copy if a smaller id has the same text, anywhere in the table. Texts are
compared by SHA-256 and are counted before they meet: a group of copies travels as one row
for each part and label, with its least id and the rows that have it, so a text that a third
of all documents hold is small after the first, local aggregation. Only its least id joins
back, by an ordinary join whose large partitions adaptive execution splits.

Defined results: a null text is an empty one, a null source the part ''. A row without id is
no copy, for no id is smaller than it, makes no other row a copy, and has no labels. Rows of one id are
documents of their own and never copies of each other. Labels that repeat an id hold if any
of its rows does. An empty table has no parts and no rows. Columns of the input other than
those named aren't read, so names can't clash.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .scratch import Scratch

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
METRICS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column) -> Column:
    """Bits of the filters that look at one text: too few words (A), too few different words (B), too many capitals (C), odd signs (D)."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = (n < 50, 100 * distinct.cast("long") < 65 * n.cast("long"), 100 * capitals.cast("long") > 5 * F.length(text).cast("long"), text.rlike("[#$%&*|]"))
    out = F.lit(0)
    for i, failed in enumerate(fails):
        out = out.bitwiseOR(F.when(failed, 1 << i).otherwise(0))
    return out


def mask_cells(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, good, toxic (boolean) and n: documents counted by the filters they fail. ``labels``: the id, quality, toxic."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    # Rows without id find no label, wherever they go: spread by their text.
    own = own.select("id", "part", F.sha2("text", 256).alias("same"), text_mask(F.col("text")).alias("mask"))
    own = own.withColumn("salt", F.when(F.col("id").isNull(), F.crc32("same") % 1024).otherwise(0))
    told = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = own.join(told.withColumn("salt", F.lit(0)), ["id", "salt"], "left").na.fill(False, ["good", "toxic"])
    kind = ("same", "part", "mask", "good", "toxic")
    rows = rows.groupBy("id", *kind).agg(F.count("*").alias("n"))
    copies = rows.groupBy(*kind).agg(F.sum("n").alias("n"), F.min("id").alias("low"), F.min_by("n", "id").alias("n_low"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("n_none"))
    copies = Scratch(docs.sparkSession, "audit").table(copies, "copies")  # read twice below
    first = copies.groupBy("same").agg(F.min("low").alias("first"))
    copies = copies.join(first, "same")
    originals = F.col("n_none") + F.when(F.col("low") == F.col("first"), F.col("n_low")).otherwise(0)
    split = F.explode(F.array(F.struct(F.col("mask"), originals.alias("n")), F.struct(F.col("mask").bitwiseOR(COPY).alias("mask"), (F.col("n") - originals).alias("n"))))
    return copies.select("part", "good", "toxic", split.alias("x")).where("x.n > 0").groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def order_steps(filters: str = FILTERS) -> Column:
    """An array of (filter_order, step, bit): every step of every order. Configuration, not data."""
    steps = [(("".join(order)), k + 1, 1 << filters.index(f)) for order in itertools.permutations(filters) for k, f in enumerate(order)]
    return F.expr("array(" + ", ".join(f"named_struct('filter_order', '{o}', 'step', {k}, 'bit', {b})" for o, k, b in steps) + ")")


def audit_filters(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step (int), the metrics and shapley (long): one row for each part and step of each order."""
    long = cells.select("part", "mask", "good", "toxic", "n", F.explode(order_steps(filters)).alias("s")).select("part", "mask", "good", "toxic", "n", "s.*")
    before = W.partitionBy("part", "mask", "good", "toxic", "filter_order").orderBy("step").rowsBetween(W.unboundedPreceding, -1)
    long = long.withColumn("fails", F.col("mask").bitwiseAND(F.col("bit")))
    long = long.withColumn("earlier", F.coalesce(F.bit_or("fails").over(before), F.lit(0)))
    failed, untouched = F.col("fails") != 0, F.col("earlier") == 0
    count = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    out = long.groupBy("part", "filter_order", "step", "bit").agg(
        count(untouched & ~failed).alias("kept"), count(untouched & failed).alias("removed"), count(failed & ~untouched).alias("redundant"),
        count(F.col("mask") == F.col("bit")).alias("unique_fails"), count(untouched & failed & F.col("good")).alias("good_lost"), count(untouched & failed & F.col("toxic")).alias("toxic_lost"),
    )
    out = out.withColumn("shapley", F.sum("removed").over(W.partitionBy("part", "bit")))
    return out.select("part", "filter_order", "step", *METRICS, "shapley")
