"""What to copy between stores, and what happens to a copy whose key is taken."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.columns import live, renamed_key
from .duplicates import _PLACE, _placed
from .ledger import payload


def source_pairs(names: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> list[tuple[str, str]]:
    """All ordered pairs of different names, or those given."""
    return [(a, b) for a in names for b in names if a != b and (pairs is None or (a, b) in pairs)]


def replication_plan(catalog: DataFrame, names: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """src, dst and the canonical live row of src for each hash that src holds live and dst doesn't.

    The names are configuration, so each row explodes into its destinations without a join;
    one anti join on (dst, hash) follows.
    """
    rows = catalog.where(live() & F.col("source").isin(*names))
    # The least row by an aggregate, which combines before the shuffle: a hash with very many copies is one row a task.
    kept = [c for c in rows.columns if c not in ("source", "content_hash")]
    least = F.min_by(F.struct(*kept), F.struct(*_PLACE[1:3])).alias("x")
    best = _placed(rows, (), millis=False).groupBy("source", "content_hash").agg(least).select("source", "content_hash", "x.*")
    held = best.select(F.col("source").alias("dst"), "content_hash")
    to: dict[str, list[str]] = {}
    for a, b in source_pairs(names, pairs):
        to.setdefault(a, []).append(b)
    if not to:
        return best.withColumnRenamed("source", "src").withColumn("dst", F.lit("")).limit(0)
    table = F.create_map(*[x for a, bs in to.items() for x in (F.lit(a), F.array(*map(F.lit, bs)))])
    plan = best.withColumn("dst", F.explode(F.try_element_at(table, F.col("source"))))
    return plan.join(held, ["dst", "content_hash"], "left_anti").withColumnRenamed("source", "src")


def with_destination(plan: DataFrame, objects: DataFrame) -> DataFrame:
    """The plan with dst_exists and dst_hash: the object under the same key at the destination."""
    at = objects.select(F.col("source").alias("dst"), "key", F.col("content_hash").alias("dst_hash"), F.lit(True).alias("dst_exists"))
    return plan.join(at, ["dst", "key"], "left").withColumn("dst_exists", F.coalesce("dst_exists", F.lit(False)))


def loop_guard(plan: DataFrame) -> DataFrame:
    """The plan with guard: loop-skip where the object came from the destination, source-tagged where it has no origin yet."""
    origin = F.nullif(F.col("origin"), F.lit(""))
    return plan.withColumn("guard", F.when(origin == F.col("dst"), "loop-skip").when(origin.isNull(), "source-tagged"))


def _resolve(rows: DataFrame, key: str, first: str) -> DataFrame:
    """action and observed_content_hash by the rule that keeps what is there; rows carry dst_exists and dst_hash for ``key``.

    A store has one object under a key, so at most one row of each source meets here."""
    w = W.partitionBy("dst", key).orderBy("src", "content_hash")
    there = F.when(F.col("dst_exists"), F.col("dst_hash")).otherwise(F.first("content_hash").over(w.rowsBetween(W.unboundedPreceding, 0)))
    rows = rows.withColumns({"__there": there, "__fresh": (F.row_number().over(w) == 1) & ~F.col("dst_exists")})
    same = F.coalesce(F.col("content_hash") == F.col("__there"), F.lit(False))
    rows = rows.withColumn("action", F.when(F.col("__fresh"), first).when(same, "replicate-skip-existing").otherwise("key-conflict"))
    return rows.withColumn("observed_content_hash", F.when(F.col("action") == "key-conflict", F.col("__there"))).drop("__there", "__fresh")


_SUFFIX = r"([.][0-9a-f]{8})+\z"
_OUT = ("src", "dst", "key", "content_hash", "action", "previous_content_hash", "renamed_key", "observed_content_hash")


def _renamed(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """Conflicts under new names, for rows none of whose names is another's: two passes of the plain rule."""
    none = F.lit(None).cast("string")
    rows = _resolve(rows, "key", "replicate")
    settled = rows.where("action <> 'key-conflict'").withColumn("renamed_key", none)
    again = rows.where("action = 'key-conflict'").withColumn("renamed_key", renamed_key(F.col("key"), F.col("content_hash"))).drop("dst_exists", "dst_hash", "action")
    taken = objects.select(F.col("source").alias("dst"), F.col("key").alias("renamed_key"), F.col("content_hash").alias("dst_hash"), F.lit(True).alias("dst_exists"))
    again = again.join(taken, ["dst", "renamed_key"], "left").withColumn("dst_exists", F.coalesce("dst_exists", F.lit(False)))
    return settled.select(*_OUT).unionByName(_resolve(again, "renamed_key", "rename").select(*_OUT))


def _chained(rows: DataFrame, objects: DataFrame) -> DataFrame:
    """The same for rows whose own key may be the new name of another: one after the other, in the order of (src, hash),
    inside a destination's keys of one stem."""
    taken = objects.select(F.col("source").alias("dst"), F.col("key").alias("__new"), F.col("content_hash").alias("__new_hash"), F.lit(True).alias("__new_exists"))
    rows = rows.withColumn("__new", renamed_key(F.col("key"), F.col("content_hash"))).join(taken, ["dst", "__new"], "left")
    rows = rows.select("src", "dst", "key", "content_hash", "dst_exists", "dst_hash", "__new", F.coalesce("__new_exists", F.lit(False)).alias("__new_exists"), "__new_hash", "__stem")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, str | None] = {}
        for r in pdf.itertuples(index=False):
            x = r._asdict() if hasattr(r, "_asdict") else dict(zip(pdf.columns, r, strict=True))
            if x["dst_exists"]:
                held[x["key"]] = x["dst_hash"]
        for new, there, value in zip(pdf["__new"], pdf["__new_exists"], pdf["__new_hash"], strict=True):
            if there:
                held[new] = value
        out = []
        for src, dst, key, value, new in pdf.sort_values(["src", "content_hash"])[["src", "dst", "key", "content_hash", "__new"]].itertuples(index=False):
            place, renamed, first = key, None, "replicate"
            if key in held and held[key] != value:
                place, renamed, first = new, new, "rename"
            action = first if place not in held else "replicate-skip-existing" if held[place] == value else "key-conflict"
            out.append((src, dst, key, value, action, None, renamed, held[place] if action == "key-conflict" else None))
            held.setdefault(place, value)
        return pd.DataFrame(out, columns=list(_OUT))

    return rows.groupBy("dst", "__stem").applyInPandas(settle, ", ".join(f"{c} string" for c in _OUT))


def resolve_conflicts(plan: DataFrame, objects: DataFrame, policy: str = "skip", allow_destructive: bool = True) -> DataFrame:
    """src, dst, key, content_hash, action, previous_content_hash, renamed_key, observed_content_hash for each row that the
    loop guard lets through.

    Rows for one destination key are settled in the order of (src, hash), by windows instead
    of a running state. Under ``rename``, a row's key can be what another row would be renamed to; only such rows, found by
    the stem of their keys, are settled one after the other.
    """
    none = F.lit(None).cast("string")
    rows = with_destination(loop_guard(plan).where("guard IS NULL OR guard <> 'loop-skip'"), objects)
    if policy == "overwrite":
        w = W.partitionBy("dst", "key").orderBy("src", "content_hash")
        first = F.row_number().over(w) == 1
        before = F.when(first, F.col("dst_hash")).otherwise(F.lag("content_hash").over(w))
        rows = rows.withColumn("previous_content_hash", before).withColumn("first", first)
        action = F.when(F.col("first") & ~F.col("dst_exists"), "replicate").when(F.coalesce(F.col("content_hash") == F.col("previous_content_hash"), F.lit(False)), "replicate-skip-existing")
        rows = rows.withColumn("action", action.otherwise("overwrite" if allow_destructive else "key-conflict")).withColumn("renamed_key", none)
        rows = rows.withColumn("observed_content_hash", F.when(F.col("action") == "key-conflict", F.col("previous_content_hash")))
        return rows.withColumn("previous_content_hash", F.when(F.col("action") == "overwrite", F.col("previous_content_hash"))).select(*_OUT)
    rows = rows.withColumns({"previous_content_hash": none, "renamed_key": none})
    if policy == "skip":
        return _resolve(rows, "key", "replicate").select(*_OUT)
    rows = rows.withColumn("__stem", F.regexp_replace("key", _SUFFIX, ""))
    mixed = rows.groupBy("dst", "__stem").agg(F.count("*").alias("n"), F.max(F.col("key") != F.col("__stem")).alias("longer")).where("n > 1 AND longer").select("dst", "__stem", F.lit(True).alias("__mixed"))
    rows = rows.join(mixed, ["dst", "__stem"], "left")
    plain = rows.where("__mixed IS NULL").drop("__mixed", "__stem")
    return _renamed(plain, objects).unionByName(_chained(rows.where("__mixed"), objects))


def replication_decisions(plan: DataFrame, objects: DataFrame, policy: str = "skip", allow_destructive: bool = True) -> DataFrame:
    """All that the ledger says of a plan, with its payload: action, result, source, target, key, content_hash, size_bytes, done_key, extra.

    Rows that the loop guard stops are ``loop-skip``; an object without origin gets a ``source-tagged`` row besides its own.
    """
    sizes = plan.select("src", "dst", "content_hash", "size_bytes")
    decided = resolve_conflicts(plan, objects, policy, allow_destructive).join(sizes, ["src", "dst", "content_hash"])
    action, conflict = F.col("action"), F.col("action") == "key-conflict"
    done = decided.select(
        "action", F.when(action.isin("replicate", "rename", "overwrite"), "success").otherwise("skipped").alias("result"), F.col("src").alias("source"), F.col("dst").alias("target"),
        "key", "content_hash", "size_bytes", F.coalesce("renamed_key", "key").alias("done_key"),
        payload(
            original_key=F.when(action == "rename", F.col("key")), renamed_key=F.col("renamed_key"), previous_content_hash=F.col("previous_content_hash"),
            expected_content_hash=F.when(conflict, F.col("content_hash")), observed_content_hash=F.when(conflict, F.coalesce("observed_content_hash", F.lit(""))),
        ).alias("extra"),
    )
    guarded = loop_guard(plan).where("guard IS NOT NULL")
    tagged = F.col("guard") == "source-tagged"
    guarded = guarded.select(
        F.col("guard").alias("action"), F.when(tagged, "success").otherwise("skipped").alias("result"), F.col("src").alias("source"), F.col("dst").alias("target"),
        "key", "content_hash", "size_bytes", F.col("key").alias("done_key"), payload(origin=F.when(tagged, F.col("src"))).alias("extra"),
    )
    return done.unionByName(guarded)
