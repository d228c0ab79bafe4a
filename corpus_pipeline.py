"""A corpus pipeline: each stage calls one operator, and its decisions take effect.

``documents`` loses its toxic documents, then repeated lines, then all but one of each
group of near duplicates, then documents that hold benchmark passages, and what is left is
packed into training sequences. Every stage but the last returns the columns of
``documents``. The near-duplicate stage tells rows apart by a number of its own, so rows of
one id and rows without one are documents like the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import toxicity
from ledgerloom.llm.decontaminate import contaminated, decontaminate
from ledgerloom.llm.line_dedup import dedup_lines
from ledgerloom.llm.ngram_join import ngram_jaccard
from ledgerloom.llm.packing import pack
from ledgerloom.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_civil(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score_toxicity(docs, model).where("predicted = 0").select(docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten code points and more that several documents hold stay in the first; n_chars follows the text."""
    out = dedup_lines(docs)
    return (out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out).select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays, a row without id only if no other has one."""
    # Written, so that every scan sees the same numbers.
    rows = Scratch(spark, "pipeline-rows").table(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = ngram_jaccard(rows.select("__row", "doc_id", "text"), id_col="__row")
    first = found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("__row"))).alias("x")).select("x.__row")
    return rows.join(first, "__row", "left_semi").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth and more lies in benchmark passages go; the others stay as they are."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(~contaminated()).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of 1024 tokens, sources mixed by their share."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", keep_civil),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("packing", pack_sequences),
]

#: Nearest examples and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
