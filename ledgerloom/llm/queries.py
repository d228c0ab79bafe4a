"""Queries of this subpackage: thin callers that derive the agreed columns from each operator's own output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode
from .decontaminate import contaminated, decontaminate
from .filter_audit import audit_filters, mask_cells
from .licenses import scan_licenses
from . import quality
from .line_dedup import dedup_lines
from .ngram_join import ngram_jaccard
from .packing import pack
from .pii import KINDS, find_pii
from .scratch import Scratch
from .spelling import spelling_variants
from .topk import top_k
from .toxicity import fit, held_out, score_toxicity
from .warc import read_warc, write_warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages to WARC archives and back."""
    path = Scratch(spark, "archives").new("warc")
    write_warc(_read(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates of 0.8 and more over shingles of five words."""
    return ngram_jaccard(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; its source is the host, source and language are the path."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    model = quality.fit(docs, _read(spark, sf_dir, "labels"))
    out = quality.score_quality(docs, model, host=F.col("source"), path=F.concat_ws("/", "source", "lang"))
    return out.select("doc_id", held_out().alias("held_out"), "evidence", "host_posterior", "path_posterior", "score", "keep", F.col("keep").cast("int").alias("predicted"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of thirteen words of ``benchmark`` in ``documents``."""
    out = decontaminate(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector."""
    return top_k(_read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans and the field's."""
    out = find_pii(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    written = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"bigint(size(filter(spans, s -> s.base AND s.kind = '{k}')))").alias(f"n_{k}") for k in KINDS]
    base = F.expr(f"sha2({written.format('filter(spans, s -> s.base)')}, 256)").alias("base_sha256")
    return out.select("doc_id", *counts, base, F.expr(written.format("spans")).alias("spans"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every document."""
    return scan_licenses(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("matches")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of ten code points and more, in two documents and more, stay in the smallest."""
    out = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of 1024 tokens, sources mixed by their share of the corpus."""
    return pack(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, learnt from the labels that are not held out."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    out = score_toxicity(docs, fit(docs, _read(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "evidence")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants of all words of seven letters and more, with the forms they are written for."""
    out = spelling_variants(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all 120 orders, by source."""
    cells = mask_cells(_read(spark, sf_dir, "documents").select("doc_id", "text", "source"), _read(spark, sf_dir, "labels"))
    return audit_filters(cells)


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document to token ids and back."""
    coded = bpe_encode(_read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    digest = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), " ")
    return bpe_decode(coded).select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), digest(ids).alias("ids_sha256"), digest(F.col("decoded")).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc, op2_ngram_join, op3_quality, op4_decontaminate, op5_topk, op6_pii, op7_license_scan, op8_line_dedup, op9_packing, op10_toxicity, op11_spelling, op12_filter_audit, op13_bpe)}
