"""Extra columns whose names differ from an operator's in case alone, hold dots or backquotes, or only differ from each other in case."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import quality, toxicity
from ledgerloom.llm.bpe import bpe_decode, bpe_encode
from ledgerloom.llm.decontaminate import decontaminate
from ledgerloom.llm.filter_audit import audit_filters, mask_cells
from ledgerloom.llm.licenses import scan_licenses
from ledgerloom.llm.line_dedup import dedup_lines
from ledgerloom.llm.ngram_join import ngram_jaccard
from ledgerloom.llm.packing import pack
from ledgerloom.llm.pii import find_pii
from ledgerloom.llm.spelling import spelling_variants
from ledgerloom.llm.topk import top_k

ROWS = [(i, f"some words of text {i % 3}, released under the MIT License by a.b@c.org\nand again", "src", f"x{i}") for i in range(12)]


def tables(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, source string, own string")
    labels = spark.createDataFrame([(i, i % 2, int(i % 3 == 0)) for i in range(12)], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([("b", "released under the mit license by")], "item_id string, text string")
    return plain, labels, benchmark


OPERATORS = {
    "line_dedup": (lambda d, **_: dedup_lines(d), "N_Lines"),
    "ngram_join": (lambda d, **_: ngram_jaccard(d), "Component_Id"),
    "decontaminate": (lambda d, benchmark, **_: decontaminate(d, benchmark), "N_WORDS"),
    "pii": (lambda d, **_: find_pii(d), "Spans"),
    "licenses": (lambda d, **_: scan_licenses(d), "Labels"),
    "toxicity": (lambda d, model, **_: toxicity.score_toxicity(d, model), "Score"),
    "quality": (lambda d, quality_model, **_: quality.score_quality(d, quality_model, host=F.col("source"), path=F.concat_ws("/", "source", F.col("`a.b`") if "a.b" in d.columns else "own")), "KEEP"),
    "bpe": (lambda d, **_: bpe_decode(bpe_encode(d)), "TOKEN_IDS"),
}


@pytest.fixture(scope="module")
def given(spark):
    plain, labels, benchmark = tables(spark)
    return {"benchmark": benchmark, "model": toxicity.fit(plain, labels), "quality_model": quality.fit(plain, labels)}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_names(spark, given, name):
    op, clash = OPERATORS[name]
    plain, *_ = tables(spark)
    own = F.col("own")
    odd = plain.withColumns({clash: F.lit("clash"), "a.b": own, "c`d": own, "struct": F.struct("own")})
    out = op(odd, **given)
    names = [c.lower() for c in out.columns]
    assert len(set(names)) == len(names) and clash not in out.columns and {"a.b", "c`d", "struct", "own"} <= set(out.columns)
    assert {(r["own"], r["a.b"], r["c`d"], r["struct"].own) for r in out.collect()} == {(x, x, x, x) for *_, x in ROWS}
    back = op(plain, **given)
    assert sorted(map(str, out.select(*back.columns).collect())) == sorted(map(str, back.collect()))


def test_operators_that_read_named_columns_only(spark):
    plain, labels, _ = tables(spark)
    odd = plain.withColumns({"a.b": F.lit(1), "N": F.lit(2), "WORD": F.lit(3), "Doc_Tokens": F.lit(4)})
    assert spelling_variants(odd).count() == spelling_variants(plain).count()
    assert audit_filters(mask_cells(odd, labels)).count() == 600
    assert pack(odd).count() == pack(plain).count()
    vectors = spark.createDataFrame([(0, [1.0], 1, 2), (1, [2.0], 3, 4)], "vec_id long, embedding array<double>, `a.b` int, Score int")
    assert top_k(vectors, F.col("vec_id") == 0).count() == 1
