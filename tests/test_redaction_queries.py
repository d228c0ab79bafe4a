"""The redaction queries over texts whose secrets stand late."""

from ledgerloom.plans import queries

MASKED = " [REDACTED] and X-Amz-Signature=[REDACTED] or [REDACTED], [REDACTED] aws_secret_access_key=[REDACTED] end"


def test_whole_texts_are_redacted(spark, tmp_path):
    late = "é" * 70 + " AKIA" + "Q" * 16 + " then Bearer x.y-z, " + "w" * 5000
    rows = [(1, late, "en", late), (2, "", "en", ""), (3, None, "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: "é" * 70 + " [REDACTED] then [REDACTED], " + "w" * 5000 + MASKED, 2: MASKED, 3: None}
    assert {r.doc_id: r.text for r in queries.queries()["redact_strings"](spark, str(tmp_path)).collect()} == want
    got = queries.queries()["redact_maps"](spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.authorization, r.note) for r in got} == {i: ("[REDACTED]", t) for i, t in want.items()}
