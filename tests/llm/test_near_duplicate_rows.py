"""The near-duplicate stage on repeated and missing ids."""

import corpus_pipeline


def test_rows_of_one_id_and_of_none(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(60)) for w in ("alpha", "beta", "gamma"))
    rows = [(1, a), (1, b), (1, a), (2, a + " end"), (3, ""), (None, b + " end"), (None, c), (None, c + " end"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    named = sorted((r.doc_id, r.text) for r in got if r.doc_id is not None)
    assert named == sorted([(1, a), (1, b), (3, "")])
    nameless = [r.text for r in got if r.doc_id is None]
    assert len(nameless) == 2 and None in nameless and (set(nameless) - {None}) <= {c, c + " end"}
