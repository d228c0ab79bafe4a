"""Odd labels, long tokens, and a field fitted on a table."""

from ledgerloom.llm import quality, toxicity
from ledgerloom.llm.pii import fit, find_pii, labelled, shape, training_rows


def test_labels_other_than_0_and_1_are_left_out(spark):
    docs = spark.createDataFrame([(i, f"word{i % 3} idiot" if i % 2 else f"calm {i}") for i in range(60)], "doc_id long, text string")
    good = [(i, i % 2, i % 2) for i in range(40)]
    odd = [(50, 7, -1), (51, None, 2), (None, 1, 1), (999, 1, 1)]
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    a, b = quality.fit(docs, table(good)), quality.fit(docs, table(good + odd))
    assert a[1] == b[1] and (a[0] == b[0]).all()
    score = lambda rows: sorted(map(str, toxicity.score_toxicity(docs, toxicity.fit(docs, table(rows))).select("doc_id", "score").collect()))
    assert score(good) == score(good + odd)


def test_whole_tokens_count(spark):
    assert shape("a" * 50 + "1" + "B" * 50) == "a9A" and shape("x1" * 40) == "a9" * 40
    field = fit(training_rows(60), rounds=5)
    rows = [(1, "9" * 200_000), (2, "call " + "a1" * 30_000 + " now"), (3, None)]
    out = find_pii(spark.createDataFrame(rows, "doc_id long, text string"), field=field).collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 3]


def test_field_from_a_table(spark):
    rows = training_rows(80)
    bad = [(None, ["O"]), (["a"], None), (["a", "b"], ["O"]), (["a"], ["B-name"]), ([None], ["O"])]
    table = spark.createDataFrame([*rows, *bad], "tokens array<string>, labels array<string>")
    got = labelled(table)
    assert sorted(got) == sorted((list(t), list(y)) for t, y in rows)
    assert len(labelled(table, max_rows=7)) == 7 and labelled(table.limit(0)) == []
    fit(got, rounds=2)
