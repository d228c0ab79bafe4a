"""Benchmark rows without an id are searched like the others."""

from ledgerloom.llm.decontaminate import contaminated, decontaminate


def test_items_with_null_id_are_found(spark):
    passage = " ".join(f"p{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"before {passage} after"), (2, "p0 p1 p2"), (3, "named words here")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), (None, passage + " more"), (7, "named words"), (None, None)], "item_id long, text string")
    for block in (1 << 20, 40):
        out = decontaminate(docs, items, block_bytes=block).withColumn("bad", contaminated()).collect()
        got = {r.doc_id: (r.n_hit, r.n_items, r["items"], [tuple(s) for s in r.spans], r.bad) for r in out}
        assert got == {1: (15, 1, [], [(1, 16)], True), 2: (0, 0, [], [], False), 3: (2, 1, ["7"], [(0, 2)], True)}
