"""Long blank runs, whole texts of the tables against the tokenizer, and wide vocabularies."""

import numpy as np
import pandas as pd
from tokenizers import Tokenizer

from ledgerloom.llm.packing import Encoder, default_tokenizer, id_kind, pack


def test_long_blank_runs_and_whole_texts(spark):
    ours, theirs = Encoder(*default_tokenizer()), Tokenizer.from_file(default_tokenizer()[0])
    texts = [" " * 1_000_000, "a" + "\n" * 400_000 + "b", *pd.read_parquet("/root/testdata/sf0.01/documents.parquet").text.fillna("")]
    for t, e in zip(texts, theirs.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(ours(t), "<u2").tolist() == e.ids
    docs = spark.createDataFrame([(1, texts[0], "s"), (2, "x", "s")], "doc_id long, text string, source string")
    rows = pack(docs).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {1: len(ours(texts[0])) // 2 + 1, 2: 2}


def test_ids_beyond_16_bits(tmp_path):
    (tmp_path / "ranks").write_text("YQ== 0\nYg== 70000\n")
    assert id_kind(str(tmp_path / "ranks")) == "<u4" and id_kind(default_tokenizer()[1]) == "<u2"
    wide = Encoder("", str(tmp_path / "ranks"), ".", "<u4")
    assert np.frombuffer(wide("ab"), "<u4").tolist() == [0, 70000]
