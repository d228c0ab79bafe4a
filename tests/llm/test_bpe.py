"""Encoding and decoding against the tokenizers library, on texts of any signs."""

import hashlib
import random

import numpy as np
import pytest
from conftest import SF
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import bpe
from ledgerloom.llm import queries as Q


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.default_tokenizer())


ENCODER = bpe.Encoder(bpe.default_tokenizer())
LIBRARY = Tokenizer.from_file(bpe.default_tokenizer())


def ours(texts, encoder=ENCODER):
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in raw])]).astype(np.int64)
    at, ids = encoder(np.frombuffer(b"".join(raw), np.uint8), off)
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def theirs(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(max_size=80), max_size=6))
def test_any_text(texts):
    assert ours(texts) == theirs(texts)


def test_every_sign_between_letters_digits_and_marks():
    texts = [f"a{chr(c)}a 1{chr(c)}! {chr(c)}'s {chr(c)}́" for c in range(0x11000) if not 0xD800 <= c < 0xE000]
    assert ours(texts) == theirs(texts)


def test_mixed_texts():
    r = random.Random(1)
    signs = [*"abcdefgiknorst'  \t\n0123!?<|>ÉéßΣσİıŸſÅK̀́ªº²½·한글日本\U0001f600 \u0085\xa0\x1c\x00", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'ll", "'RE", "the", "ing", "ﬀ", "가"]
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(60))) for _ in range(3000)]
    assert ours(texts) == theirs(texts)


@pytest.mark.parametrize("long", ["a" * 100_000, "ab" * 5000, "é" * 30_000, "!?" * 2000, "theing" * 3000, "7" * 5000, "x" * 64, "x" * 65, "aeinrst" * 10])
def test_long_words_merge_by_heap_with_the_same_result(long):
    assert ours([long, f"so {long}."]) == theirs([long, f"so {long}."])


def test_scan_and_heap_agree():
    r = random.Random(2)
    words = ["".join(r.choice("aeinrstho") for _ in range(r.randrange(1, 65))).encode() for _ in range(2000)]
    m = ENCODER.merges
    start, ids = m.merged(words)
    for k, w in enumerate(words):
        assert ids[start[k] : start[k + 1]].tolist() == m._heaped(m.first_parts(w)).tolist()


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "_KNOWN", 50)
    encoder = bpe.Encoder(bpe.default_tokenizer())
    r = random.Random(3)
    for _ in range(20):
        texts = ["".join(r.choice("abcde é<|endoftext|>") for _ in range(400)) + " <|endoftext|> " + "w" * 60 for _ in range(3)]
        assert ours(texts, encoder) == theirs(texts)
    assert len(encoder.known) < 5000


def test_tables(spark, library):
    rows = [(1, None, "c"), (2, "", "c"), (3, "Hello, world's <|endoftext|> end", "c"), (None, "Hello", "c"), (3, "Hello", "c"), (4, "x" * 200_000, "c"), (5, " \t\n", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, TOKEN_IDS string").repartition(3)
    out = bpe.bpe_decode(bpe.bpe_encode(docs), out_col="TEXT")
    assert out.columns == ["doc_id", "token_ids", "TEXT"]
    want = [(i, e.ids, library.decode(e.ids, skip_special_tokens=False)) for (i, t, _) in rows for e in [library.encode(t or "", add_special_tokens=False)]]
    assert sorted(map(str, ((r.doc_id, r.token_ids, r.TEXT) for r in out.collect()))) == sorted(map(str, want))
    dotted = spark.createDataFrame([("a b", 1)], "`t.x` string, `a.b` int")
    assert bpe.bpe_encode(dotted, text_col="t.x").first().token_ids == library.encode("a b", add_special_tokens=False).ids
    none = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.bpe_decode(bpe.bpe_encode(none)).isEmpty()


def test_decode_of_odd_ids(spark, library):
    rows = [([320, 999_999, -1, 49407],), ([],), (None,), ([None, 320],), ([49406],)]
    got = {str(r.token_ids): r.decoded for r in bpe.bpe_decode(spark.createDataFrame(rows, "token_ids array<int>")).collect()}
    assert got == {"[320, 999999, -1, 49407]": "a</w> <|endoftext|>", "[]": "", "None": "", "[None, 320]": "a</w>", "[49406]": "<|startoftext|>"}
    assert library.decode([320, 999_999, 49407], skip_special_tokens=False) == "a</w> <|endoftext|>"


def test_query_equals_library(spark, library):
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    out = Q.op13_bpe(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and sorted(tuple(r) for r in out.collect()) == sorted(want)
