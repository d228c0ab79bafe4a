"""Spelling variants against brute force: all pairs of words, all documents."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from ledgerloom.llm import queries as Q
from ledgerloom.llm import spelling

UP = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def counts(rows):
    held = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(str.maketrans(UP, UP.lower()))
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 31 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 7:
                held[w] += 1
    return {w: n for w, n in held.items() if n >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    n = counts(rows)
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    form, count = {}, {}
    for w in n:
        found = [x for k in (-1, 0, 1) for x in by_size.get(len(w) + k, ()) if near(w, x)]
        count[w] = len(found)
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], count[w], n[form[w]] if form[w] else -1) for w in n)


def told(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in df.collect())


def nasty():
    r = random.Random(7)
    base = ["".join(r.choice("abcé") for _ in range(r.randrange(7, 11))) for _ in range(40)] + ["aaaaaaaa", "ababababab", "z" * 300, "ÀÉÿÀÉÿÀ", "×÷×÷×÷×"]
    rows = []
    for i in range(160):
        words = []
        for _ in range(60):
            w = list(base[min(int(r.expovariate(0.15)), len(base) - 1)])
            if r.random() < 0.2:
                k = r.randrange(len(w))
                w[k : k + 1] = r.choice([[], [r.choice("abc")], [w[k], r.choice("abc")], [w[k], w[k]]])
            words.append("".join(w).upper() if r.random() < 0.1 else "".join(w))
        rows.append((i, r.choice([" ", "-", "9", "\n", "_", "Ā"]).join(words)))
    # A chain of forms: each word is ten times as frequent as the one before, and one letter away.
    chain = ["chained", "chainee", "chaineee", "chaineeee"]
    rows += [(1000 + k, " ".join([w] * 2 * 12**k)) for k, w in enumerate(chain)]
    # The ties: two equally frequent forms for one word.
    rows += [(2000, "tieword tieword " + "tiewora " * 40 + "tiewore " * 40)]
    return rows + [rows[0], rows[0], (None, rows[1][1]), (None, None), (5, None), (6, ""), (7, "short words ab cd"), (8, "q" * 50_000 + " " + "q" * 50_000 + " " + "q" * 49_999 + " " + "q" * 49_999)]


@pytest.mark.parametrize("parts", [1, 5])
def test_equals_brute_force(spark, parts):
    rows = nasty()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(parts)
    assert told(spelling.spelling_variants(docs)) == brute(rows)


def test_chains_reach_their_root(spark):
    out = {r.word: r for r in spelling.spelling_variants(spark.createDataFrame(nasty(), "doc_id long, text string"), planted=0).collect()}
    assert out["chained"].form == "chainee" and out["chained"].root == "chaineeee" and out["tieword"].form == "tiewora"


def test_hashes_that_collide_do_no_harm(spark, monkeypatch):
    monkeypatch.setattr(spelling, "keys", lambda words, real=spelling.keys: real(words).withColumn("key", F.shiftright("key", 59)))
    rows = nasty()[:60]
    assert told(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string"))) == brute(rows)


def test_keys_of_prefixes_and_suffixes_are_those_of_the_strings():
    words = ["abcdefg", "aabbccdd", "ééééééé", "a" * 40]
    of, kind, place, key = spelling.deletion_keys(words)
    whole = lambda s: int(spelling.deletion_keys([s])[3][0])
    for i, w in enumerate(words):
        mine = of == i
        got = {int(k) for k in key[mine & (kind == spelling.DELETION)]}
        assert got == {whole(w[:k] + w[k + 1 :]) for k in range(len(w))} and len(got) == int((mine & (kind == spelling.DELETION)).sum())
        assert int(key[mine & (kind == spelling.WHOLE)][0]) == whole(w) and len(np.unique(key[mine & (kind == spelling.PATTERN)])) == len(w)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(none).isEmpty()
    assert spelling.spelling_variants(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).isEmpty()


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    out = Q.op11_spelling(spark, SF)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and told(out) == brute(rows)
