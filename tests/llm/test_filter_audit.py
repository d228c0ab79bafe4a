"""The filter audit against a plain simulation of every order, and against SQL."""

import itertools
import random
import re

import duckdb
import pytest
from conftest import SF
from pyspark.sql import functions as F

from ledgerloom.llm import queries as Q
from ledgerloom.llm import sql as S
from ledgerloom.llm.filter_audit import METRICS, audit_filters, mask_cells

COLUMNS = ["part", "filter_order", "step", *METRICS, "shapley"]


def failures(rows):
    """(part, failed letters, labels' key) of each row."""
    out = []
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    for i, t, source in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = set()
        if len(words) < 50:
            failed.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t):
            failed.add("C")
        if re.search("[#$%&*|]", t):
            failed.add("D")
        if i is not None and least[t] < i:
            failed.add("E")
        out.append((source or "", failed, i))
    return out


def brute(rows, labels):
    docs = failures(rows)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    out = {}
    shapley = {}
    for order in itertools.permutations("ABCDE"):
        for part in {p for p, _, _ in docs}:
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                ids = [d[2] for d in removed if d[2] is not None]
                out[part, "".join(order), step + 1] = [
                    len(left), len(removed), sum(f in d[1] for d in gone), sum(d[1] == {f} for d in docs if d[0] == part),
                    sum(i in good for i in ids), sum(i in toxic for i in ids),
                ]
                gone += removed
                shapley[part, f] = shapley.get((part, f), 0) + len(removed)
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def told(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def nasty():
    r = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda n, k=300: " ".join(r.choice(vocab[:k]) for _ in range(n))
    texts = [None, "", " \t\n", "\x1c\x85 ", "ÉÀ" * 40, "A" * 30, text(50), text(49), text(50) + " # ", text(200, 20), text(200, 20).upper(), text(60).upper() + "|", "x\x0by\x0cz " * 30, text(3000), "é" * 5000]
    texts += [text(r.randrange(40, 90), r.choice([20, 300])) + r.choice(["", "$", " ABCDEFGHIJKLMNOPQRSTUVWXYZ"]) for _ in range(30)]
    same = texts[6]
    rows = [(i * 3, t, r.choice([None, "", "s1", "s2"])) for i, t in enumerate(texts)]
    rows += [(500 + i, same, r.choice(["s1", "s2", None])) for i in range(40)]
    rows += [rows[6], rows[6], (1, same, "s2"), (None, same, "s1"), (None, same, "s1"), (None, None, None), (7, None, "s1"), (7, "another text of one id", "s1")]
    labels = [(i, r.choice([0, 1, None, 2]), r.choice([0, 1, None])) for i in range(0, 560, 2)] + [(6, 1, 1), (6, 0, 0), (None, 1, 1)]
    return rows, labels


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_brute_force(spark, parts):
    rows, labels = nasty()
    docs = spark.createDataFrame([(*x, "clash", 1, True) for x in rows], "doc_id long, text string, source string, part string, MASK int, good boolean").repartition(parts)
    told_labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    cells = mask_cells(docs, told_labels)
    assert cells.agg(F.sum("n")).first()[0] == len(rows)
    assert told(audit_filters(cells)) == brute(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit_filters(mask_cells(docs, labels)).isEmpty()
    one = docs.union(spark.createDataFrame([(1, None, None)], docs.schema))
    assert told(audit_filters(mask_cells(one, labels))) == brute([(1, None, None)], [])


def test_null_ids_spread_over_tasks(spark):
    docs = spark.range(5000).selectExpr("CAST(NULL AS LONG) AS doc_id", "CAST(id AS STRING) AS text", "'s' AS source")
    labels = spark.createDataFrame([(None, 1, 1)], "doc_id long, quality int, toxic int")
    cells = mask_cells(docs, labels).collect()
    assert [(c.mask, c.good, c.toxic, c.n) for c in cells] == [(1, False, False, 5000)]


def test_query_equals_sql_and_brute_force(spark):
    out = Q.op12_filter_audit(spark, SF)
    assert set(out.columns) == set(COLUMNS)
    got = told(out)
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert got == sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({S.OP12})").fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got == brute(rows, labels)
