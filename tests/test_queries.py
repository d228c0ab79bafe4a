"""Every registered catalog query against its SQL twin, on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from ledgerloom.plans import oracle, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(tuple("" if v is None or v != v else str(int(v)) if isinstance(v, float) and v == int(v) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="session")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, sql, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    ours = plain(df.select(*cols).collect())
    quoted = ', '.join(f'"{c}"' for c in cols)
    theirs = plain(sql.sql(f"SELECT {quoted} FROM ({oracle.oracle_sql()[name]})").fetchall())
    assert ours == theirs


def test_names_agree():
    assert set(queries.queries()) == set(oracle.oracle_sql())
