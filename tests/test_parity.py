"""Every registered query of the reference's operators that has an SQL twin gives the rows that DuckDB gives."""

import os

import pytest

from proofline import registered

FOLDER = os.environ.get("PARITY_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registered()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) or type(value).__name__ == "Decimal":
        return round(float(value), 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


@pytest.mark.parametrize("name", sorted(SQL))
def test_twin(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    told = duck.execute(SQL[name])
    columns = [d[0] for d in told.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted((tuple(plain(v) for v in row) for row in told.fetchall()), key=repr)
    got = sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)
    assert got == expected
