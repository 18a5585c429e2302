"""Every catalog query against its DuckDB SQL, row by row, on the smallest tables."""

import math
import os

import duckdb
import pytest

from barflow import catalog

catalog.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return (0, "")
        if isinstance(x, bool):
            return (1, int(x))
        if isinstance(x, (int, float)):
            return (1, round(float(x), 6) + 0.0)
        if hasattr(x, "is_finite"):
            return (1, float(x))
        return (2, str(x))

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


def close(a, b):
    return len(a) == len(b) and all(x[0] == y[0] and (x[1] == y[1] or x[0] == 1 and abs(x[1] - y[1]) <= 2e-6 * max(1, abs(x[1]))) for x, y in zip(a, b))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    folder = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.001")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con, folder


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, oracle, name):
    con, folder = oracle
    df = catalog.QUERIES[name](spark, folder)
    got = df.collect()
    if name not in catalog.ORACLES:
        assert df.columns
        return
    found = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in found.description]
    expected = found.fetchall()
    assert sorted(names) == sorted(df.columns)
    a, b = normal(got, df.columns), normal(expected, names)
    assert len(a) == len(b)
    different = [(x, y) for x, y in zip(a, b) if not close(x, y)]
    assert not different, different[:3]
