"""Every registered query of the library against its DuckDB oracle."""

import duckdb
import pytest

from folioscope import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_oracle(spark, sf, duck, name):
    got = catalogue.queries()[name](spark, sf)
    want = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert table(got.collect(), got.columns) == table(want.fetchall(), names)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_an_oracle_runs(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_flagship(spark, sf):
    rows = catalogue.flagship(spark, sf).collect()
    assert rows and {r.cid for r in rows} <= {"C1", "C2", "C3"}
