"""Every registered query with SQL agrees with it over the smallest tables."""

import os

import duckdb
import pytest

from loomstone import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(map(norm, r)) for r in df.select(*(f"`{c}`" for c in columns)).collect()), key=repr)
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = sorted((tuple(map(norm, r)) for r in duck.execute(f"select {quoted} from ({catalog.oracle_sql()[name]})").fetchall()), key=repr)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_other_queries_give_rows(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0
