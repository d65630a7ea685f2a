"""Every registered query against its SQL on an independent engine, over the smallest tables."""

import duckdb
import pytest

from rheolake.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows, columns):
    def value(v):
        return None if v is None else round(float(v), 5) + 0.0 if isinstance(v, float) else int(v) if isinstance(v, bool) else v

    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted((tuple(value(r[n]) for n in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, con, name):
    df = plans.QUERIES[name](spark, SF)
    found = con.execute(plans.SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = plain(df.collect(), df.columns), plain(found.fetchall(), columns)
    assert len(got) == len(want) and got == want


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_kernels_give_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
