"""Every registered query against its SQL twin, and that all of them have stable schemas."""

import math

import duckdb
import pytest

from auditlake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else float(f"{x:.10g}")
        return float(x) if type(x).__name__ == "Decimal" else x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    if name in registry.ORACLE_SQL:
        cursor = duck.execute(registry.ORACLE_SQL[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == sorted(df.columns)
        assert _plain(got, df.columns) == _plain(cursor.fetchall(), columns)
    else:
        assert got


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
