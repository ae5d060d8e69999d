"""Every registered query of the engine against its DuckDB SQL on the smallest tables, columns and values."""

import duckdb
import pytest

from prospecta import registry

SF = "/root/testdata/sf0.001"


def values(rows):
    return sorted(tuple("%.9g" % v if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def con():
    db = duckdb.connect()
    for table in ("part", "supplier", "events"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert values(rows) == values([[r[i] for i in at] for r in found.fetchall()])
