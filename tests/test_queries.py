"""Every registered query against its SQL in DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    from lodeframe.plans.roles import TABLES

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def names():
    from lodeframe.plans import QUERIES

    return sorted(QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from lodeframe.plans import ORACLES, QUERIES

    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(str([plain(v) for v in r]) for r in df.select(*columns).collect())
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    found = [d[0] for d in cursor.description]
    assert sorted(found) == columns
    at = [found.index(c) for c in columns]
    assert sorted(str([plain(r[i]) for i in at]) for r in cursor.fetchall()) == rows


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() == 25 and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
