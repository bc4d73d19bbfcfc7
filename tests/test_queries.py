"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest
from conftest import SMALL

from codeloom.plans import catalog

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
ORACLES = catalog.all_oracles()

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = catalog.all_queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    found = [tuple(normal(r[c]) for c in columns) for r in df.collect()]
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    types = {d[0]: str(d[1]) for d in cursor.description}
    assert {c: TYPES[t] for c, t in df.dtypes} == types
    at = [names.index(c) for c in columns]
    wanted = [tuple(normal(r[i]) for i in at) for r in cursor.fetchall()]
    assert wanted, "the SQL gives no rows"
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


@pytest.mark.parametrize("name", sorted(set(catalog.all_queries()) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.all_queries()[name](spark, SMALL).count() > 0
