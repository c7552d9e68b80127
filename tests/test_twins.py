"""Every registered query of the library against its SQL twin in DuckDB, on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

from colloquy.plans import registry

NAMES = sorted(registry.queries())
TWINS = registry.oracle_sql()


def plain(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float | decimal.Decimal):
        return f"{float(value) + 0.0:.9g}"
    if isinstance(value, list | tuple):
        return [plain(v) for v in value]
    return str(value)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, small, name):
    frame = registry.queries()[name](spark, small)
    names = sorted(frame.columns)
    rows = sorted(str([plain(r[c]) for c in names]) for r in frame.collect())
    if name not in TWINS:
        return
    result = duck.execute(TWINS[name])
    order = [d[0] for d in result.description]
    assert sorted(order) == names
    assert rows == sorted(str([plain(r[order.index(c)]) for c in names]) for r in result.fetchall())
