"""Every query with a DuckDB counterpart, on the smallest tables."""

import math
import os

import duckdb
import pytest

from boxtrail.plans import catalog

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    return [plain(v) for v in x] if isinstance(x, (list, tuple)) else x


def sortable(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    want = duck.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    picked = want.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sortable(got.select(*columns).collect()) == sortable(picked)
