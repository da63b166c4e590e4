"""Every registered query outside the corpus subpackage against DuckDB on the smallest tables, on a few partitions."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from quarterlode.plans.catalogue import ORACLES, QUERIES
from quarterlode.plans.fixtures import TABLES


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def plain(v):
    if isinstance(v, (float, Decimal)) and not isinstance(v, bool):
        return None if math.isnan(v) else f"{float(v):.9g}"
    return str(v) if v is not None else None


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=str)
    if name not in ORACLES:
        assert rows
        return
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted([tuple(plain(r[i]) for i in at) for r in want.fetchall()], key=str)
