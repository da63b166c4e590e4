"""Queries against their SQL on rows made for one rule each: what the given tables hold too rarely to tell."""

from datetime import datetime

import duckdb
import pytest
from test_oracles import plain

from quarterlode.plans.catalogue import ORACLES, QUERIES

LINE = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
TYPES = ("LARGE", "MEDIUM", "SMALL")


@pytest.fixture
def both(spark, tmp_path):
    """f(name, rows) -> rows of a query and of its SQL; rows: (company, year, quarter, type, revenue)."""

    def run(name, rows):
        lines = [(i, TYPES.index(t), c, 1, 1.0, v, 0.0, 0.02, "N", "O", datetime(y, q * 3, 1)) for i, (c, y, q, t, v) in enumerate(rows)]
        spark.createDataFrame(lines, LINE).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
        parts = [(i, t, f"Brand#{i}", t, 1, 1.0) for i, t in enumerate(TYPES)]
        spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
        con = duckdb.connect()
        for t in ("lineitem", "part"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        sql = ORACLES[name]
        for t in ("region", "nation", "customer", "supplier", "orders", "events"):
            p = f"/root/testdata/sf0.001/{t}.parquet"
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
        got = QUERIES[name](spark, str(tmp_path))
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        key = lambda r: tuple(plain(v) for v in r)
        return sorted((key(r[c] for c in names) for r in got.collect()), key=str), sorted(map(key, want.fetchall()), key=str)

    return run


def test_rebalanced_shares_are_each_members_own(both):
    """The mean share next door is that of the row's own member, not of the neighbours' first."""
    rows = [(c, 1996, q, t, v) for c in (1, 3, 5, 7, 9, 11) for q in (1, 2, 3, 4) for t, v in (("LARGE", 200.0 + c), ("MEDIUM", 800.0 + q))]
    got, want = both("b23_rebalance", rows)
    assert any("rebalanced" in r for r in got)
    assert got == want


def test_coverage_on_a_bound(both):
    """0.3 * (v + 1.5 * v) is 0.75 of v: on the bound of 25 %, whatever v."""
    got, want = both("b4_score_candidate", [(3 * i, 1998, 4, "SMALL", v) for i, v in enumerate((1000.0, 33333.33, 20001.49, 31415.93, 27182.81, 14142.13, 17320.51, 22360.68, 99999.97, 12345.67, 76543.21, 45678.91), 1)])
    assert got == want
