"""Every query with an oracle equals DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from fathomkb.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return "null"
    return f"{x:.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cur = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(plain(v) for _, v in sorted(zip(columns, r))) for r in cur.fetchall())
    got = sorted(tuple(plain(v) for _, v in sorted(zip(df.columns, r))) for r in df.collect())
    assert got == want


def test_claims_merge_takes_the_first_row_of_equal_keys(spark, tmp_path):
    rows = [(o, p, 7, n, f) for o in range(40) for n, p, f in ((1, 5, "R"), (1, 5, "A"), (2, 1, "N"))] + [(50, 1_500_000, 1, 1, "R"), (50, 3, 2, 2, "A"), (51, None, 3, 1, "A"), (51, 9, 4, 2, None), (51, 9, 4, 3, "R")]
    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE TABLE lineitem (l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INTEGER, l_returnflag VARCHAR)")
    con.executemany("INSERT INTO lineitem VALUES (?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    want = sorted(con.execute(catalog.ORACLES["a25_merge_claims"]).fetchall())
    got = sorted(map(tuple, catalog.QUERIES["a25_merge_claims"](spark, str(tmp_path)).collect()))
    assert got == want and ("order-0", "R", "s7") in got and ("order-50", "A", "s1,s2") in got and ("order-51", "R", "s3,s4") in got
