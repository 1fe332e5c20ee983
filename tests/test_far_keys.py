"""Queries against their SQL over orders with keys far from the first ones, as larger tables have them."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as driver

#: Interpolation ways have ids from 5,000,000 on, one for each 25 blocks of 40 keys; from key 4,000,000 on ways of the lattice have them too.
BLOCKS = {"near": range(25, 200, 25), "far": range(100_075, 100_400, 25)}


@pytest.fixture(scope="module", params=sorted(BLOCKS))
def tables(request, tmp_path_factory):
    path = tmp_path_factory.mktemp(request.param)
    keys = sorted({40 * b + p for b in BLOCKS[request.param] for p in (1, 5, 20, 38)} | {4_000_000 + b for b in BLOCKS[request.param]})
    pq.write_table(pa.table({"o_orderkey": pa.array(keys, pa.int64())}), path / "orders.parquet")
    pq.write_table(pa.table({"n_name": ["A", "B"], "n_nationkey": pa.array([0, 6], pa.int64())}), path / "nation.parquet")
    return path


@pytest.mark.parametrize("name", ["K11_fix_elements", "S08_extract", "S08_counts", "Q02_outside_tiles"])
def test_like_sql(spark, tables, name):
    con = duckdb.connect()
    for t in ("orders", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    got = driver.queries()[name](spark, f"file://{tables}")
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({driver.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
