"""The registered queries against DuckDB on the smallest tables."""

import duckdb
import pytest
from conftest import SF

from check import TABLES, canonical
from matloom.workload import ORACLES, QUERIES
from matloom.workload import matrices

FAST = [n for n, f in QUERIES.items() if f.__module__ == matrices.__name__]
LOOPS = ["bfs", "components", "level_sort", "transitive_reduction", "elim_tree", "fwd_solution", "ic_symbolic_k1", "mor_solutions"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", FAST + LOOPS)
def test_query_agrees(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = canonical([tuple(r) for r in df.select(*cols).collect()])
    want = canonical(db.sql(ORACLES[name]).select(*[f'"{c}"' for c in cols]).fetchall())
    assert got == want


def test_sum_product_plan_is_pruned_and_partial(spark):
    """Only the read columns reach the scan, and sums form before the shuffle."""
    plan = QUERIES["spmv"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "partial_sum" in plan and "CartesianProduct" not in plan
