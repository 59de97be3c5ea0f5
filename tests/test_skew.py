"""Results stay exact when one key holds a third of the rows: a third of all
orders (and so of the line items) are moved to one customer, and selected
queries are compared with their DuckDB oracles on that data."""

import tempfile

import pytest

import __spark_entry__ as E
from test_entry_oracle import _digest

SRC = "/root/testdata/sf0.001"
KEYS = ["j5_customer_table", "fe21_feature_table", "ag17_churn_by_category", "ag11_iqr_outliers",
        "ml2_stratified_folds_exact", "ml14_roc_auc", "sv2_customer_directory", "ag2_column_profile"]


@pytest.fixture(scope="module")
def skewed_dir():
    duckdb = pytest.importorskip("duckdb")
    out = tempfile.mkdtemp(prefix="churnlake-skew-")
    con = duckdb.connect()
    for t in ["customer", "part", "lineitem", "events", "nation", "region", "supplier"]:
        con.execute(f"COPY (SELECT * FROM read_parquet('{SRC}/{t}.parquet')) TO '{out}/{t}.parquet' (FORMAT PARQUET)")
    con.execute(f"""COPY (SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey)
                 FROM read_parquet('{SRC}/orders.parquet')) TO '{out}/orders.parquet' (FORMAT PARQUET)""")
    hot = con.execute(f"SELECT avg(CAST(o_custkey = 7 AS DOUBLE)) FROM read_parquet('{out}/orders.parquet')").fetchone()[0]
    assert hot > 0.33
    return out


@pytest.mark.parametrize("name", KEYS)
def test_hot_customer_results_exact(spark, skewed_dir, name):
    import duckdb
    con = duckdb.connect()
    for t in ["customer", "part", "orders", "lineitem", "events", "nation", "region", "supplier"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{skewed_dir}/{t}.parquet')")
    for t in ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SRC}/{t}.parquet')")
    df = E.queries()[name](spark, skewed_dir)
    sp = [tuple(r) for r in df.collect()]
    res = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in res.description]
    dk = res.fetchall()
    assert len(sp) == len(dk) and _digest(sp, df.columns) == _digest(dk, cols)
