"""Every registered query with an oracle, compared with DuckDB on sf0.001
(row count, column names, order-insensitive values)."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
SLOW = ("ml_clf", "ml_reg", "ml_train_all", "ml_results", "ml_save", "ml_score", "ml_importance")
KEYS = sorted(k for k in E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


@pytest.mark.parametrize("name", KEYS)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    s_cols, s_rows = sdf.columns, [tuple(r) for r in sdf.collect()]
    con.execute(f"CREATE OR REPLACE VIEW oracle_result AS {E.oracle_sql()[name]}")  # as the driver loads it
    res = con.execute("SELECT * FROM oracle_result")
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)


def test_every_query_has_oracle_or_is_declared_rows_only():
    rows_only = {k for k in E.queries() if k not in E.oracle_sql()}
    allowed = ("snapshot_", "ml_", "op", "pipeline")
    assert all(k.startswith(allowed) for k in rows_only), rows_only
