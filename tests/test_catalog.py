"""A sample of registered queries against their SQL; tools/check.py compares all of them."""
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
check = pytest.importorskip("check")

import __spark_entry__ as contract  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["group_aggregates", "profile_columns", "purge_impurities", "winsorize", "drop_near_duplicates", "step_difference",
          "nominal_drift", "label_drift_count", "cramers_v", "target_encode", "confusion_matrix", "prepare_for_regression"]


def test_every_statement_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert len(contract.queries()) > 100


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = check.duckdb.connect()
    for t in check.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = contract.queries()[name](spark, FOLDER)
    cur = con.execute(contract.oracle_sql()[name])
    want_cols = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(want_cols)

    def norm(cols, rows):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted((tuple(check.canon(r[i]) for i in order) for r in rows), key=repr)
    assert norm(df.columns, [tuple(r) for r in df.collect()]) == norm(want_cols, cur.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
