import duckdb
import pytest

import __spark_entry__ as E
from verify import TABLES, norm

SF = "/root/testdata/sf0.01"   # sampling contracts need enough problems per level
SAMPLE = ("a01_loo_pass_rate", "l09_regimes", "r06_fitted_policy", "b02_ratio_interval", "tj5_segments", "m17_panel_counts")


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    assert E.entry(spark).count() == 1


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols and got == want
