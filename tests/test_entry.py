import os

import pandas as pd
import pytest

import __spark_entry__ as entry
from cairnframe.plans import core_problems, registry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


def _plain(rows):
    out = []
    for r in rows:
        out.append(tuple("" if pd.isna(v) else f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r))
    return sorted(out)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_queries_agree_with_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    got = registry.QUERIES[name](spark, DATA).toPandas()
    want = db.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert _plain(got[columns].itertuples(index=False)) == _plain(want[columns].itertuples(index=False))


@pytest.mark.parametrize("name", sorted({**{k: v for k, v in registry.QUERIES.items() if k not in registry.ORACLES}, **core_problems.QUERIES}))
def test_other_queries_run(spark, name):
    assert entry.queries()[name](spark, DATA).count() >= 0
