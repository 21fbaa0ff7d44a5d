"""Every registered retrieval query on the smallest tables, against its SQL where there is one."""

import glob
import os

import pytest

from reelquery import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*names).collect()), key=str)
    assert got
    if name in catalog.oracle_sql():
        want = duck.execute(catalog.oracle_sql()[name])
        at = [c[0] for c in want.description]
        assert sorted(at) == names
        assert got == sorted((tuple(r[at.index(n)] for n in names) for r in want.fetchall()), key=str)


def test_flagship_has_no_python(spark):
    plan = catalog.queries()["plan_merge"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
