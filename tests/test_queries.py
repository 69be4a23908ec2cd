"""Every registered query of the library against its SQL, and the entry without its optional parts."""

import datetime
import decimal
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from sparkgrain import catalog

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents".split()


def plain(x):
    if isinstance(x, decimal.Decimal):
        return str(x.normalize() + 0)
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    cols = [d[0] for d in want.description]
    assert sorted(cols) == sorted(got.columns)
    assert sorted(tuple(map(plain, r)) for r in got.select(*cols).collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("stale", [False, True])
def test_the_entry_stands_without_its_optional_parts(tmp_path, stale):
    import shutil

    for p in ("__spark_entry__.py", "sparkgrain"):
        (shutil.copytree if (ROOT / p).is_dir() else shutil.copy)(ROOT / p, tmp_path / p)
    shutil.rmtree(tmp_path / "sparkgrain" / "llm", ignore_errors=True)
    if stale:
        (tmp_path / "sparkgrain" / "llm" / "__pycache__").mkdir(parents=True)
    got = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert got.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLES))], got.stderr


def test_filters_reach_the_scan(spark):
    """The plan of a request: columns pruned, the filter pushed, one exchange for the aggregation."""
    from sparkgrain.plans import retail
    from sparkgrain.plans.request import MetricRequest, Predicate

    df = retail.frames(spark, SF).answer(MetricRequest(("revenue",), ("ordered_month",), (Predicate("order_id", "gt", (100,)),)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_orderkey,100)" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1]
    assert "Join" not in plan and plan.count("Exchange") == 1  # the dimensions that nothing reads aren't joined
